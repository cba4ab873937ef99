"""Fingerprints and their components against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallyforge.llm import bit_slices, common

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(fps, radius):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def plain(rows, radius=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    with_id = [i for i, (d, _) in enumerate(rows) if d is not None]
    least = {}
    roots = dict(zip(with_id, plain_roots([fps[i] for i in with_id], radius), strict=True))
    for i in with_id:
        least[roots[i]] = min(least.get(roots[i], rows[i][0]), rows[i][0])
    return Counter((d, f"{f:016x}", least[roots[i]] if i in roots else None) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def result(df):
    return Counter(tuple(r) for r in df.collect())


def near(n, seed):
    """Fingerprints in clusters that reach from bit to bit, and others."""
    r = random.Random(seed)
    out = {0, 1, (1 << 64) - 1, 3 << 62}
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 5, 40])):
            out.add(x)
            for _ in range(r.choice([1, 2, 2, 3, 4])):
                x ^= 1 << r.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_near_pairs_equal_all_pairs(radius):
    for n in (1, 63, 64, 65, 300):
        x = near(n, n + radius)
        i, j = bit_slices.near_pairs(np.array(x, np.uint64), radius, 50)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for b in range(len(x)) for a in range(b) if (x[a] ^ x[b]).bit_count() <= radius}


def test_least_reached():
    r = np.random.default_rng(3)
    i, j = r.integers(0, 400, 300), r.integers(0, 400, 300)
    up = list(range(400))
    for _ in range(400):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            up[a] = up[b] = min(up[a], up[b])
    assert bit_slices.least_reached(400, i, j).tolist() == up


@pytest.mark.parametrize(("radius", "bucket", "tile"), [(2, 1024, 4096), (2, 2, 30), (1, 3, 10), (3, 4, 50)])
def test_links_join_all_that_are_near(spark, radius, bucket, tile):
    """In coarse buckets, and in buckets made finer up to the last bits."""
    x = near(500, 8)
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    links = [tuple(r) for r in bit_slices.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, bucket, tile).collect()]
    at = {v: i for i, v in enumerate(signed)}
    i, j = (np.array([at[link[k]] for link in links], np.int64) for k in (0, 1))
    got = bit_slices.least_reached(len(x), i, j)
    want = plain_roots(x, radius)
    assert len(set(want)) < len(x) and len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_every_difference_keeps_a_mask():
    r = random.Random(1)
    for radius in (1, 2, 3):
        for mask in (0, bit_slices.finer(0, radius)[1]):
            free = [b for b in range(64) if not mask >> b & 1]
            for _ in range(300):
                diff = sum(1 << b for b in r.sample(free, radius))
                assert any(not m & diff for m in bit_slices.finer(mask, radius))


def test_components_equal_all_pairs(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    rows = [(1000, None), (3, ""), (4, " \n "), (5, "One"), (6, "one"), (7, "one two"), (8, "one  TWO"), (None, "no id"), (9, "no id"), (9, "no id"), (2, "É é x")]
    for i in range(160):
        base = [r.choice(words) for _ in range(r.choice([2, 3, 8, 40, 150, 400]))]
        for k in range(r.choice([1, 2, 6])):
            w = list(base)
            if k:
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((10_000 - 10 * i - k, r.choice([" ", "\t"]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert result(bit_slices.simhash_components(df)) == want and len({c for _, _, c in want}) < len(want) - 20
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    assert result(bit_slices.simhash_components(df)) == want


def test_odd_rows(spark, odd, odd_text_ids, none):
    got = result(bit_slices.simhash_components(odd))
    assert sum(got.values()) == odd.count() and got[(1, "0" * 16, 1)] == got[(2, "0" * 16, 1)] == got[(3, "0" * 16, 1)] == 1
    assert {x[2] for x in got if x[0] is None} == {None} and [v for k, v in got.items() if k[0] == 5] == [2]
    assert sum(result(bit_slices.simhash_components(odd_text_ids)).values()) == odd_text_ids.count()
    assert bit_slices.simhash_components(none).count() == 0
