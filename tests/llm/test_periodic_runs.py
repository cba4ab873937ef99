"""Runs of repeating words against a search of every stretch."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from tallyforge.llm import periodic_runs


def plain(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    runs = []
    for s in range(n):
        for q in range(1, n):
            e = s + q
            while e < n and w[e] == w[e - q]:
                e += 1
            long = e - s >= max(24, 3 * q)
            starts = s == 0 or s - 1 + q < n and w[s - 1] != w[s - 1 + q]
            if long and starts and not any(all(w[i] == w[i - d] for i in range(s + d, e)) for d in range(1, q)):
                runs.append((s, e - s, q))
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def texts(n, seed=5):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < r.choice([0, 5, 30, 60, 90]):
            unit = [r.choice(["a", "b", "é", "A", "c d"]) for _ in range(r.choice([1, 1, 2, 3, 5, 9, 11]))]
            words += unit * r.choice([1, 2, 3, 4, 8, 12, 25]) + unit[: r.randrange(len(unit) + 1)]
        out.append(r.choice([" ", "\n", "\x0b ", "\x0c\t"]).join(words))
    return out


@pytest.mark.parametrize(("lags", "cells"), [(4096, 1 << 19), (3, 1 << 19), (4096, 20), (2, 300)])
def test_runs_equal_every_stretch(spark, lags, cells):
    """In one go, in ranges of lags, lag by lag, and both."""
    rows = list(enumerate(texts(140)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in periodic_runs.find_runs(df, lags=lags, cells=cells).collect())
    want = Counter(plain(*r) for r in rows)
    assert got == want and sum(r[1] for r in want) > 50


def test_ranges_of_a_long_text(spark, docs):
    r = random.Random(9)
    words = [f"w{r.randrange(4000)}" for _ in range(30_000)]
    words[2_000:20_000] = (words[2_000:7_800] * 4)[:18_000]
    df = docs([(1, " ".join(words), "en", "s", 1), (2, "x " * 26_000, "en", "s", 1)])
    got = {x.doc_id: x for x in periodic_runs.find_runs(df, plant=False).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (1, 2_000, 18_000, 5_800, 3_103)
    assert got[1].collapsed_sha256 == hashlib.sha256(" ".join(words[:7_800] + words[20_000:]).encode()).hexdigest()
    assert (got[2].n_runs, got[2].start, got[2].length, got[2].period) == (1, 0, 26_000, 1) and got[2].collapsed_sha256 == hashlib.sha256(b"x").hexdigest()


def test_odd_rows(spark, odd, odd_text_ids, none):
    empty = hashlib.sha256(b"").hexdigest()
    for df in (odd, odd_text_ids):
        got = Counter(tuple(r) for r in periodic_runs.find_runs(df).collect())
        assert sum(got.values()) == df.count() and all(x[1] == 0 for x in got if x[0] not in (4, "doc/4"))
        first = [x for x in got if x[0] in (1, 2, 3, "doc/1", "doc/2", "doc/3")]
        assert len(first) == 3 and all(x[2:] == (None, None, None, None, empty, empty) for x in first)
    assert periodic_runs.find_runs(none).count() == 0
    same = spark.createDataFrame([(None, "a " * 30), (None, "a " * 30), (7, "b " * 23)], "doc_id long, text string")
    assert Counter(tuple(r)[:5] for r in periodic_runs.find_runs(same, plant=False).collect()) == {(None, 1, 0, 30, 1): 2, (7, 0, None, None, None): 1}
