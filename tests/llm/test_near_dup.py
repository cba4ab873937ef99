"""Near-duplicate components against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import common, near_dup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain(rows, size=4, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = min((rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None), default=None) if d is not None else None
        out.append((d, len(sets[i]), comp, d is None or d == comp))
    return Counter(out)


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    while len(rows) < n:
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 20, 60, 200]))]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w).upper() if r.random() < 0.2 else "\n".join(w))
        if r.random() < 0.4:
            rows.append(passage + " " + " ".join(r.choice(words) for _ in range(r.choice([5, 30, 80]))))
    return [(i * 3 + 1, t) for i, t in enumerate(rows[:n])]


def as_counter(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("rounds", [True, False])
def test_components_equal_all_pairs(spark, monkeypatch, rounds):
    if not rounds:  # all by blocks, of few rows, without clusters
        monkeypatch.setattr(near_dup, "STAGES", ((range(0, near_dup.BANDS), 1),))
        monkeypatch.setattr(near_dup, "BLOCK", 4)
        monkeypatch.setattr(near_dup, "CLUSTER", 0)
    rows = corpus(260)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_counter(near_dup.near_duplicates(df)) == plain(rows)


def test_five_words_keep_one(spark, docs):
    rows = corpus(120, 7)
    extra = [*rows, rows[4], rows[4], (None, rows[3][1]), (None, ""), (900, ""), (901, None), (4, rows[1][1] + " ")]
    df = docs([(d, t, "en", "s", 1) for d, t in extra])
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    want = plain(extra, 5)
    comps = {c for d, _, c, _ in want if d is not None}
    ids = Counter(d for d, _ in got.elements() if d is not None)
    assert set(ids) == comps and max(ids.values()) == 1 and got[(None, rows[3][1])] == 1 and got[(None, "")] == 1


def test_odd_rows(spark, odd, none):
    got = as_counter(near_dup.near_duplicates(odd))
    assert got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == 1 and got[(5, 1, 5, True)] == 2 and got[(None, 2, None, True)] == 1
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.keep_one(none).count() == 0


def test_components_by_shuffles(spark):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 300, 220), r.integers(0, 300, 220)
    chain = np.arange(1000, 1060)
    a, b = np.append(a, chain[:-1]), np.append(b, chain[1:])
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")
    one = {x.node: x.comp for x in near_dup.components(links).collect()}
    many = {x.node: x.comp for x in near_dup.components(links, one_task=0).collect()}
    assert one == many and one[1059] == 1000


def test_estimate_is_near_and_links_pass():
    r = np.random.default_rng(4)
    for j in (0.5, 0.8, 0.95):
        common, own = int(1000 * j), int(1000 * (1 - j) / 2)
        x = r.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64) * np.uint64(2)
        s, t = np.unique(x[: common + own]), np.unique(np.concatenate([x[:common], x[common + own :]]))
        agree = int((near_dup.registers(s) == near_dup.registers(t)).sum())
        n, m = np.array([len(s)]), np.array([len(t)])
        assert abs(near_dup.estimate(np.array([agree]), n, m)[0] - j) < 0.14
        assert near_dup.may_link(np.array([agree]), n, m, 80)[0] == (j >= 0.8)
    assert len(np.unique(near_dup.band_keys(near_dup.registers(s)[None]))) == near_dup.BANDS
    assert set(near_dup._MEMBERS.reshape(-1)) == set(range(near_dup.REGISTERS))


def test_hot_keys_are_dealt(spark, monkeypatch):
    """Rows of a hot key meet its row of the other side all the same, and in several parts."""
    from pyspark.sql import functions as F

    from tallyforge.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).select((F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 40)).alias("key"), F.col("id").alias("node"))
    side = common.materialise(rows.groupBy("key").agg(F.count("*").alias("n"), (F.max("node") * 2).alias("x")), "side")
    got = Counter(tuple(r) for r in common.join_dealt(rows, side, "key", "node").select("key", "node", "x").collect())
    assert got == Counter(tuple(r) for r in rows.join(side, "key").select("key", "node", "x").collect())
    plan = common.join_dealt(rows, side, "key", "node")._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def test_components_with_hot_keys(spark, monkeypatch):
    """A large group of near copies, with every bucket, pair and star dealt over parts, and small blocks."""
    from tallyforge.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "CLUSTER", 20)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = corpus(60, 5)
    for i in range(70):
        w = list(base)
        w[r.randrange(60)] = f"x{i}"
        rows.append((10_000 + i, " ".join(w)))
    half = [f"h{i}" for i in range(40)]
    rows += [(20_000 + i, " ".join(half + [f"y{i}_{j}" for j in range(30)])) for i in range(40)]
    assert as_counter(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_dealt_join_needs_no_job_for_its_side(spark):
    from pyspark.sql import functions as F

    rows = spark.range(300).select((F.col("id") % 7).alias("key"), F.col("id").alias("node"))
    side = common.materialise(rows.groupBy("key").agg(F.count("*").alias("n")), "noted")
    none = common.materialise(rows.filter("node < 0").groupBy("key").agg(F.count("*").alias("n")), "noted")
    context = spark.sparkContext
    context.setJobGroup("noted", "a join that is only planned")
    try:
        common.join_dealt(rows, side, "key", "node")
        common.join_dealt(rows, none, "key", "node")
        assert not context.statusTracker().getJobIdsForGroup("noted")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert common.counted(side) == common.counted(side.select("*")) == (7, 300, 43)
    assert common.counted(none) == (0, 0, 0) and common.counted(side.select("key")) == (7, 0, 0)
