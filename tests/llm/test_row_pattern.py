"""Matches of the row pattern against a plain backtracking search."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
from collections import Counter

import pytest

from tallyforge.llm import row_pattern

CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, props string"
START = dt.datetime(2024, 1, 1)
STEP = dt.timedelta(minutes=15)


def plain(rows):
    """Row by row, backtracking over (D|U)* from the longest."""
    by = {}
    for r in set(rows):
        if r[2] is not None and r[1] is not None:
            by.setdefault(r[2], []).append(r)
    out = []
    for client, own in by.items():
        cents = lambda r: None if r[4] is None or math.isnan(r[4]) else math.floor(100 * r[4] + 0.5)
        own.sort(key=lambda r: (r[1], r[0], (cents(r) is not None, cents(r) or 0), (r[3] not in (None, "error")) + (r[3] == "view")))

        def near(i):
            return own[i][1] - own[i - 1][1] <= STEP and cents(own[i]) is not None

        def turn(i):
            if near(i) and own[i][3] not in (None, "error") and cents(own[i]) != cents(own[i - 1]):
                return "D" if cents(own[i]) < cents(own[i - 1]) else "U"
            return None

        s = no = 0
        while s < len(own):
            found = None
            if cents(own[s]) is not None:
                e, letters = s, "A"
                while e + 1 < len(own) and turn(e + 1):
                    e += 1
                    letters += turn(e)
                for p in range(min(e + 1, len(own) - 1), s, -1):
                    if near(p) and own[p][3] == "view" and cents(own[p]) >= cents(own[s]):
                        t, label = p, letters[: p - s] + "P"
                        while t + 1 < len(own) and turn(t + 1) == "D":
                            t += 1
                            label += "D"
                        found = (t, label)
                        break
            if found is None:
                s += 1
                continue
            t, label = found
            no += 1
            out.append((client, no, own[s][0], own[t][0], t - s + 1, sum(cents(r) for r in own[s : t + 1]), hashlib.sha256(label.encode()).hexdigest()))
            s = t
    return Counter(out)


def clicks(n, clients, seed, prices=6, gap=20 * 60):
    r = random.Random(seed)
    rows, at = [], START
    for i in range(n):
        at += dt.timedelta(microseconds=r.choice([0, 1, 900_000_000, 900_000_001, r.randrange(gap * 1_000_000)]))
        rows.append((i, at if r.random() > 0.01 else None, r.choice([7] * 9 + list(range(clients))) if r.random() > 0.02 else None, r.choice(["view", "view", "click", "purchase", "click", "error", None]) if r.random() < 0.4 else "view", r.choice([None, float("nan")]) if r.random() < 0.03 else r.randrange(prices) + 0.25, r.choice(["{}", None])))
        if r.random() < 0.05:
            rows.append(r.choice(rows))
    r.shuffle(rows)
    return rows


def result(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("n", "clients", "seed", "prices", "gap"), [(900, 6, 1, 6, 60), (700, 200, 2, 50, 1200), (600, 1, 3, 2, 10), (500, 2, 4, 1000, 5)])
def test_matches_equal_backtracking(spark, n, clients, seed, prices, gap):
    """Over many slices, so that segments cross them, and in small batches."""
    rows = clicks(n, clients, seed, prices, gap)
    df = spark.createDataFrame(rows, CLICKS)
    want = plain(rows)
    assert want and result(row_pattern.match_rows(df)) == want
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(row_pattern.match_rows(df, 3)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_long_segment_over_many_slices(spark):
    rows = [(i, START + dt.timedelta(seconds=i), 1, "view" if i % 3 else "click", float(100_000 - i + 3 * (i % 2)), None) for i in range(2_000)]
    df = spark.createDataFrame(rows, CLICKS)
    assert result(row_pattern.match_rows(df)) == plain(rows)


def test_sql_gives_the_same(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW clicks AS SELECT * FROM '{sf}/clicks.parquet'")
    want = Counter(c.execute(row_pattern.match_rows_sql()).fetchall())
    got = row_pattern.match_rows(spark.read.parquet(f"{sf}/clicks.parquet"))
    assert want and Counter(tuple(r) for r in got.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256").collect()) == want


def test_odd_rows(spark):
    at = START
    rows = [
        (1, at, 1, "error", 1.0, "a"), (1, at, 1, "error", 1.0, "a"), (1, at, 1, "error", 1.0, None), (None, at, 2, "view", 1.0, ""), (3, at + STEP, 2, "view", 1.0, ""),
        (4, at, 3, None, -0.005, ""), (5, at, 3, "view", 1e300, ""), (6, at, 3, "view", float("inf"), ""), (7, at, None, "view", 1.0, ""), (8, None, 3, "view", 1.0, ""), (9, at + STEP, 3, "view", 0.0, ""),
    ]
    extra = spark.createDataFrame([(*r, r[0], {"k": 1} if i != 3 else None, i % 2 * 0) for i, r in enumerate(rows)], CLICKS + ", `a.b` long, cents map<string,int>, slice int")
    got = {(r.client_id, r.first_id, r.last_id, r.n_rows, r.sum_cents) for r in row_pattern.match_rows(extra).collect()}
    # client 3: rows 5 and 6 fit no letter, so nothing reaches row 9
    assert got == {(2, None, 3, 2, 200)}
    assert row_pattern.match_rows(extra.limit(0)).count() == 0
    texts = spark.createDataFrame([(f"r{i}", at + dt.timedelta(minutes=i), "c", "view", 2.0, "") for i in range(5)], CLICKS.replace("long", "string"))
    assert [tuple(r)[:5] for r in row_pattern.match_rows(texts).orderBy("match_no").collect()] == [("c", 1 + i, f"r{i}", f"r{i + 1}", 2) for i in range(4)]
    zoned = spark.createDataFrame([(i, at + dt.timedelta(minutes=i), 1, "view", 2.0, "") for i in range(3)], CLICKS.replace("_ntz", ""))
    assert row_pattern.match_rows(zoned).count() == 2
