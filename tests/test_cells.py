"""The index in cells against full scans."""

from __future__ import annotations

import math
import random

import numpy as np

from tallyforge.operators import cells


def vectors(n, dim, seed, tight):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(12, dim))
    x = middles[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * tight
    return [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)]


def plain(rows, q, k, keep=lambda t: True):
    def score(x):
        norms = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in q))
        return round(max(0.0, min(1.0, sum(a * b for a, b in zip(x, q, strict=True)) / norms)), 6) if norms else 0.0

    return sorted(((-score(x), i) for i, x, t in rows if keep(t)), key=lambda p: p)[:k]


def test_exact_equals_a_full_scan_and_probes_recall(spark, tmp_path):
    rows = vectors(1500, 16, 3, 0.6)
    rows += [(5000 + i, rows[i][1], 0) for i in range(40)] + [(6000, [0.0] * 16, 0)]
    df = spark.createDataFrame([*rows, (7000, None, 0), (7001, [None] * 16, 0), (7002, [float("nan")] * 16, 1)], "id long, embedding array<double>, t int")
    index = cells.build(df, "id", f"{tmp_path}/i", 24)
    assert index.n.sum() == len(rows) and len([d for d in (tmp_path / "i").iterdir() if d.name.startswith("cell=")]) == (index.n > 0).sum()
    r = random.Random(1)
    queries = [(i, rows[r.randrange(1500)][1]) for i in range(6)] + [(6, [-x for x in rows[0][1]]), (7, [1.0] + [0.0] * 15)]
    want = {q: plain(rows, v, 15) for q, v in queries}
    got: dict[int, list] = {}
    for x in cells.search_all(index, queries, 15, probes=2, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((-x.score, x.id))
    assert got == want
    near = cells.search_all(index, queries[:6], 10, probes=6).collect()
    held = sum(x.id in {i for _, i in want[x.query_id][:10]} for x in near)
    assert held >= 0.9 * 60
    one = [(-x.score, x.id) for x in cells.search(index, queries[2][1], 5, 1, True, cells.F.col("t") == 1).orderBy("score", ascending=False).orderBy(-cells.F.col("score"), "id").collect()]
    assert one == plain(rows, queries[2][1], 5, lambda t: t == 1)
    # fewer vectors than asked for: all of them
    assert cells.search(index, queries[7][1], 5000, 1, True).count() == len(rows)


def test_cells_that_cannot_hold_more_are_not_read(spark, tmp_path, monkeypatch):
    rows = vectors(800, 8, 5, 0.02)
    index = cells.build(spark.createDataFrame(rows, "id long, embedding array<double>, t int"), "id", f"{tmp_path}/i", 12)
    asked = []
    probe = cells._probe
    monkeypatch.setattr(cells, "_probe", lambda i, q, pairs, k, w: asked.append(len(pairs)) or probe(i, q, pairs, k, w))
    assert cells.search(index, rows[0][1], 5, 1, True).count() == 5 and sum(asked) < 6


def test_empty(spark, tmp_path):
    index = cells.build(spark.createDataFrame([], "id long, embedding array<double>"), "id", f"{tmp_path}/i", 4)
    assert cells.search(index, [1.0, 0.0], 3, 2, True).count() == 0
