"""An index of vectors in cells: near cells first, and an exact end by the triangle inequality.

Cells are the nearest of n_cells centres on the unit sphere (spherical k-means, each step one pass in which every task sums
up what it reads, so that a row for each cell and task is shuffled). The index is a table partitioned by cell, so that a
search reads the folders of the cells it probes; of each cell it keeps the greatest angle to its centre.

A query's angle to any vector of a cell is at least its angle to the centre less that radius. A search probes the cells of
the nearest centres. With `exact` a second step probes those of the others whose bound still reaches the k-th score found, so
the result is that of a full scan; without it, recall depends on the number of probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.vectors import cosine
from tallyforge.operators.vectors import top_k_by

#: Vectors on which centres are fitted, drawn by a hash of their key; all vectors are indexed.
SAMPLE = 200_000
#: Scores are rounded to six digits; a bound within this of the k-th score may still reach it.
MARGIN = 2e-6


@dataclass
class Cells:
    spark: SparkSession
    path: str
    key: str
    centres: np.ndarray
    #: The greatest angle in each cell, and its vectors.
    radius: np.ndarray
    n: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(vectors: DataFrame, key: str, n_cells: int, steps: int = 8, sample: int = SAMPLE) -> np.ndarray:
    """Centres from at most about `sample` vectors; of n_cells by dim numbers, which the driver holds."""
    total = vectors.count()
    order = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    part = vectors.filter(order < int((1 << 30) * min(1.0, sample / max(1, total)))).select(F.col(key).alias("k"), "embedding")
    # the first centres: the vectors with the least salted hashes
    first = part.orderBy(F.xxhash64("k", F.lit(17)), "k").limit(n_cells).select("embedding").collect()
    if not first:
        return np.zeros((0, 0))
    centres = np.array([r.embedding for r in first], np.float64)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], at=centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(at), np.zeros(len(at), np.int64)
            for b in batches:
                x = _matrix(b.column(0))
                if len(x):
                    cell = (x @ at.T).argmax(1)
                    np.add.at(total, cell, x)
                    n += np.bincount(cell, minlength=len(at))
            own = np.flatnonzero(n)
            yield pa.record_batch([pa.array(own), pa.array(list(total[own]), pa.list_(pa.float64()))], ["cell", "s"])

        made = part.select("embedding").mapInArrow(sums, "cell long, s array<double>")
        rows = made.groupBy("cell").agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(centres.shape[1])]).collect()
        new = centres.copy()
        for r in rows:
            s = np.array(r[1:], np.float64)
            if np.linalg.norm(s) > 0:
                new[r.cell] = s / np.linalg.norm(s)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


def build(vectors: DataFrame, key: str, path: str, n_cells: int = 64, steps: int = 8, sample: int = SAMPLE) -> Cells:
    """Index all vectors (key, embedding, and other columns, which are kept) at a path. Vectors that are null or hold null or
    NaN are left out; those of length zero go to some cell with a right angle."""
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")))
    vectors = vectors.filter(good)
    centres = fit(vectors, key, n_cells, steps, sample)
    if not len(centres):
        return Cells(vectors.sparkSession, path, key, centres, np.zeros(0), np.zeros(0, np.int64))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dots = _matrix(b.column(b.schema.get_field_index("embedding"))) @ centres.T
                cell = dots.argmax(1)
                angle = np.arccos(np.clip(dots[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    fields = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes)
    dealt = vectors.mapInArrow(placed, f"{fields}, cell int, angle double").repartition("cell", F.pmod(F.xxhash64(key), F.lit(8)))
    dealt.write.partitionBy("cell").mode("overwrite").parquet(path)
    spark = vectors.sparkSession
    radius, n = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in spark.read.parquet(path).groupBy("cell").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():
        radius[r.cell], n[r.cell] = r.a, r.n
    return Cells(spark, path, key, centres, radius, n)


def search(index: Cells, query: list[float], k: int, probes: int = 8, exact: bool = False, where: Column | None = None) -> DataFrame:
    """key and score (rounded to six digits, within 0 and 1) of the k best by score, then key. where: a condition on the
    index's columns."""
    return search_all(index, [(0, query)], k, probes, exact, where).select(index.key, "score")


def search_all(index: Cells, queries: list[tuple[int, list[float]]], k: int, probes: int = 8, exact: bool = False, where: Column | None = None) -> DataFrame:
    """query_id, key, score, rank for each of a stated list of queries."""
    spark = index.spark
    q = np.array([v for _, v in queries], np.float64)
    unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    angle = np.arccos(np.clip(unit @ index.centres.T, -1, 1)) if len(index.centres) else np.zeros((len(q), 0))
    full = np.flatnonzero(index.n)
    near = [full[np.argsort(angle[i, full], kind="stable")] for i in range(len(q))]
    first = [(i, int(c)) for i in range(len(q)) for c in near[i][:probes]]
    hits = _probe(index, queries, first, k, where)
    if not exact:
        return hits
    found = {r.query_id: (r.n, r.low) for r in hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).collect()}
    more = []
    for i, (qid, _) in enumerate(queries):
        n, low = found.get(qid, (0, 0.0))
        for c in near[i][probes:].tolist():
            best = math.cos(max(0.0, angle[i, c] - index.radius[c]))
            # below k results, or at score 0, where all negative cosines stand, every cell may matter
            if n < k or low <= MARGIN or best >= low - MARGIN:
                more.append((i, c))
    if not more:
        return hits
    both = hits.drop("rank").unionByName(_probe(index, queries, more, k, where).drop("rank"))
    out = top_k_by(both, k, ["query_id"], index.key)
    return out.select("query_id", index.key, "score", "rank")


def _probe(index: Cells, queries: list[tuple[int, list[float]]], pairs: list[tuple[int, int]], k: int, where: Column | None) -> DataFrame:
    """The k best of each query in the cells paired with it. The pairs are a stated list, so they are broadcast."""
    spark = index.spark
    rows = [(queries[i][0], c, [float(x) for x in queries[i][1]]) for i, c in pairs]
    asked = spark.createDataFrame(rows, "query_id long, cell int, q array<double>")
    if not len(index.centres):
        return spark.createDataFrame([], f"query_id long, {index.key} long, score double, rank int")
    vectors = spark.read.parquet(index.path).filter(F.col("cell").isin(sorted({c for _, c in pairs})))
    if where is not None:
        vectors = vectors.filter(where)
    scored = vectors.join(F.broadcast(asked), "cell").select("query_id", index.key, F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return top_k_by(scored, k, ["query_id"], index.key).select("query_id", index.key, "score", "rank")
