"""Bounded samples of labelled rows for the classifiers, drawn alike at every size.

Cases: null texts count as empty; texts are taken whole or not at all; null ids and labels that are neither 0 nor 1 are left
out; of repeated labels the largest holds, and repeated documents count once; ties in the hash go to the smaller id; without
labelled rows a sample is empty, and a logistic fit of it gives zero weights; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise, modest_batches

#: Labelled rows that a classifier is fitted on at most (a parameter of each fit).
SAMPLE = 8000
#: Bytes of their texts together at most (a parameter too): what a fit sends to the driver grows with these bytes.
SAMPLE_BYTES = 48 << 20


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; null where the id is null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE, where: Column | None = None, more: tuple[str, ...] = (), most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, target (0/1) and more of up to `rows` labelled documents, the first by a hash of doc_id, of up to
    `most_bytes` bytes of text together: a text that would go beyond is left out whole, and the next ones are tried.

    Labels that are null, or neither 0 nor 1, and rows without a doc_id are left out; of repeated labels the
    largest holds; documents that repeat an id and a text count once. The drawn ids are at most `rows`, so their side of
    the join is broadcast with a proven bound. The sample is a table in the shared folder, which the caller's scratch deletes.
    """
    own = labels.select(F.col("doc_id"), F.col(target).cast("int").alias("target")).filter(F.col("doc_id").isNotNull() & F.col("target").isin(0, 1))
    if where is not None:
        own = own.filter(where)
    drawn = own.groupBy("doc_id").agg(F.max("target").alias("target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    shaped = modest_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    found = shaped.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "target", *more, F.xxhash64("doc_id", "text").alias("_row"), F.octet_length("text").alias("_bytes"))
    found = materialise(found, "sample")
    sizes = found.groupBy(F.xxhash64("doc_id").alias("at"), "_row").agg(F.min("_bytes").alias("n"), F.count("*").alias("times")).orderBy("at", "_row").limit(rows).collect()
    taken, left = [], most_bytes
    for r in sizes:
        if r.n <= left:
            taken.append(r._row)
            left -= r.n
    if len(taken) < len(sizes) or len(sizes) == rows:
        found = found.filter(F.col("_row").isin(taken))
    if any(r.times > 1 for r in sizes):
        found = found.dropDuplicates(["_row"])
    return found.select("doc_id", "text", "target", *more)


def fit_logistic(x: np.ndarray, y: np.ndarray, classes: int = 2, ridge: float = 1.0, steps: int = 300, rate: float = 0.5) -> np.ndarray:
    """Weights (features + 1, classes) of a softmax regression by full-batch Adam, from zero: the same each time."""
    rows = np.column_stack([x, np.ones(len(x))])
    w = np.zeros((rows.shape[1], classes))
    if not len(x):
        return w
    hot = np.eye(classes)[y]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = softmax(rows @ w)
        g = rows.T @ (p - hot) / len(x) + ridge / len(x) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift that turn scores z into log-odds of y (Newton steps on two parameters)."""
    a, b = 1.0, 0.0
    if len(set(y.tolist())) < 2:
        return a, b
    # targets pulled from 0 and 1 by the class sizes
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
