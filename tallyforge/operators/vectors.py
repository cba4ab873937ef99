"""Vector tables: exact top-k, by namespace, late fusion, upsert."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.functions.fixed import FUSION_WEIGHTS
from tallyforge.functions.vectors import cosine_unit


def score_against(vectors: DataFrame, query: DataFrame, score=cosine_unit, vector: str = "embedding") -> DataFrame:
    """vectors with a column score against the one row of query (its column q): one row, so it is broadcast."""
    return vectors.crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("score", F.round(score(F.col(vector), F.col("q")), 6)).drop("q")


def top_k(scored: DataFrame, k: int, *tie: str | Column) -> DataFrame:
    return scored.orderBy(F.desc("score"), *tie).limit(k)


def top_k_by(scored: DataFrame, k: int, by: list[str], *tie: str) -> DataFrame:
    """The k best of each group with their rank; the limit is applied before the shuffle too."""
    w = W.Window.partitionBy(*by).orderBy(F.desc("score"), *tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def late_fusion(found: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """Weighted sum of the best score in each namespace (0 where a row is in none), for every row of every."""
    best = found.groupBy(key).pivot("namespace", list(FUSION_WEIGHTS)).agg(F.max("score"))
    fused = sum((F.lit(w) * F.coalesce(F.col(n), F.lit(0.0)) for n, w in FUSION_WEIGHTS.items()), F.lit(0.0))
    return every.select(key).join(best, key, "left").select(key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in FUSION_WEIGHTS], F.round(fused, 6).alias("vector_score"))


def scored_by_namespace(vectors: DataFrame, queries: DataFrame, score=cosine_unit) -> DataFrame:
    """vectors (namespace, record, embedding) scored against the query vector of their namespace. queries: namespace, q; one
    row a namespace, so it is broadcast."""
    return vectors.join(F.broadcast(queries.select("namespace", "q")), "namespace").withColumn("score", F.round(score(F.col("embedding"), F.col("q")), 6)).drop("q")


def upsert_columns(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """old with one column set from new where it has the key; keys that old lacks are added, with what else new has. All
    other columns of rows that are there stay as they are."""
    own = new.select(key, F.col(column).alias("_new"))
    kept = old.join(own, key, "left").select(*[F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys it does not have."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def in_place(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key, with the place (first version) at which the key came in."""
    return last_wins(rows, keys, version).join(rows.groupBy(*keys).agg(F.min(version).alias("place")), keys)


def last_wins(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    w = W.Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def metadata_matches(conditions: dict[str, object], arrays: set[str] = frozenset()) -> Column:
    """All conditions hold: a list asks for any of its values, and an array column may hold any of them."""
    out = F.lit(True)
    for name, want in conditions.items():
        values = list(want) if isinstance(want, (list, tuple, set)) else [want]
        out = out & (F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if name in arrays else F.col(name).isin(values))
    return F.coalesce(out, F.lit(False))


#: Tokens whose place and weight a worker remembers, and their longest; rows of a batch that is hashed.
KNOWN_TOKENS, KNOWN_LENGTH, BATCH_ROWS = 50_000, 64, 1000


def _millionths(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    """sums / length in whole millionths; halves go away from zero, as in SQL. Whole sums of a whole length make exact halves."""
    v = np.abs(sums) * 1_000_000 / length
    whole = np.floor(v)
    return np.copysign(whole + (v - whole >= 0.5), sums)


def _hashed(dim: int):
    """A function of texts (in small letters) to unit vectors: the signed weights of their tokens, in twentieths, added up at
    dim places and divided by the vector's length, to six digits; null where all is zero."""
    word = re.compile(r"[a-zA-Z0-9_#+.-]+")

    def place(token: str) -> tuple[int, int]:
        h = hashlib.sha256(token.encode()).digest()
        return int.from_bytes(h[:4], "big") % dim, (20 + len(token)) * (-1 if h[4] % 2 else 1)

    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, int]] = {}
        for part in parts:
            sums = np.zeros((len(part), dim))
            for row, text in enumerate(part):
                at, weight = [], []
                for token in word.findall(text):
                    cell = known.get(token)
                    if cell is None:
                        cell = place(token)
                        if len(token) <= KNOWN_LENGTH:
                            if len(known) >= KNOWN_TOKENS:
                                known.clear()
                            known[token] = cell
                    at.append(cell[0])
                    weight.append(cell[1])
                if at:
                    sums[row] = np.bincount(np.array(at, np.int64), np.array(weight, np.float64), dim)
            # still in twentieths, so that the sum of squares is exact in any order
            length = np.sqrt((sums * sums).sum(1))
            unit = _millionths(sums, np.where(length > 0, length, 1)[:, None]) / 1_000_000
            yield pd.Series([u if n > 0 else None for u, n in zip(unit, length.tolist(), strict=True)], dtype=object)

    return F.pandas_udf(vectors, "array<double>")


def _modest(rows: DataFrame) -> DataFrame:
    """rows, after lowering the session's rows of an Arrow batch to BATCH_ROWS where they are more: a worker holds a batch's texts
    and vectors at once."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return rows


def hash_vectors(rows: DataFrame, text: Column, name: str = "embedding", dim: int = 96) -> DataFrame:
    """rows with the unit vector of signed feature hashing of a text (dim floats; null where no token counts). Nothing is
    shuffled: a row's vector comes from the row."""
    return _modest(rows).withColumn(name, _hashed(dim)(F.lower(F.coalesce(text, F.lit("")))).cast("array<float>"))


def hash_embedding(docs: DataFrame, dim: int = 96) -> DataFrame:
    """doc_id, i, x: the same in long form without zeros; token multiplicity counts."""
    known = _modest(docs).select("doc_id", _hashed(dim)(F.lower(F.coalesce("text", F.lit("")))).alias("unit"))
    return known.select("doc_id", F.posexplode("unit").alias("i", "x")).filter("x <> 0").select("doc_id", F.col("i").cast("long").alias("i"), "x")


def dense(cells: DataFrame, dim: int = 96) -> DataFrame:
    """doc_id, embedding (array of dim floats) of the long form; documents without tokens have no row in it."""
    found = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    return found.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)).cast("float")).alias("embedding"))
