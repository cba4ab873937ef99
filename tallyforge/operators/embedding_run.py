"""The embedding job: what is new or changed is embedded in chunks, each of which counts once it is committed.

A chunk is a set of buckets of the store (sources/bucket_store.py), so every bucket is rewritten once a run. A run that
ends in the middle leaves whole chunks behind; the next one compares hashes with what is stored, and embeds only the rest.
A text that the model does not take has no vector, is not stored, and is tried again by the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.fixed import NAMESPACES
from tallyforge.operators import cache as K
from tallyforge.sources.bucket_store import BucketStore
from tallyforge.sources.files import hadoop

SCHEMA = "investor_id string, namespace string, vector array<double>, text_hash string, model string"


@dataclass
class Summary:
    """What a run found and did; `reasons` counts by namespace, as K.requirements has them."""

    model: str
    reasons: dict[str, dict[str, int]]
    fully_cached: int
    chunks: int = 0
    embedded: int = 0
    failed: int = 0
    version: int | None = None
    namespaces: list[str] = field(default_factory=lambda: list(NAMESPACES))


def open_store(spark: SparkSession, path: str, n_buckets: int = 64) -> BucketStore:
    """The store at a path, made if it is not there."""
    store = BucketStore(spark, path)
    if store.version() is None:
        store.create(K.KEYS, spark.createDataFrame([], SCHEMA).schema, n_buckets)
    return store


def run(texts: DataFrame, store: BucketStore, model: str, embed: Callable[[list[str]], list], chunk_rows: int = 1_000_000, force: bool = False, most_chunks: int | None = None) -> Summary:
    """Embed what texts (investor_id, namespace, text) has and the store lacks, about chunk_rows a commit.

    most_chunks: end after so many chunks, as a lost run does; the next run goes on from there. force: embed everything.
    """
    spark = texts.sparkSession
    v = store.version()
    stored = store.read(v)
    todo, counts = K.requirements(texts, K.load(stored, model), force)
    # a row a namespace, of which there are a few
    rows = counts.collect()
    reasons = {r.namespace: {k: x for k, x in r.asDict().items() if k not in ("namespace", "fully_cached")} for r in rows}
    out = Summary(model, reasons, max((r.fully_cached for r in rows), default=0))
    plan = f"{store.path}/plan/{uuid.uuid4().hex}"
    fs, folder = hadoop(spark, f"{store.path}/plan")
    fs.delete(folder, True)  # of a run that was lost; a store takes one run at a time
    todo.withColumn("bucket", store.bucket_of(v)).repartition("bucket").write.partitionBy("bucket").parquet(plan)
    planned = spark.read.schema(todo.withColumn("bucket", F.lit(0)).schema).parquet(plan)
    # one number a bucket
    sizes = sorted((r.bucket, r.n) for r in planned.groupBy("bucket").agg(F.count("*").alias("n")).collect())
    chunks: list[list[int]] = []
    held = 0
    for bucket, n in sizes:
        if not chunks or held + n > chunk_rows:
            chunks.append([])
            held = 0
        chunks[-1].append(bucket)
        held += n
    for own in chunks[:most_chunks]:
        # the buckets of a chunk may be few: their rows are dealt over all tasks for the model
        part = planned.filter(F.col("bucket").isin(own)).drop("bucket").repartition(*K.KEYS)
        made = K.embedded(part, embed, [*K.KEYS, "new_hash"]).select(*K.KEYS, "vector", F.col("new_hash").alias("text_hash"), F.lit(model).alias("model"))
        seen = Observation()
        watched = made.observe(seen, F.count("vector").alias("good"), F.count_if(F.col("vector").isNull()).alias("bad"))
        commit = store.upsert(_once(watched, plan, out.chunks), note={"model": model, "chunk": out.chunks})
        out.chunks += 1
        out.embedded += seen.get["good"]
        out.failed += seen.get["bad"]
        out.version = commit.number
    if out.chunks == len(chunks):
        fs.delete(folder, True)
    return out


def _once(rows: DataFrame, plan: str, chunk: int) -> DataFrame:
    """rows with a vector as a table, so that the model sees each text once, however often they are read."""
    at = f"{plan}-vectors/{chunk}"
    rows.write.mode("overwrite").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at).filter("vector IS NOT NULL")
