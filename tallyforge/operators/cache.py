"""The cache of embeddings as a table: investor_id, namespace, vector, text_hash, model.

A table of another model counts as empty; entries without a hash are old ones, which are embedded anew.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.fixed import NAMESPACES
from tallyforge.operators.tables import STALE_REASONS, staleness
from tallyforge.operators.vectors import upsert
from tallyforge.sources import json_ranges

KEYS = ["investor_id", "namespace"]


def load(entries: DataFrame, model: str) -> DataFrame:
    """The entries of this model; a missing hash becomes an empty one, rows without a vector are none."""
    return entries.filter((F.col("model") == model) & F.col("vector").isNotNull()).withColumn("text_hash", F.coalesce("text_hash", F.lit("")))


def read(spark: SparkSession, path: str, model: str, range_bytes: int = json_ranges.RANGE) -> DataFrame:
    """Cache files as JSON ({model, embeddings: {id: {namespace: {v, h} or a bare vector}}}), of both formats, read by byte
    ranges: one huge file is dealt over tasks. No file, a file of another model, and one that is damaged count as empty (the last with a warning)."""
    try:
        planned = json_ranges.plan(spark, path, ["model", "embeddings"], range_bytes)
    except ValueError as e:
        warnings.warn(f"the cache is not read, and starts empty: {e}", stacklevel=2)
        planned = {}
    own = {p: x for p, x in planned.items() if json_ranges.root_value(planned, p, "model") == model}
    rows = json_ranges.rows_of(spark, own, "embeddings").select(F.col("name").alias("investor_id"), F.explode(F.from_json("value", "map<string,string>")).alias("namespace", "entry"))
    bare = F.trim("entry").startswith("[")
    entry = F.from_json("entry", "v array<double>, h string")
    vector = F.when(bare, F.from_json("entry", "array<double>")).otherwise(entry.v)
    return load(rows.select("investor_id", "namespace", vector.alias("vector"), F.when(bare, "").otherwise(entry.h).alias("text_hash"), F.lit(model).alias("model")), model)


def write(rows: DataFrame, path: str, model: str, files: int = 1) -> None:
    """Cache files in the format that `read` takes. Each of so many is one JSON document, written by one task as it streams
    by, so their number is to grow with the rows."""
    entry = F.struct(F.col("vector").alias("v"), F.coalesce("text_hash", F.lit("")).alias("h"))
    own = rows.groupBy("investor_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("namespace", entry.alias("entry"))))).alias("by"))
    one = F.to_json(F.create_map("investor_id", "by"))
    part = F.pmod(F.xxhash64("investor_id"), F.lit(files)).cast("int")
    lines = own.select(part.alias("part"), F.lit(1).alias("place"), "investor_id", F.substring(one, F.lit(2), F.length(one) - 2).alias("value"))
    first = F.row_number().over(Window.partitionBy("part").orderBy("investor_id")) == 1
    lines = lines.withColumn("value", F.concat(F.when(first, "").otherwise(","), "value"))
    head = json.dumps({"model": model, "namespaces": list(NAMESPACES)}).removesuffix("}") + ', "embeddings": {'
    ends = rows.sparkSession.range(files).select(F.col("id").cast("int").alias("part"), F.inline(F.array(*[F.struct(F.lit(p).alias("place"), F.lit("").alias("investor_id"), F.lit(t).alias("value")) for p, t in ((0, head), (2, "}}"))])))
    ordered = lines.unionByName(ends).repartition("part").sortWithinPartitions("part", "place", "investor_id")
    ordered.select("part", "value").write.partitionBy("part").mode("overwrite").text(path)


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with new vectors by key; where new has no hash, the one there stays."""
    old = cache.select(*KEYS, F.col("text_hash").alias("_h"))
    rows = new.join(old, KEYS, "left").select(*KEYS, "vector", F.coalesce("text_hash", "_h", F.lit("")).alias("text_hash"), "model")
    return upsert(cache.select(*KEYS, "vector", "text_hash", "model"), rows, KEYS)


def invalidated(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def size(cache: DataFrame) -> DataFrame:
    """One row: investors with any vector."""
    return cache.agg(F.countDistinct("investor_id").alias("n_investors"))


def complete(cache: DataFrame, names: tuple[str, ...] = NAMESPACES) -> DataFrame:
    """investor_id, has_all: whether an investor has a vector in each namespace."""
    return cache.filter(F.col("namespace").isin(*names)).groupBy("investor_id").agg((F.countDistinct("namespace") == len(names)).alias("has_all"))


def text_changed(cached: Column, old_hash: Column, new_hash: Column) -> Column:
    return ~cached | (F.coalesce(old_hash, F.lit("")) == "") | (old_hash != new_hash)


def requirements(texts: DataFrame, cache: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is to be embedded (keys, text, new_hash, reason), and the counts of reasons by namespace with the number of
    investors all of whose texts are up to date."""
    rows = staleness(texts, cache.select(*KEYS, F.col("text_hash").alias("old_hash")), KEYS, force)
    whole = rows.groupBy("investor_id").agg(F.bool_and(F.col("reason") == "up_to_date").alias("whole")).agg(F.count_if("whole").alias("fully_cached"))
    counts = rows.groupBy("namespace").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in STALE_REASONS])
    return rows.filter("reason <> 'up_to_date'").select(*KEYS, "text", "new_hash", "reason"), counts.crossJoin(whole)  # one row


def index_records(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """namespace, record_id (investor:namespace), vector, metadata columns of texts, for a vector table. vectors: keys, vector."""
    return texts.join(vectors.select(*KEYS, "vector"), KEYS).withColumn("record_id", F.concat("investor_id", F.lit(":"), "namespace"))


def embedded(texts: DataFrame, embed, columns: list[str]) -> DataFrame:
    """texts with a column vector. embed: a function of a list of texts to a list of unit vectors, which a worker calls for
    each Arrow batch; a batch that fails is embedded text by text, and a text that fails has the zero vector's place, null."""
    import pandas as pd

    def work(batches):
        for part in batches:
            values = part.fillna("").tolist()
            try:
                yield pd.Series(list(embed(values)))
            except Exception:  # noqa: BLE001 - the model's own errors, of any kind
                yield pd.Series([_one(embed, v) for v in values])

    from collections.abc import Iterator

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts.select(*columns, F.pandas_udf(work, "array<double>")("text").alias("vector"))


def _one(embed, text: str):
    try:
        return list(embed([text])[0])
    except Exception:  # noqa: BLE001
        return None
