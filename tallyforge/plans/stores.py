"""Queries over stores on disk: cache files read by byte ranges, upserts by bucket, an embedding run that is broken off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.fixed import NAMESPACES
from tallyforge.operators import cache as K
from tallyforge.operators import cells as I
from tallyforge.operators import embedding_run as R
from tallyforge.plans.book import Book, table
from tallyforge.sources import saved_answers as SA
from tallyforge.sources import workbook as W
from tallyforge.sources.bucket_store import BucketStore, set_columns
from tallyforge.sources.files import new_dir
from tallyforge.streaming import answers as ST

book = Book()

NS = "['fund_thesis', 'partner_bio', 'portfolio', 'activity']"


def namespace(i) -> F.Column:
    return F.get(F.array(*map(F.lit, NAMESPACES)), i.cast("int"))


@book.query(f"""SELECT 'a"' || (vec_id // 4) || '{{\\' AS investor_id, {NS}[(vec_id % 4 + 1)::INT] AS namespace, CASE WHEN vec_id % 3 = 0 THEN '' ELSE md5(vec_id::VARCHAR) || '}}],"' END AS text_hash, len(embedding)::INT AS dim, embedding[1]::DOUBLE AS first_x, embedding[-1]::DOUBLE AS last_x FROM embeddings""")
def cache_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as cache files of JSON, a file for 20,000 of them, and read again in ranges of a megabyte."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    rows = e.select(F.concat(F.lit('a"'), F.floor(k / 4), F.lit("{\\")).alias("investor_id"), namespace(k % 4).alias("namespace"), F.col("embedding").cast("array<double>").alias("vector"), F.when(k % 3 != 0, F.concat(F.md5(k.cast("string")), F.lit('}],"'))).alias("text_hash"))
    at = new_dir(spark, "cache")
    K.write(rows, at, "m", 1 + e.count() // 20_000)
    found = K.read(spark, at, "m", 1 << 20)
    return found.select("investor_id", "namespace", "text_hash", F.size("vector").alias("dim"), F.get("vector", F.lit(0)).alias("first_x"), F.element_at("vector", -1).alias("last_x"))


@book.query("""SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 9 ELSE label END::INT AS label, CASE WHEN vec_id % 10 = 5 THEN embedding[2] WHEN vec_id % 10 = 0 THEN embedding[1] ELSE embedding[1] END::DOUBLE AS x, CASE WHEN vec_id % 10 IN (0, 5) THEN 'new' ELSE 'old' END AS source FROM embeddings""")
def bucket_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store without every tenth vector; these are added, and of those between one column is set and the rest stays."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    old = e.filter(k % 10 != 0).select("vec_id", "label", "x", F.lit("old").alias("source"))
    store = BucketStore(spark, new_dir(spark, "vectors")).create(["vec_id"], old.schema, 16)
    store.upsert(old)
    store.upsert(e.filter(k % 5 == 0).select("vec_id", F.lit(9).alias("label"), F.when(k % 10 == 5, F.col("y")).otherwise(F.col("x")).alias("x"), F.lit("new").alias("source")), set_columns("x", "source"))
    return store.read()


TEXTS = f"t AS (SELECT c_custkey::VARCHAR AS investor_id, {NS}[(ns + 1)::INT] AS namespace, c_name || '/' || ns || CASE WHEN c_custkey % 4 = 0 AND ns = 2 THEN ' new' ELSE '' END AS text FROM customer, (SELECT unnest([0, 1, 2, 3]) AS ns))"


@book.query(f"WITH {TEXTS} SELECT investor_id, namespace, md5(text) AS text_hash, length(text)::DOUBLE AS x, (SELECT count(*) FROM customer) * 4 AS n_first, count(*) FILTER (text LIKE '% new') OVER () AS n_again FROM t")
def embedding_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends after a third of its chunks, one that goes on from there, and one for the texts that have changed since."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ns"))
    text = F.concat("c_name", F.lit("/"), "ns")
    texts = c.select(F.col("k").cast("string").alias("investor_id"), namespace(F.col("ns")).alias("namespace"), text.alias("text"), ((F.col("k") % 4 == 0) & (F.col("ns") == 2)).alias("changes"))
    store = R.open_store(spark, new_dir(spark, "embedded"), 24)

    def embed(batch: list[str]) -> list[list[float]]:
        return [[float(len(t)), 1.0] for t in batch]

    rows = texts.count()
    first = R.run(texts, store, "m", embed, -(-rows // 6), most_chunks=2)
    rest = R.run(texts, store, "m", embed, -(-rows // 6))
    again = R.run(texts.withColumn("text", F.concat("text", F.when(F.col("changes"), " new").otherwise(""))), store, "m", embed)
    out = store.read().select("investor_id", "namespace", "text_hash", F.get("vector", F.lit(0)).alias("x"))
    return out.withColumns({"n_first": F.lit(first.embedded + rest.embedded).cast("long"), "n_again": F.lit(again.embedded).cast("long")})


# ---- an index in cells: eight query vectors, as a run has a few


def _index(spark: SparkSession, sf_dir: str) -> tuple[I.Cells, list[tuple[int, list[float]]]]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    queries = [(r.vec_id, [float(x) for x in r.embedding]) for r in e.filter("vec_id < 8").collect()]
    return I.build(e, "vec_id", new_dir(spark, "cells"), 32), queries


TOP = """q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id < 8),
s AS (SELECT query_id, vec_id, label, round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))))), 6) AS score FROM embeddings, q)"""


@book.query(f"WITH {TOP} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 20")
def cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of each query: near cells, then those whose bound still reaches the 20th."""
    index, queries = _index(spark, sf_dir)
    return I.search_all(index, queries, 20, exact=True)


@book.query(f"WITH {TOP} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE label IN (1, 3, 5) QUALIFY rank <= 5")
def cells_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under a condition on what the index keeps beside the vectors."""
    index, queries = _index(spark, sf_dir)
    return I.search_all(index, queries, 5, exact=True, where=F.col("label").isin(1, 3, 5))


@book.query()
def cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 10 best of each query three quarters of the cells hold: these vectors lie in all directions alike."""
    index, queries = _index(spark, sf_dir)
    found, best = I.search_all(index, queries, 10, probes=24), I.search_all(index, queries, 10, exact=True)
    return best.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


# ---- workbooks


@book.query("SELECT 'suppliers' AS sheet, s_suppkey AS key, s_name || ' <&> ' || s_nationkey AS name, s_acctbal::DOUBLE AS x, s_suppkey % 3 = 0 AS flag, to_json({'k': s_suppkey}) AS nested FROM supplier UNION ALL SELECT 'nations', n_nationkey, n_name, NULL, NULL, NULL FROM nation")
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets written as one workbook, in parts of 100 rows, and read again."""
    k = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select(k, F.concat("s_name", F.lit(" <&> "), "s_nationkey").alias("name"), "s_acctbal", (k % 3 == 0).alias("flag"), F.struct(k.alias("k")).alias("nested"))
    at = new_dir(spark, "book")
    W.write_workbook({"suppliers": suppliers, "nations": table(spark, sf_dir, "nation").select("n_nationkey", "n_name")}, f"{at}/book.xlsx", f"{at}-parts", part_rows=100)
    s, n = (W.read_workbooks(spark, f"{at}/book.xlsx", name, header=0) for name in ("suppliers", "nations"))
    rows = s.select(F.lit("suppliers").alias("sheet"), F.col("s_suppkey").cast("long").alias("key"), "name", F.col("s_acctbal").cast("double").alias("x"), F.col("flag").cast("boolean").alias("flag"), "nested")
    none = F.lit(None)
    return rows.unionByName(n.select(F.lit("nations").alias("sheet"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), none.cast("double").alias("x"), none.cast("boolean").alias("flag"), none.cast("string").alias("nested")))


# ---- saved answers: events stand for answers of searches, one a day, user and parity


LABELS = ("primary", "fallback", "plain")
WAIT_H = 6


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    none = F.array().cast(SA.ENTRIES)
    entry = F.struct(F.concat(F.lit("https://a.com/"), k).alias("href"), kind.alias("title"), F.col("props").alias("body"))
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").cast("string").alias("run"), F.col("user_id").cast("string").alias("entity"), (k % 2).cast("string").alias("family"), (k % 3).cast("int").alias("priority"), F.get(F.array(*map(F.lit, LABELS)), (k % 3).cast("int")).alias("label"),
        F.lpad(k.cast("string"), 20, "0").alias("query"), F.col("ts").cast("timestamp").alias("at"), F.when(kind.isin("click", "view"), F.array(entry)).otherwise(none).alias("entries"), F.when(kind == "error", F.col("props")).otherwise("").alias("error"),
    )


ANSWERS = f"""a AS (SELECT ts::DATE::VARCHAR AS run, user_id::VARCHAR AS entity, (event_id % 2)::VARCHAR AS family, (event_id % 3)::INT AS priority, [{", ".join(f"'{x}'" for x in LABELS)}][(event_id % 3 + 1)::INT] AS label, lpad(event_id::VARCHAR, 20, '0') AS query, ts,
  event_type IN ('click', 'view') AS filled, CASE WHEN filled THEN event_type || props ELSE '' END AS found, CASE WHEN event_type = 'error' THEN props ELSE '' END AS error FROM events),
v AS (SELECT *, min(ts) OVER (PARTITION BY run, entity, family) AS first_at FROM a QUALIFY row_number() OVER (PARTITION BY run, entity, family, priority ORDER BY ts, query) = 1),
o AS (SELECT * FROM v WHERE ts <= first_at + INTERVAL {WAIT_H} HOUR), w AS (SELECT *, min(priority) FILTER (filled) OVER (PARTITION BY run, entity, family) AS won FROM o), t AS (SELECT *, max(priority) OVER (PARTITION BY run, entity, family) AS last FROM w WHERE won IS NULL OR priority <= won)"""


@book.query(
    f"""WITH {ANSWERS} SELECT run, entity, family, epoch_us(any_value(first_at)) AS first_us, any_value(won)::INT AS priority, coalesce(max(query) FILTER (priority = won), '') AS query, coalesce(max(found) FILTER (priority = won), '') AS found, count(*)::INT AS n_tried,
  array_to_string(list_concat(coalesce(list(label || ' query failed; trying fallback' ORDER BY priority) FILTER (error <> '' AND priority < last), []), CASE WHEN any_value(won) > 0 THEN ['used ' || max(label) FILTER (priority = won) || ' query fallback'] ELSE [] END), '; ') AS warnings,
  CASE WHEN any_value(won) IS NULL THEN coalesce(arg_max(error, priority) FILTER (error <> ''), '') ELSE '' END AS error FROM t GROUP BY run, entity, family"""
)
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events saved as answers in segments; a stream takes the first half, is stopped, and goes on with the rest."""
    at = new_dir(spark, "streamed")
    rows = event_answers(spark, sf_dir)
    least, most = rows.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    parts = spark.sparkContext.defaultParallelism
    middle = None if least is None else (least + most) // 2
    stream = ST.first_answers_stream(SA.parsed(SA.read_lines(spark, f"{at}/saved", stream=True)), WAIT_H * 3600)
    early = F.unix_micros("at") < middle
    done = 0
    for half in (rows.filter(early), rows.filter(~early)):
        done = SA.append(half.repartitionByRange(parts, "at").sortWithinPartitions("at"), f"{at}/saved", done)
        if done > parts:
            # an answer without an entity moves the clock on, so that the last searches end
            tick = spark.range(1).select(*[F.lit("").alias(n) for n in ("run", "entity", "family", "label", "query", "error")], F.lit(0).alias("priority"), F.timestamp_micros(F.lit((most or 0) + 2 * WAIT_H * 3_600_000_000)).alias("at"), F.array().cast(SA.ENTRIES).alias("entries"))
            done = SA.append(tick, f"{at}/saved", done)
        ST.run_available(stream, f"{at}/out", f"{at}/checkpoint")
    out = spark.read.schema(stream.schema).parquet(f"{at}/out")
    found = F.get(F.transform("entries", lambda e: F.concat(e.title, e.body)), F.lit(0))
    return out.select("run", "entity", "family", F.unix_micros("first_at").alias("first_us"), "priority", "query", F.coalesce(found, F.lit("")).alias("found"), F.size("attempts").alias("n_tried"), F.array_join("warnings", "; ").alias("warnings"), "error")
