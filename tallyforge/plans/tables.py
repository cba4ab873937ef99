"""Queries over sources, dedupe, staleness, coverage and metadata signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.fixed import DOCUMENT_NAMES
from tallyforge.operators import tables as T
from tallyforge.plans.book import Book, table

book = Book()

SOURCES = "x AS (SELECT 0 AS src_prio, c_custkey AS pos, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN ' Mail' || (c_custkey % 50) || '@X.com ' ELSE '' END AS email, c_mktsegment AS firm FROM customer UNION ALL SELECT 1, s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'mail' || (s_suppkey % 50) || '@x.com' ELSE '' END, 'supply' FROM supplier)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, sf_dir, "customer").select(c.alias("pos"), F.col("c_name").alias("name"), F.when(c % 4 == 0, F.concat(F.lit(" Mail"), c % 50, F.lit("@X.com "))).otherwise("").alias("email"), F.col("c_mktsegment").alias("firm"))
    b = table(spark, sf_dir, "supplier").select(s.alias("pos"), F.col("s_name").alias("name"), F.when(s % 3 == 0, F.concat(F.lit("mail"), s % 50, F.lit("@x.com"))).otherwise("").alias("email"), F.lit("supply").alias("firm"))
    return T.in_order(a, b)


@book.query(f"WITH {SOURCES} SELECT * FROM x")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir)


@book.query(f"WITH {SOURCES}, k AS (SELECT *, CASE WHEN trim(email) <> '' THEN lower(trim(email)) ELSE lower(name) || '|' || lower(firm) END AS key FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src_prio, pos) AS n FROM k) SELECT src_prio, pos, name, email, firm FROM r WHERE n = 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_wins(sources(spark, sf_dir), T.identity_key(F.col("email"), F.col("name"), F.col("firm")), "src_prio", "pos")


@book.query("SELECT o_orderkey, CASE WHEN n > 1 THEN o_custkey || '__dup' || n ELSE o_custkey::VARCHAR END AS dup_id FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def dup_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "dup_id")


STALE = """c AS (SELECT doc_id, doc_id % 4 AS ns, md5(coalesce(text, '')) AS h, CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'x' || md5(coalesce(text, '')) ELSE md5(coalesce(text, '')) END AS old FROM documents),
s AS (SELECT doc_id, ns, h AS new_hash, CASE WHEN old IS NULL THEN 'missing_vector' WHEN old = '' THEN 'v1_no_hash' WHEN old <> h THEN 'text_changed' ELSE 'up_to_date' END AS reason FROM c)"""


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("ns"), "text")
    k, h = F.col("doc_id") % 10, F.md5(F.coalesce("text", F.lit("")))
    cache = texts.filter(k != 1).select("doc_id", F.when(k == 0, "").when(k == 2, F.concat(F.lit("x"), h)).otherwise(h).alias("old_hash"))
    return T.staleness(texts, cache, ["doc_id"])


@book.query(f"WITH {STALE} SELECT * FROM s")
def hash_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale(spark, sf_dir).select("doc_id", "ns", "new_hash", "reason")


@book.query(f"WITH {STALE} SELECT ns, 0::BIGINT AS force, count(*) FILTER (reason = 'missing_vector') AS missing_vector, count(*) FILTER (reason = 'v1_no_hash') AS v1_no_hash, count(*) FILTER (reason = 'text_changed') AS text_changed, count(*) FILTER (reason = 'up_to_date') AS up_to_date, count(*) AS total FROM s GROUP BY ns")
def staleness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stale_counts(stale(spark, sf_dir), "ns")


@book.query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'orphan' ELSE 'pushed' END AS outcome, quality FROM documents LEFT JOIN labels USING (doc_id)")
def cache_push_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    pushed = cache.join(known, "doc_id").select("doc_id", F.lit("pushed").alias("outcome"), "quality")
    return pushed.unionByName(cache.join(known, "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("outcome"), F.lit(None).cast("int").alias("quality")))


@book.query("SELECT count(*) AS total, count(quality) AS n_quality, count(CASE WHEN toxic = 1 THEN 1 END) AS n_toxic_hit, round(100.0::DOUBLE * count(quality) / count(*), 1) AS pct_quality, round(100.0::DOUBLE * count(CASE WHEN toxic = 1 THEN 1 END) / count(*), 1) AS pct_toxic_hit FROM documents LEFT JOIN labels USING (doc_id)")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("toxic_hit", F.when(F.col("toxic") == 1, 1))
    return T.coverage(rows, ["quality", "toxic_hit"])


@book.query("SELECT doc_id, (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (text IS NOT NULL)::INT AS n_indexed FROM documents LEFT JOIN labels USING (doc_id)")
def indexed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", sum((F.col(c).isNotNull().cast("int") for c in ("quality", "toxic", "text")), F.lit(0)).alias("n_indexed"))


META = """m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS company, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS day, CASE WHEN o_orderkey % 6 = 0 THEN 'Seed' ELSE '' END AS kind, CASE WHEN o_orderkey % 10 = 0 THEN '2.5' ELSE '' END AS size,
  CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 9)::VARCHAR ELSE '' END AS total, CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE '' END AS active, (o_orderkey % 3)::INT AS n12, CASE WHEN o_orderkey % 7 = 0 THEN 'Likely' ELSE '' END AS raising, CASE WHEN o_orderkey % 8 = 0 THEN 'https://p.com/' || o_orderkey ELSE '' END AS url FROM orders),
c AS (SELECT *, array_to_string(list_filter([CASE WHEN total <> '' THEN 'total investments: ' || total END, CASE WHEN active <> '' THEN 'active portfolio companies: ' || active END, CASE WHEN n12 <> 0 THEN 'investments past 12 months: ' || n12 END], lambda x: x IS NOT NULL), ' | ') AS counts FROM m),
s AS (SELECT k AS o_orderkey, 'pitchbook_activity' AS source_type, 'Most recent PitchBook investment' || CASE WHEN company <> '' THEN ' | company: ' || company ELSE '' END || CASE WHEN day <> '' THEN ' | date: ' || day ELSE '' END || CASE WHEN kind <> '' THEN ' | type: ' || kind ELSE '' END || CASE WHEN size <> '' THEN ' | size: ' || size ELSE '' END AS text, url AS source_url,
    CASE WHEN day <> '' THEN day ELSE '2002-06-01' END AS date, 0.85::DOUBLE AS confidence, 'public' AS visibility FROM c WHERE company <> '' OR day <> ''
  UNION ALL SELECT k, 'pitchbook_activity_count', 'PitchBook activity counts | ' || counts, url, '2002-06-01', 0.80, 'public' FROM c WHERE counts <> ''
  UNION ALL SELECT k, 'fundraising_status', 'PitchBook fundraising outlook: ' || raising, url, '2002-06-01', 0.75, 'public' FROM c WHERE raising <> '')"""


def metadata_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    meta = {
        "last_company": F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("nan"), "last_date": F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(""), "last_type": F.when(k % 6 == 0, " Seed "), "last_size": F.when(k % 10 == 0, "2.5").otherwise("null"),
        "total": F.when(k % 5 == 0, (k % 9).cast("string")).otherwise("None"), "five_years": F.lit(None).cast("string"), "two_years": F.lit(""), "active": F.when(k % 2 == 0, "7"), "fundraising": F.when(k % 7 == 0, "Likely").otherwise("None"), "url": F.when(k % 8 == 0, F.concat(F.lit("https://p.com/"), k)),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(T.metadata_signals(meta, (k % 3).cast("int"), "2002-06-01")))


@book.query(f"WITH {META} SELECT * FROM s")
def signals_from_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_signals(spark, sf_dir)


@book.query(f"WITH {META} SELECT source_type, count(*) AS n, count(DISTINCT o_orderkey) AS n_orders FROM s GROUP BY source_type")
def signal_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_signals(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_orders"))


@book.query("SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id + 1000000, 'view', value * 2 FROM events WHERE event_type = 'view'")
def signals_merge_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    made = e.filter("event_type = 'view'").select((F.col("event_id") + 1000000).alias("event_id"), "event_type", (F.col("value") * 2).alias("value"))
    return T.replace_kinds(e, made, "event_type", ["click", "view"])


@book.query("SELECT o_orderkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN o_orderkey % {i + 2} = 0 THEN '{n}' END" for i, n in enumerate(DOCUMENT_NAMES)) + "], lambda x: x IS NOT NULL), ',') AS missing FROM orders")
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.when(F.col("o_orderkey") % (i + 2) == 0, "missing").otherwise("uploaded").alias(n) for i, n in enumerate(DOCUMENT_NAMES)])
    return rows.select("o_orderkey", F.array_join(T.missing(DOCUMENT_NAMES), ",").alias("missing"))


@book.query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT BETWEEN 10 AND 19")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k BETWEEN 10 AND 19")


@book.query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value::DECIMAL(20, 6))::DOUBLE, 4) AS total FROM events GROUP BY event_type")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum(F.col("value").cast("decimal(20,6)")).cast("double"), 4).alias("total"))
