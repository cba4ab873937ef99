"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.vectors import cosine
from tallyforge.operators import vectors as V
from tallyforge.plans.book import Book, spread, table

book = Book()

DOT = "round(greatest(0.0, least(1.0, list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)))), 6)"
SCORED = f"s AS (SELECT e.*, {DOT.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return V.score_against(e, e.filter("vec_id = 0").select(F.col("embedding").alias("q")))


@book.query(f"WITH {SCORED} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(scored(spark, sf_dir).select("vec_id", "score"), 20, "vec_id")


@book.query(f"WITH {SCORED} SELECT vec_id, label, score FROM s WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).filter(V.metadata_matches({"label": [1, 3, 5]}))
    return V.top_k(rows.select("vec_id", "label", "score"), 20, "vec_id")


@book.query(f"WITH {SCORED}, r AS (SELECT vec_id % 4 AS ns, vec_id, score, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT ns, vec_id, score, rank FROM r WHERE rank <= 10")
def vector_topk_per_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select((F.col("vec_id") % 4).alias("ns"), "vec_id", "score")
    return V.top_k_by(rows, 10, ["ns"], "vec_id")


@book.query(
    f"""WITH {SCORED},
r AS (SELECT c_custkey, ns, score, row_number() OVER (PARTITION BY ns ORDER BY score DESC, c_custkey) AS rank
      FROM (SELECT c_custkey, unnest([0, 1, 2, 3]) AS ns FROM customer) c JOIN s ON s.vec_id = (c.c_custkey * 4 + c.ns) % (SELECT count(*) FROM embeddings)),
b AS (SELECT c_custkey, coalesce(max(score) FILTER (ns = 0), 0) AS fund_thesis, coalesce(max(score) FILTER (ns = 1), 0) AS partner_bio,
        coalesce(max(score) FILTER (ns = 2), 0) AS portfolio, coalesce(max(score) FILTER (ns = 3), 0) AS activity FROM r WHERE rank <= 200 GROUP BY c_custkey)
SELECT c.c_custkey, coalesce(fund_thesis, 0)::DOUBLE AS fund_thesis, coalesce(partner_bio, 0)::DOUBLE AS partner_bio, coalesce(portfolio, 0)::DOUBLE AS portfolio,
  coalesce(activity, 0)::DOUBLE AS activity, round(0.35 * coalesce(fund_thesis, 0)::DOUBLE + 0.30 * coalesce(partner_bio, 0)::DOUBLE + 0.15 * coalesce(portfolio, 0)::DOUBLE + 0.20 * coalesce(activity, 0)::DOUBLE, 6) AS vector_score
FROM customer c LEFT JOIN b USING (c_custkey)"""
)
def vector_late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, table(spark, sf_dir, "customer"), 200)


def fused(spark: SparkSession, sf_dir: str, customers: DataFrame, k: int) -> DataFrame:
    """Fused vector scores of customers whose namespace vectors are dealt by key."""
    s = scored(spark, sf_dir).select("vec_id", "score")
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("namespace")) for i, x in enumerate(("fund_thesis", "partner_bio", "portfolio", "activity"))])
    each = customers.select("c_custkey", F.explode(names).alias("x")).crossJoin(F.broadcast(n)).select("c_custkey", "x.namespace", F.pmod(F.col("c_custkey") * 4 + F.col("x.i"), F.col("n")).alias("vec_id"))
    hits = V.top_k_by(each.join(s, "vec_id"), k, ["namespace"], "c_custkey")
    return V.late_fusion(hits, customers, "c_custkey")


@book.query(
    """SELECT vec_id, label, 1 AS version FROM embeddings WHERE vec_id % 5 = 0
UNION ALL SELECT vec_id, label, 0 FROM embeddings WHERE vec_id % 5 <> 0"""
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return V.upsert(e.withColumn("version", F.lit(0)), e.filter("vec_id % 5 = 0").withColumn("version", F.lit(1)), ["vec_id"])


@book.query(
    """WITH d AS (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS d,
  sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT vec_id, round(greatest(0.0, least(1.0, d / n)), 6) AS score FROM d ORDER BY score DESC, vec_id LIMIT 50"""
)
def vector_true_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    s = V.score_against(e, e.filter("vec_id = 0").select(F.col("embedding").alias("q")), cosine)
    return V.top_k(s.select("vec_id", "score"), 50, "vec_id")


@book.query("SELECT label, max(vec_id) AS vec_id, count(*) AS n FROM embeddings GROUP BY label")
def vector_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return V.last_wins(e, ["label"], "vec_id").join(e.groupBy("label").agg(F.count("*").alias("n")), "label")


@book.query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_#+.-]+')) AS token FROM documents),
u AS (SELECT doc_id, token, count(*) AS n, sha256(token) AS h FROM t GROUP BY ALL),
e AS (SELECT doc_id, (('0x' || h[1:8])::BIGINT % 96) AS i, (CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) * (1.0 + length(token) / 20.0) * n AS x FROM u),
c AS (SELECT doc_id, i, sum(x::DECIMAL(20, 6))::DOUBLE AS x FROM e GROUP BY ALL)
SELECT doc_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM c QUALIFY x <> 0"""
)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hash_embedding(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
