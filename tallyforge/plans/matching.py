"""Queries over the matching operators. Customers stand for investors, their orders for investments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.functions.dates import recency_score
from tallyforge.functions.fixed import INDUSTRY_NEEDLES
from tallyforge.functions.text import geography_matches, strings, tag_terms, tokens
from tallyforge.operators import matching as M
from tallyforge.plans.book import Book, quoted, sql_any, table
from tallyforge.plans.vectors import SCORED, fused

book = Book()
DEAL = M.Profile(industry="BUILDING", stage="series_a", geography=("america",), raise_amount=100_000_000.0, terms=("building",))
AS_OF = "DATE '2002-06-01'"
PROFILE_TERMS = ("BUILDING", "HOUSEHOLD")

INVESTORS = f"""o AS (SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi, max(o_orderdate)::DATE AS last_date,
    count(*) FILTER (o_orderdate::DATE > {AS_OF} - INTERVAL 365 DAY) AS n12 FROM orders GROUP BY o_custkey),
inv AS (SELECT c_custkey, c_name, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN ['global'] ELSE [lower(n_name), lower(r_name)] END AS geography,
    coalesce(lo, 0.0) AS check_min, coalesce(hi, 0.0) AS check_max, last_date, coalesce(n12, 0)::BIGINT AS count_12m,
    CASE WHEN c_acctbal < -500 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN c_custkey % 11 = 0 THEN [c_mktsegment] ELSE [] END AS exclusions,
    CASE c_custkey % 4 WHEN 0 THEN ['seed'] WHEN 1 THEN ['series_a'] WHEN 2 THEN ['seed', 'series_a'] ELSE ['growth'] END AS stage_focus,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN ['crypto'] ELSE [] END AS thesis_terms,
    (c_acctbal + 1000) / 11000 AS quality, (c_custkey % 5)::INT AS n_companies, list_transform(range(c_custkey % 5), lambda i: CASE WHEN (i + c_custkey) % 3 = 0 THEN 'Building Works ' ELSE 'Trading ' END || i) AS companies,
    len(list_filter(range(c_custkey % 5), lambda i: (i + c_custkey) % 3 = 0)) AS portfolio_hits, (CASE WHEN c_custkey % 49 = 0 THEN 2 WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END)::INT AS warm_paths,
    c_mktsegment AS focus
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey),
g AS (SELECT *, len(list_filter(geography, lambda x: contains('global|america|united states', x))) > 0 OR list_contains(geography, 'united states') AS geo_ok FROM inv),
elig AS (SELECT *, CASE WHEN status <> 'active' THEN 'inactive_fund' WHEN len(exclusions) > 0 AND lower(exclusions[1]) = 'building' THEN 'sector_exclusion'
    WHEN NOT (list_contains(stage_focus, 'series_a') OR list_contains(stage_focus, 'seed')) THEN 'stage_mismatch'
    WHEN check_max > 0 AND check_max < 250000 THEN 'check_size_too_small' WHEN NOT geo_ok THEN 'geography_mismatch'
    WHEN {AS_OF} - last_date > 1460 THEN 'dormant_fund' WHEN list_contains(thesis_terms, 'crypto') THEN 'crypto_sector_mismatch' END AS reject_reason FROM g)"""


def investors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.max(F.col("o_orderdate").cast("date")).alias("last_date"), F.count_if(F.col("o_orderdate").cast("date") > F.date_sub(DEAL.date, 365)).alias("n12")
    )
    key = F.col("c_custkey")
    several = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda i: i < key % 5)
    companies = F.transform(several, lambda i: F.concat(F.when((i + key) % 3 == 0, "Building Works ").otherwise("Trading "), i))
    stages = F.when(key % 4 == 0, strings(["seed"])).when(key % 4 == 1, strings(["series_a"])).when(key % 4 == 2, strings(["seed", "series_a"])).otherwise(strings(["growth"]))
    return (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
        .join(orders, "c_custkey", "left")
        .select(
            "c_custkey", "c_name", F.col("c_mktsegment").alias("segment"),
            F.when(key % 3 == 0, strings(["global"])).otherwise(F.array(F.lower("n_name"), F.lower("r_name"))).alias("geography"),
            F.coalesce("lo", F.lit(0.0)).alias("check_min"), F.coalesce("hi", F.lit(0.0)).alias("check_max"), "last_date", F.coalesce("n12", F.lit(0)).alias("count_12m"),
            F.when(F.col("c_acctbal") < -500, "inactive").otherwise("active").alias("status"),
            F.when(key % 11 == 0, F.array("c_mktsegment")).otherwise(strings([])).alias("exclusions"),
            stages.alias("stage_focus"), F.when(F.col("c_mktsegment") == "FURNITURE", strings(["crypto"])).otherwise(strings([])).alias("thesis_terms"),
            ((F.col("c_acctbal") + 1000) / 11000).alias("quality"), (key % 5).cast("int").alias("n_companies"), companies.alias("companies"), M.portfolio_hits(DEAL, companies).alias("portfolio_hits"),
            F.when(key % 49 == 0, 2).when(key % 7 == 0, 1).otherwise(0).alias("warm_paths"), F.array("c_mktsegment").alias("industry_focus"),
        )
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investors(spark, sf_dir).withColumn("reject_reason", M.reject_reason(DEAL))


@book.query(f"WITH {INVESTORS} SELECT c_custkey, reject_reason FROM elig")
def hard_filter_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("c_custkey", "reject_reason")


@book.query(f"WITH {INVESTORS} SELECT coalesce(reject_reason, 'eligible') AS outcome, count(*) AS n FROM elig GROUP BY 1")
def reject_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy(F.coalesce("reject_reason", F.lit("eligible")).alias("outcome")).agg(F.count("*").alias("n"))


@book.query(f"WITH {INVESTORS} SELECT c_custkey, geo_ok AS geo_match FROM g")
def geo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investors(spark, sf_dir).select("c_custkey", geography_matches(strings(DEAL.geography), F.col("geography")).alias("geo_match"))


TIER = "CASE WHEN {d} IS NULL THEN 0.5 WHEN {a} - {d} < 90 THEN 1.0 WHEN {a} - {d} < 365 THEN 0.7 WHEN {a} - {d} < 730 THEN 0.4 WHEN {a} - {d} < 1095 THEN 0.2 ELSE 0.05 END::DOUBLE"


@book.query(f"WITH o AS (SELECT o_custkey, max(o_orderdate)::DATE AS d FROM orders GROUP BY 1) SELECT c_custkey, d AS last_date, {TIER.format(d='d', a=chr(68) + 'ATE ' + chr(39) + '2001-08-02' + chr(39))} AS recency FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def recency_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last_date"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "last_date", recency_score(F.col("last_date"), F.lit("2001-08-02").cast("date")).alias("recency"))


CHECK = "CASE WHEN check_max <= 0 THEN 0.5 WHEN check_max < 250000 THEN 0.0 WHEN check_min > 100000000 THEN 0.2 WHEN (check_min + check_max) / 2 <= 100000000 THEN 1.0 ELSE 0.8 END::DOUBLE"


@book.query(f"WITH {INVESTORS} SELECT c_custkey, {CHECK} AS check_fit FROM inv")
def check_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investors(spark, sf_dir).select("c_custkey", M.check_fit(DEAL, F.col("check_min"), F.col("check_max")).alias("check_fit"))


# ---- text scores: documents stand for theses, the first benchmark item for the deal's text

STOP = "['the', 'and', 'for', 'with', 'this', 'that', 'from', 'into', 'are', 'is', 'in', 'of', 'to', 'a', 'an']"
TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-zA-Z0-9_+#.-]+'), lambda x: length(x) > 2 AND NOT list_contains(" + STOP + ", x)))"
KEYWORDS = f"kw AS (SELECT doc_id, CASE WHEN len(c) = 0 THEN 0.0 ELSE least(1.0, len(list_intersect(q, c)) / greatest(6, len(q))::DOUBLE) END::DOUBLE AS keyword_score, len(c) AS n_tokens FROM (SELECT doc_id, {TOKENS.format(t='text')} AS c FROM documents) d, (SELECT {TOKENS.format(t='text')} AS q FROM benchmark WHERE item_id = 0) b)"


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").filter("item_id = 0").select(tokens(F.col("text")).alias("q")).limit(1)
    own = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("c"))
    return own.crossJoin(F.broadcast(q)).select("doc_id", M.keyword_score(F.col("q"), F.col("c")).alias("keyword_score"), F.size("c").cast("long").alias("n_tokens"))


@book.query(f"WITH {KEYWORDS} SELECT * FROM kw")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_scores(spark, sf_dir)


@book.query(f"SELECT doc_id, array_to_string(list_sort({TOKENS.format(t='text')}), ' ') AS tokens FROM documents")
def tokenize_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tokens(F.col("text"))), " ").alias("tokens"))


def _tags(text: str) -> str:
    padded = f"(' ' || lower(coalesce({text}, '')) || ' ')"
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_any(padded, words)} THEN '{label}' END" for label, words in INDUSTRY_NEEDLES.items()) + "], lambda x: x IS NOT NULL)"


@book.query(f"SELECT doc_id, array_to_string({_tags('text')}, ',') AS terms FROM documents")
def term_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tag_terms(F.col("text"), INDUSTRY_NEEDLES), ",").alias("terms"))


@book.query("SELECT p_partkey, array_to_string(" + _tags("p_name || ' ' || p_type || CASE p_partkey % 4 WHEN 0 THEN ' fintech payments' WHEN 1 THEN ' ai tools and solar' ELSE '' END") + ", ',') AS terms FROM part")
def industry_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.when(k == 0, " fintech payments").when(k == 1, " ai tools and solar").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tag_terms(text, INDUSTRY_NEEDLES), ",").alias("terms"))


# terms of an investor: its segment, BUILDING for even keys, MACHINERY for every fifth
TERMS = "list_distinct(list_filter([segment, CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' END, CASE WHEN c_custkey % 5 = 0 THEN 'MACHINERY' END], lambda x: x IS NOT NULL))"
ALIGN = f"""al AS (SELECT c_custkey, CASE WHEN segment NOT IN ('BUILDING', 'HOUSEHOLD') AND c_custkey % 3 = 0 THEN 0.0 WHEN n = 0 THEN 0.0
  ELSE least(1.0, 0.20 + 0.60 * n / 2.0 + 0.20 * n / m::DOUBLE) END::DOUBLE AS industry_score
  FROM (SELECT c_custkey, c_mktsegment AS segment, len({TERMS.replace('segment', 'c_mktsegment')}) AS m, len(list_filter({TERMS.replace('segment', 'c_mktsegment')}, lambda x: x IN ('BUILDING', 'HOUSEHOLD'))) AS n FROM customer))"""


def aligned(c: DataFrame, segment: str) -> DataFrame:
    k = F.col("c_custkey")
    terms = F.array_distinct(F.array_compact(F.array(F.col(segment), F.when(k % 2 == 0, "BUILDING"), F.when(k % 5 == 0, "MACHINERY"))))
    focus = F.when(k % 3 == 0, F.array(segment)).otherwise(strings([]))
    return c.withColumn("industry_score", M.industry_alignment(strings(PROFILE_TERMS), focus, terms))


@book.query(f"WITH {ALIGN} SELECT c_custkey, round(industry_score, 6) AS industry_score FROM al")
def industry_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "customer"), "c_mktsegment").select("c_custkey", F.round("industry_score", 6).alias("industry_score"))


# ---- the whole match

FUSED = f"""{SCORED},
vr AS (SELECT c_custkey, ns, score, row_number() OVER (PARTITION BY ns ORDER BY score DESC, c_custkey) AS vrank
  FROM (SELECT c_custkey, unnest([0, 1, 2, 3]) AS ns FROM elig WHERE reject_reason IS NULL) c JOIN s ON s.vec_id = (c.c_custkey * 4 + c.ns) % (SELECT count(*) FROM embeddings)),
vs AS (SELECT c_custkey, round(0.35 * coalesce(max(score) FILTER (ns = 0), 0)::DOUBLE + 0.30 * coalesce(max(score) FILTER (ns = 1), 0)::DOUBLE + 0.15 * coalesce(max(score) FILTER (ns = 2), 0)::DOUBLE + 0.20 * coalesce(max(score) FILTER (ns = 3), 0)::DOUBLE, 6) AS vector_score
  FROM vr WHERE vrank <= 300 GROUP BY c_custkey)"""
FEATURES = f"""{INVESTORS}, {FUSED}, {KEYWORDS}, {ALIGN},
base AS (SELECT e.*, coalesce(vector_score, 0.0)::DOUBLE AS vector_score, coalesce(keyword_score, 0.0)::DOUBLE AS keyword_score, industry_score
  FROM elig e LEFT JOIN vs USING (c_custkey) LEFT JOIN kw ON kw.doc_id = e.c_custkey % (SELECT count(*) FROM documents) JOIN al USING (c_custkey) WHERE reject_reason IS NULL),
f AS (SELECT *, least(1.0, greatest(0.15, industry_score) * greatest(0.8 * vector_score + 0.2 * keyword_score, 0.75 * industry_score + 0.25 * keyword_score)) AS semantic_fit,
    CASE WHEN list_contains(stage_focus, 'series_a') THEN 1.0 WHEN list_contains(stage_focus, 'seed') THEN 0.7 ELSE 0.3 END::DOUBLE AS stage_fit, {CHECK} AS check_fit,
    least(1.0, 0.6 * {TIER.format(d='last_date', a=AS_OF)} + least(0.4, 0.1 * count_12m))::DOUBLE AS recent_activity,
    CASE WHEN n_companies = 0 THEN 0.2 ELSE least(1.0, 0.3 + 0.25 * portfolio_hits) END::DOUBLE AS portfolio_adjacency, CASE WHEN geo_ok THEN 1.0 ELSE 0.5 END::DOUBLE AS geography_fit,
    CASE WHEN warm_paths = 0 THEN 0.0 ELSE least(1.0, 0.4 + 0.3 * warm_paths) END::DOUBLE AS warm_intro_score, greatest(0.0, least(1.0, quality))::DOUBLE AS data_quality_confidence FROM base),
fin AS (SELECT *, round(greatest(0.0, least(1.0, 0.35 * semantic_fit + 0.20 * (stage_fit + check_fit) / 2 + 0.20 * recent_activity + 0.10 * portfolio_adjacency + 0.05 * geography_fit + 0.05 * warm_intro_score + 0.05 * data_quality_confidence)), 6)::DOUBLE AS score FROM f)"""
NAMES = ["semantic_fit", "stage_fit", "check_fit", "recent_activity", "portfolio_adjacency", "geography_fit", "warm_intro_score", "data_quality_confidence"]


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = judged(spark, sf_dir).filter("reject_reason IS NULL")
    vectors = fused(spark, sf_dir, eligible, 300).select("c_custkey", "vector_score")
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    words = keyword_scores(spark, sf_dir).select("doc_id", "keyword_score")
    rows = eligible.join(vectors, "c_custkey", "left").crossJoin(F.broadcast(n_docs)).withColumn("doc_id", F.pmod("c_custkey", "n_docs")).join(words, "doc_id", "left")
    rows = rows.withColumn("vector_score", F.coalesce("vector_score", F.lit(0.0))).withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    return M.features(aligned(rows, "segment"), DEAL).withColumn("score", F.round(M.final_score(), 6))


@book.query(f"WITH {FEATURES} SELECT c_custkey, " + ", ".join(f"round({n}, 6) AS {n}" for n in NAMES) + " FROM fin")
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("c_custkey", *[F.round(n, 6).alias(n) for n in NAMES])


@book.query(f"WITH {FEATURES} SELECT c_custkey, score FROM fin")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("c_custkey", "score")


SHORT = """short AS (SELECT c_custkey FROM (SELECT c_custkey FROM fin ORDER BY vector_score DESC, c_custkey LIMIT 60) UNION SELECT c_custkey FROM (SELECT c_custkey FROM fin ORDER BY keyword_score DESC, c_custkey LIMIT 60)
  UNION SELECT c_custkey FROM (SELECT c_custkey FROM fin ORDER BY industry_score DESC, c_custkey LIMIT 60) UNION SELECT c_custkey FROM fin WHERE warm_paths > 0)"""


@book.query(f"WITH {FEATURES}, {SHORT} SELECT c_custkey FROM short")
def stage2_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shortlist(featured(spark, sf_dir), "c_custkey", 20)


@book.query(f"WITH {FEATURES}, {SHORT} SELECT row_number() OVER (ORDER BY score DESC, c_custkey)::INT AS rank, c_custkey, c_name, score, round(semantic_fit, 6) AS semantic_fit, round(recent_activity, 6) AS recent_activity FROM fin SEMI JOIN short USING (c_custkey) ORDER BY score DESC, c_custkey LIMIT 20")
def hybrid_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = featured(spark, sf_dir).select("c_custkey", "c_name", "score", "vector_score", "keyword_score", "industry_score", "warm_paths", "semantic_fit", "recent_activity")
    return M.ranked(M.shortlisted(rows, "c_custkey", 20), "c_custkey", 20).select("rank", "c_custkey", "c_name", "score", F.round("semantic_fit", 6).alias("semantic_fit"), F.round("recent_activity", 6).alias("recent_activity"))


def _amount(x: str) -> str:
    return f"(CASE WHEN {x} >= 1e6 THEN '$' || printf('%.1f', {x} / 1e6) || 'M' ELSE '$' || printf('%.0f', {x} / 1e3) || 'K' END)"


THESES = ["", "We back building companies across the country. Short one.", "Infrastructure for developer teams is our main focus! Other.", "We like saas application makers. Nothing else matters here"]
DESCRIBED = f"""d AS (SELECT *, [{quoted(THESES)}][(c_custkey % 4 + 1)::INT] AS thesis, CASE WHEN c_custkey % 2 = 0 THEN c_name || '@x.com' ELSE '' END AS email, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'in/' || c_custkey END AS linkedin,
  CASE c_custkey % 3 WHEN 0 THEN [{{'k': 'pitchbook_activity', 't': 'Most recent | company: Acme Co | x', 'd': '2002-05-01'}}] WHEN 1 THEN [{{'k': 'google_news', 't': 'n', 'd': ''}}, {{'k': 'pitchbook_activity', 't': 'no name here', 'd': '2002-04-02'}}] ELSE [] END AS signals FROM fin),
n AS (SELECT *, list_filter(list_transform(string_split_regex(thesis, '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 20 AND contains(lower(x), 'building'))[1] AS rel, list_filter(companies, lambda x: contains(lower(x), 'building')) AS near,
  list_filter(signals, lambda x: x.k = 'pitchbook_activity' AND x.d <> '')[1] AS deal FROM d)"""


def described(rows: DataFrame) -> DataFrame:
    """rows with the texts, contacts, signals and paths that an explanation tells of."""
    k = F.col("c_custkey")
    sig = "array<struct<source_type:string,text:string,source_url:string,date:string,confidence:double>>"

    def one(kind: str, text: str, day: str) -> F.Column:
        return F.struct(F.lit(kind).alias("source_type"), F.lit(text).alias("text"), F.lit("").alias("source_url"), F.lit(day).alias("date"), F.lit(0.8).alias("confidence"))

    signals = F.when(k % 3 == 0, F.array(one("pitchbook_activity", "Most recent | company: Acme Co | x", "2002-05-01"))).when(k % 3 == 1, F.array(one("google_news", "n", ""), one("pitchbook_activity", "no name here", "2002-04-02"))).otherwise(F.array().cast(sig))
    warm = F.transform(F.filter(F.sequence(F.lit(1), F.lit(2)), lambda i: i <= F.col("warm_paths")), lambda i: F.concat(F.lit("Warm path "), i))
    return rows.withColumns({"investment_thesis": F.get(F.array(*map(F.lit, THESES)), (k % 4).cast("int")), "email": F.when(k % 2 == 0, F.concat("c_name", F.lit("@x.com"))).otherwise(""), "linkedin_url": F.when(k % 5 != 0, F.concat(F.lit("in/"), k)), "signals": signals, "warm": warm})


@book.query(
    f"""WITH {FEATURES}, {DESCRIBED},
r AS (SELECT *, list_filter([CASE WHEN semantic_fit >= 0.5 AND thesis <> '' THEN CASE WHEN rel IS NOT NULL THEN 'Thesis: "' || trim(substr(rel, 1, 130)) || '"' ELSE 'Fund sector focus: ' || focus END WHEN semantic_fit >= 0.25 THEN 'Sector overlap: ' || focus END,
  CASE WHEN stage_fit >= 0.9 THEN 'Invests at series a stage (' || replace(array_to_string(stage_focus, ', '), '_', ' ') || ')' END,
  CASE WHEN check_fit >= 0.9 AND check_max > 0 THEN 'Cheque range ' || CASE WHEN check_min > 0 THEN {_amount('check_min')} ELSE 'open' END || '–' || {_amount('check_max')} || ' fits a $' || {_amount('100000000.0')} || ' raise' END,
  CASE WHEN portfolio_adjacency >= 0.55 AND len(companies) > 0 THEN CASE WHEN len(near) > 0 THEN 'Portfolio includes adjacent bets: ' || array_to_string(near[1:3], ', ') ELSE 'Portfolio of ' || len(companies) || ' companies shows sector exposure' END END,
  CASE WHEN recent_activity >= 0.7 THEN CASE WHEN count_12m > 0 THEN 'Actively deploying: ' || count_12m || ' deals in last 12 months' WHEN contains(deal.t, 'company:') THEN 'Recent investment: Acme Co (' || deal.d[1:7] || ')' WHEN deal IS NOT NULL THEN 'Recent investment activity recorded (' || deal.d[1:7] || ')' END END,
  CASE WHEN geography_fit >= 1.0 THEN 'Geographic focus includes ' || coalesce(list_filter(geography, lambda g: contains(lower(g), 'america') OR contains('america', lower(g)))[1], geography[1]) END, CASE WHEN warm_paths > 0 THEN 'Warm path 1' END], lambda x: x IS NOT NULL) AS l FROM n)
SELECT c_custkey, CASE WHEN len(l) > 0 THEN array_to_string(l[1:5], '; ') ELSE 'Passed eligibility filters; borderline fit — review manually' END AS reasons,
  array_to_string(list_filter([CASE WHEN data_quality_confidence < 0.75 THEN 'Data confidence moderate — verify before outreach' END, CASE WHEN email = '' THEN 'No email on file — research required' END, CASE WHEN linkedin IS NULL THEN 'No LinkedIn URL — verify identity before contacting' END], lambda x: x IS NOT NULL), '; ') AS warnings,
  CASE WHEN contains(lower(thesis), 'infrastructure') OR contains(lower(thesis), 'developer') THEN 'deep_tech' WHEN contains(lower(thesis), 'application') OR contains(lower(thesis), 'saas') THEN 'software' WHEN warm_paths > 0 THEN 'warm_network' ELSE 'general_early_stage' END AS segment,
  array_to_string(list_transform(signals, lambda x: x.k || '@' || x.d), ',') AS provenance FROM r"""
)
def match_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = described(featured(spark, sf_dir)).select("c_custkey", M.explanation(DEAL).alias("e"))
    found = F.array_join(F.transform("e.source_provenance", lambda x: F.concat(x.source_type, F.lit("@"), x.date)), ",")
    return rows.select("c_custkey", F.array_join("e.reasons", "; ").alias("reasons"), F.array_join("e.warnings", "; ").alias("warnings"), F.col("e.match_segment").alias("segment"), found.alias("provenance"))


@book.query(
    f"""WITH {FEATURES}, {SHORT}
SELECT (SELECT count(*) FROM inv) AS n_candidates, (SELECT count(*) FROM fin) AS n_eligible, (SELECT count(*) FROM elig WHERE reject_reason IS NOT NULL) AS n_rejected, (SELECT count(*) FROM short) AS n_shortlist, (SELECT least(20, count(*)) FROM short) AS n_ranked"""
)
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = judged(spark, sf_dir).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("reject_reason").isNull()).alias("n_eligible"), F.count("reject_reason").alias("n_rejected"))
    short = M.shortlist(featured(spark, sf_dir), "c_custkey", 20)
    ranked = short.groupBy(M.canonical(F.col("c_custkey")).alias("c")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_shortlist"), F.least(F.lit(20), F.count("*")).alias("n_ranked"))
    return counts.crossJoin(ranked)  # one row each


@book.query(
    f"""WITH x AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '2001-05-06' WHEN 1 THEN 'nonsense' WHEN 2 THEN '' END AS stated, CASE WHEN c_custkey % 3 = 0 THEN DATE '2002-04-02' WHEN c_custkey % 3 = 1 THEN DATE '2002-05-01' END AS signalled FROM customer),
y AS (SELECT k, coalesce(CASE WHEN k % 4 = 0 THEN stated::DATE END, signalled) AS d FROM x) SELECT k AS c_custkey, d AS last_date, {TIER.format(d='d', a=AS_OF)} AS recency FROM y"""
)
def last_activity_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated date of the last investment, else the newest one of the activity signals."""
    k = F.col("c_custkey")

    def one(kind: str, day: str) -> F.Column:
        return F.struct(F.lit(kind).alias("source_type"), F.lit(day).alias("date"))

    a, b, c = one("pitchbook_activity", "02-Apr-2002"), one("pitchbook_activity", "2002/05/01"), one("google_news", "2002-05-30")
    signals = F.when(k % 3 == 0, F.array(a, c)).when(k % 3 == 1, F.array(a, b)).otherwise(F.array(c))
    stated = F.when(k % 4 == 0, "2001-05-06").when(k % 4 == 1, "nonsense").when(k % 4 == 2, "")
    rows = table(spark, sf_dir, "customer").select("c_custkey", M.last_activity(stated, signals).alias("last_date"))
    return rows.withColumn("recency", recency_score(F.col("last_date"), DEAL.date))


FOCUS = ["Fintech", "Retail", "Aerospace", ""]
NOTES = ["payments and lending", "we back solar power", "", "saas workflow", "medical devices"]


def _terms(text: str) -> str:
    return _tags(text)


@book.query(
    f"""WITH x AS (SELECT p_partkey, [{quoted(FOCUS)}][(p_partkey % 4 + 1)::INT] AS f, [{quoted(NOTES)}][(p_partkey % 5 + 1)::INT] || ' ' || p_type AS t FROM part),
y AS (SELECT p_partkey, ['fintech', 'consumer', 'enterprise_software'] AS p, {_terms('f')} AS focus, {_terms("(f || ' ' || t)")} AS own FROM x), z AS (SELECT *, len(list_intersect(own, p)) AS n FROM y)
SELECT p_partkey, CASE WHEN len(focus) > 0 AND NOT list_has_any(focus, p) THEN 0.0 WHEN len(own) = 0 THEN 0.5 WHEN n = 0 THEN 0.0 ELSE round(least(1.0, CASE WHEN len(own) > 6 THEN least(0.65, 0.2 + 0.6 * n / 3.0 + 0.2 * n / len(own)) ELSE 0.2 + 0.6 * n / 3.0 + 0.2 * n / len(own) END), 6) END::DOUBLE AS industry_score FROM z"""
)
def alignment_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well investors' focus and texts agree with a deal's industry and market, by tagged labels."""
    k = F.col("p_partkey")
    focus = F.get(F.array(*map(F.lit, FOCUS)), (k % 4).cast("int"))
    note = F.concat(F.get(F.array(*map(F.lit, NOTES)), (k % 5).cast("int")), F.lit(" "), "p_type")
    score = M.aligned_with_texts(F.lit("payments for retail stores"), "Fintech", F.array(focus), [note])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("industry_score"))


@book.query("WITH x AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '__dup' || (c_custkey % 5 + 2) ELSE '' END AS id, c_acctbal AS score FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal - 1 FROM customer WHERE c_custkey % 3 = 0) SELECT regexp_replace(id, '__dup\\d+$', '') AS canonical_id, max(score) AS score FROM x GROUP BY 1")
def canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    rows = c.select(F.when(k == 0, F.concat("c_name", F.lit("__dup"), F.col("c_custkey") % 5 + 2)).otherwise(F.col("c_name")).alias("id"), F.col("c_acctbal").alias("score")).unionByName(c.filter(k == 0).select(F.col("c_name").alias("id"), (F.col("c_acctbal") - 1).alias("score")))
    w = W.Window.partitionBy("canonical_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("canonical_id", M.canonical(F.col("id"))).withColumn("n", F.row_number().over(w)).filter("n = 1").select("canonical_id", "score")
