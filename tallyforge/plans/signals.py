"""Queries over the signal rubric. Customers stand for investors; counts come from orders and events, text from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.dates import recent_points
from tallyforge.functions.fixed import ACTIVITY_TERMS, FINTECH_EXPLICIT, FINTECH_WEAK, FUND_ACTIONS, FUND_TOPICS, HIRING_ROLES, HIRING_TERMS, INSTITUTIONAL_MARKERS, PORTFOLIO_MARKERS, PUBLIC_ACTIVITY, PUBLIC_MEDIUM, PUBLIC_STRONG, REPORT_COLUMNS, ROUND_TERMS, SECTOR_TERMS, STAGE_TERMS, US_TOKENS, VENTURE_MARKERS, WARM_PLACES
from tallyforge.operators import phrases as P
from tallyforge.operators import signals as S
from tallyforge.plans.book import Book, quoted, sql_any, sql_hits, table

book = Book()
AS_OF, AS_OF_SQL = "2001-06-01", "DATE '2001-06-01'"
NOTES = [
    "fintech seed fund, payments and lending; announced investment and led round, hiring an investment associate",
    "university endowment with banking and credit holdings; press release",
    "venture capital for startups in texas; portfolio announcement, backed by partners, raised new fund",
    "insurance and capital markets research, financial news",
    "industrial holdings in the midwest",
]
SITES = ["payments portfolio, invested in fintech round", "", "newsroom: led the round, funding", "careers: analyst job", "announced"]

BASE = f"""o AS (SELECT o_custkey, max(o_orderdate)::DATE AS last_date, count(*) FILTER ({AS_OF_SQL} - o_orderdate::DATE BETWEEN 0 AND 7) AS n7, count(*) FILTER ({AS_OF_SQL} - o_orderdate::DATE BETWEEN 0 AND 182) AS n6m,
    count(*) FILTER ({AS_OF_SQL} - o_orderdate::DATE BETWEEN 0 AND 365) AS n12m, min(o_totalprice) * 10 AS low, max(o_totalprice) * 10 AS high FROM orders WHERE o_orderdate::DATE <= {AS_OF_SQL} GROUP BY o_custkey),
b AS (SELECT c_custkey, c_name, [{quoted(NOTES)}][(c_custkey % 5 + 1)::INT] AS sheet, [{quoted(SITES)}][(c_custkey % 5 + 1)::INT] AS site, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(n_name) END AS place,
    last_date, ({AS_OF_SQL} - last_date) AS last_age, coalesce(n7, 0) AS n7, coalesce(n6m, 0) AS n6m, coalesce(n12m, 0) AS n12m, CASE WHEN c_custkey % 4 <> 1 THEN low END AS low, CASE WHEN c_custkey % 4 <> 2 THEN high END AS high,
    CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE (low + high) / 2 END AS middle, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 37 % 1500)::INT END AS close_age, c_custkey % 6 = 0 AS named, c_custkey % 8 = 0 AS flagged, CASE WHEN c_custkey % 5 = 2 THEN (c_custkey * 13 % 400)::INT END AS web_age
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey),
m AS (SELECT *, sheet || CASE WHEN site <> '' THEN ' ' || site ELSE '' END AS merged, {sql_any('sheet', INSTITUTIONAL_MARKERS)} AND NOT {sql_any('sheet', VENTURE_MARKERS)} AS inst FROM b)"""

ES, EM, WEAK = sql_hits("sheet", FINTECH_EXPLICIT), sql_hits("merged", FINTECH_EXPLICIT), sql_hits("merged", FINTECH_WEAK)
LESS = "CASE WHEN inst THEN 1 ELSE 0 END"
FIT = f"""fit AS (SELECT *, CASE WHEN {ES} >= 2 OR ({ES} >= 1 AND {EM} >= 3) THEN 3 - {LESS} WHEN {ES} >= 1 THEN 2 - {LESS} WHEN {EM} >= 1 THEN 1 WHEN {WEAK} >= 2 AND NOT inst THEN 1 ELSE 0 END AS sector,
  CASE WHEN {sql_any('merged', STAGE_TERMS['seed'])} THEN 2 - {LESS} WHEN {sql_any('merged', ['venture', 'angel', 'early'])} THEN 1 - {LESS} ELSE 0 END AS stage,
  CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN CASE WHEN 1e6 BETWEEN low AND high THEN 2 WHEN 1e6 < 0.35 * low OR 1e6 > 3.0 * high THEN 0 ELSE 1 END
    WHEN low IS NOT NULL AND 1e6 / low >= 0.35 THEN 1 WHEN high IS NOT NULL AND high / 1e6 BETWEEN 0.5 AND 3.0 THEN 1 WHEN high IS NOT NULL AND high / 1e6 < 0.5 THEN 0
    WHEN middle IS NOT NULL THEN CASE WHEN middle / 1e6 BETWEEN 0.6 AND 1.6 THEN 2 WHEN middle / 1e6 BETWEEN 0.25 AND 4.0 THEN 1 ELSE 0 END WHEN low IS NOT NULL OR high IS NOT NULL THEN 1 ELSE 0 END AS checks,
  {sql_any('place', US_TOKENS)}::INT AS geo,
  CASE WHEN {sql_hits('sheet', SECTOR_TERMS['fintech'])} >= 2 THEN 2 - {LESS} WHEN {sql_hits('sheet', SECTOR_TERMS['fintech'])} = 1 OR {sql_hits('merged', SECTOR_TERMS['fintech'])} >= 1 THEN 1 - {LESS} ELSE 0 END AS strategic FROM m)"""
LAST = "CASE WHEN last_age IS NULL THEN 0 WHEN last_age <= 90 THEN 3 WHEN last_age <= 180 THEN 2 WHEN last_age <= 365 THEN 1 ELSE 0 END"
INTENT = f"""it AS (SELECT *, CASE WHEN n7 >= 1 THEN 3 WHEN n6m >= 3 THEN 3 WHEN n6m >= 1 OR n12m >= 4 THEN 2 ELSE {LAST} END AS sh, coalesce(CASE WHEN web_age <= 90 THEN 2 WHEN web_age <= 365 THEN 1 ELSE 0 END, 0) AS wd FROM fit),
iw AS (SELECT *, CASE WHEN NOT {sql_any('site', ACTIVITY_TERMS)} THEN 0 WHEN wd = 0 AND {sql_hits('site', ROUND_TERMS)} >= 2 THEN 1 ELSE wd END AS fw FROM it),
ii AS (SELECT *, CASE WHEN sh >= 2 AND fw >= 2 THEN 3 ELSE greatest(sh, fw) END AS recent,
  greatest(CASE WHEN named AND close_age <= 730 THEN 2 WHEN named AND (close_age IS NOT NULL OR flagged) THEN 1 WHEN flagged THEN 1 ELSE 0 END, ({sql_any('merged', FUND_TOPICS)} AND {sql_any('merged', FUND_ACTIONS)})::INT) AS fund,
  ({sql_any('merged', HIRING_TERMS)} AND {sql_any('merged', HIRING_ROLES)})::INT AS hiring,
  CASE WHEN {LAST} >= 2 AND ({sql_hits('merged', PUBLIC_STRONG)} >= 1 OR {sql_hits('merged', PUBLIC_MEDIUM)} >= 2) THEN 2 WHEN {LAST} >= 1 AND {sql_hits('merged', PUBLIC_STRONG)} >= 1 THEN 1 WHEN {sql_hits('merged', PUBLIC_STRONG)} >= 2 THEN 1 WHEN {sql_hits('merged', PUBLIC_STRONG)} >= 1 AND {sql_hits('merged', PUBLIC_MEDIUM)} >= 1 THEN 1 ELSE 0 END AS public,
  ({sql_any('place', WARM_PLACES)}::INT + {sql_any('merged', SECTOR_TERMS['fintech'])}::INT + ({sql_any('merged', PORTFOLIO_MARKERS)} AND {sql_any('merged', SECTOR_TERMS['fintech'])})::INT + ({sql_any('merged', PUBLIC_ACTIVITY)} AND {sql_any('merged', SECTOR_TERMS['fintech'])})::INT + 1) AS warm_n
  FROM iw),
t AS (SELECT *, least(10, sector + stage + checks + geo + strategic) AS fit_score, CASE WHEN warm_n >= 3 THEN 2 WHEN warm_n >= 1 THEN 1 ELSE 0 END AS warm, least(10, recent + fund + hiring + public + CASE WHEN warm_n >= 3 THEN 2 WHEN warm_n >= 1 THEN 1 ELSE 0 END) AS intent_score FROM ii)"""
ALL = f"{BASE}, {FIT}, {INTENT}"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date"))
    o = table(spark, sf_dir, "orders").filter(age >= 0).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("last_date"), F.count_if(age <= 7).alias("n7"), F.count_if(age <= 182).alias("n6m"), F.count_if(age <= 365).alias("n12m"), (F.min("o_totalprice") * 10).alias("lo"), (F.max("o_totalprice") * 10).alias("hi")
    )
    k = F.col("c_custkey")
    pick = lambda texts: F.get(F.array(*map(F.lit, texts)), (k % 5).cast("int"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(o, "c_custkey", "left")
    rows = rows.select(
        "c_custkey", "c_name", pick(NOTES).alias("sheet"), pick(SITES).alias("site"), F.when(k % 7 == 0, "").otherwise(F.lower("n_name")).alias("place"), "last_date", F.datediff(F.lit(AS_OF).cast("date"), "last_date").alias("last_age"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n7", "n6m", "n12m")], F.when(k % 4 != 1, F.col("lo")).alias("low"), F.when(k % 4 != 2, F.col("hi")).alias("high"), F.when(k % 4 != 3, (F.col("lo") + F.col("hi")) / 2).alias("middle"),
        F.when(k % 3 == 0, (k * 37 % 1500).cast("int")).alias("close_age"), (k % 6 == 0).alias("named"), (k % 8 == 0).alias("flagged"), F.when(k % 5 == 2, (k * 13 % 400).cast("int")).alias("web_age"),
    )
    return rows.withColumn("merged", F.concat_ws(" ", "sheet", F.when(F.col("site") != "", F.col("site")))).withColumn("inst", S.institutional(F.col("sheet")))


def with_fit(e: DataFrame) -> DataFrame:
    c = F.col
    out = e.select(
        "*", S.fit_sector(c("sheet"), c("merged"), c("inst")).alias("sector"), S.fit_stage(c("merged"), c("inst")).alias("stage"), S.fit_check(c("low"), c("high"), c("middle")).alias("checks"),
        S.fit_geography(c("place")).alias("geo"), S.fit_strategic(c("sheet"), c("merged"), c("inst")).alias("strategic"),
    )
    return out.withColumn("fit_score", S.capped(*map(c, ("sector", "stage", "checks", "geo", "strategic"))))


def with_intent(f: DataFrame) -> DataFrame:
    c = F.col
    points = recent_points(c("last_date"), F.lit(AS_OF).cast("date"))
    out = f.select(
        "*", S.intent_recent(c("n7"), c("n6m"), c("n12m"), points, c("web_age"), c("site")).alias("recent"), S.intent_fund(c("named"), c("close_age"), c("flagged"), c("flagged"), c("merged")).alias("fund"),
        S.intent_hiring(c("merged")).alias("hiring"), S.intent_public(points, c("merged")).alias("public"),
    )
    out = out.withColumn("warm_n", F.size(S.warm_signals(c("place"), c("merged"), c("merged"), c("site"), F.lit(True))))
    return out.withColumn("warm", S.intent_warm(c("warm_n"))).withColumn("intent_score", S.capped(*map(c, ("recent", "fund", "hiring", "public", "warm"))))


FIT_NAMES, INTENT_NAMES = ["sector", "stage", "checks", "geo", "strategic", "fit_score"], ["recent", "fund", "hiring", "public", "warm", "intent_score"]


@book.query(f"WITH {ALL} SELECT c_custkey, " + ", ".join(f"{n}::INT AS {n}" for n in FIT_NAMES) + " FROM t")
def fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fit(evidence(spark, sf_dir)).select("c_custkey", *[F.col(n).cast("int").alias(n) for n in FIT_NAMES])


@book.query(f"WITH {ALL} SELECT c_custkey, " + ", ".join(f"{n}::INT AS {n}" for n in INTENT_NAMES) + " FROM t")
def intent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_intent(with_fit(evidence(spark, sf_dir))).select("c_custkey", *[F.col(n).cast("int").alias(n) for n in INTENT_NAMES])


AGES = "list_filter([CASE WHEN n7 >= 1 THEN 7 END, CASE WHEN n6m >= 3 THEN 30 WHEN n6m >= 1 THEN 60 END, CASE WHEN n12m >= 4 THEN 60 WHEN n12m >= 1 THEN 90 END, last_age, CASE WHEN close_age <= 365 THEN least(close_age, 90) END, web_age], lambda x: x IS NOT NULL AND x >= 0)"
PROB = "greatest(0, least(85, CASE {c} WHEN 'Low' THEN round_even(b * 0.7, 0) WHEN 'High' THEN round_even(least(85.0, b * 1.05), 0) ELSE b END::INT))"
REPORT = f"""{ALL},
r1 AS (SELECT *, fit_score + intent_score AS total, list_min({AGES}) AS age, 1 + (site <> '')::INT AS sources, {sql_hits('merged', ACTIVITY_TERMS)} AS terms FROM t),
r2 AS (SELECT *, CASE WHEN age <= 30 THEN 'Last 30 days' WHEN age <= 60 THEN 'Last 30-60 days' WHEN age <= 180 THEN 'Last 60-90 days' WHEN terms >= 3 THEN 'Last 60-90 days' ELSE 'Older / unclear' END AS recency, greatest(0, least(100, round_even(total / 20.0::DOUBLE * 100, 0)::INT)) AS s FROM r1),
r3 AS (SELECT *, recency IN ('Last 30 days', 'Last 30-60 days') AS fresh FROM r2),
r4 AS (SELECT *, CASE WHEN sources = 2 AND total >= 10 AND fresh THEN 'High' WHEN sources = 2 AND total >= 8 THEN 'Medium' WHEN sources >= 1 AND total >= 6 AND fresh THEN 'Medium' ELSE 'Low' END AS conf,
  CASE WHEN warm_n >= 4 THEN 'Direct connection' WHEN warm_n = 3 THEN '1st degree mutual' WHEN warm_n >= 1 THEN '2nd degree' ELSE 'None' END AS wl, round_even(2 + 0.78::DOUBLE * s, 0) AS b FROM r3)"""
SIGNAL_TYPE = "CASE WHEN recent >= 2 THEN 'Active Investing' WHEN fund >= 1 THEN CASE WHEN flagged THEN 'Fundraising' ELSE 'New Fund' END WHEN recent >= 1 AND public >= 1 THEN 'Active Investing' WHEN public >= 2 THEN 'Public Activity' WHEN public >= 1 THEN 'Similar Portfolio Activity' WHEN recent >= 1 THEN 'Active Investing' WHEN sector >= 2 THEN 'Sector Match Only' ELSE 'Weak / No Recent Signal' END"
N = "CASE WHEN n7 >= 1 THEN n7 WHEN n6m >= 1 THEN n6m ELSE n12m END"
ACTS = """CASE WHEN n7 >= 1 THEN 'Invested in ' || n7 || ' ' || CASE WHEN sector >= 2 THEN 'fintech ' ELSE '' END || CASE WHEN n7 = 1 THEN 'company' ELSE 'companies' END || ' in the last 7 days'
  WHEN n6m >= 1 THEN 'Invested in ' || n6m || ' ' || CASE WHEN sector >= 2 THEN 'fintech ' ELSE '' END || CASE WHEN n6m = 1 THEN 'company' ELSE 'companies' END || ' in the last 6 months'
  WHEN n12m >= 1 THEN 'Invested in ' || n12m || ' ' || CASE WHEN n12m = 1 THEN 'company' ELSE 'companies' END || ' in the last 12 months'
  WHEN last_age <= 365 THEN 'Last known investment in ' || strftime(last_date, '%b %Y') ELSE '' END"""
FUNDS = "CASE WHEN named AND close_age <= 730 THEN 'recently closed Fund II' WHEN named AND close_age <= 1825 THEN 'closed Fund II' WHEN named THEN 'named fund: Fund II' WHEN flagged THEN 'actively fundraising' ELSE '' END"
FITS = """CASE WHEN sector >= 3 THEN CASE WHEN stage >= 2 THEN 'Strong fintech and stage fit' WHEN geo >= 1 THEN 'Strong fintech fit in target geography' ELSE 'Strong fintech fit' END
  WHEN sector >= 2 THEN CASE WHEN stage >= 2 THEN 'Fintech and stage match' WHEN geo >= 1 THEN 'Fintech match in target geography' ELSE 'Fintech sector match' END
  WHEN sector >= 1 THEN CASE WHEN stage >= 2 THEN 'Partial sector overlap and good stage fit' ELSE 'Some sector overlap' END WHEN stage >= 2 THEN 'Good stage fit' WHEN geo >= 1 THEN 'Geographic match' ELSE 'Some alignment' END"""
INTENTS = """CASE WHEN recent >= 3 THEN CASE WHEN fund >= 1 THEN 'very recent deals and fund activity' WHEN hiring >= 1 THEN 'very recent deals and team growth' WHEN public >= 1 THEN 'very recent deals and public signals' ELSE 'very recent deal activity' END
  WHEN recent >= 2 THEN CASE WHEN public >= 1 THEN 'recent deals and public signals' WHEN fund >= 1 THEN 'recent deals and fund activity' WHEN hiring >= 1 THEN 'recent deals and hiring signals' ELSE 'recent investing activity' END
  WHEN fund >= 2 THEN 'a recently closed fund' WHEN fund >= 1 AND recent >= 1 THEN 'fund activity and some deals' WHEN fund >= 1 THEN 'new fund or fundraising signals' WHEN recent >= 1 AND public >= 1 THEN 'some deal activity and public signals'
  WHEN recent >= 1 THEN 'some recent deal activity' WHEN public >= 1 THEN 'public portfolio signals' WHEN hiring >= 1 THEN 'hiring for investment roles' ELSE 'some activity' END"""
TAGS = "array_to_string(list_filter([CASE WHEN sector >= 2 THEN 'strong fintech alignment' WHEN sector >= 1 THEN 'partial fintech alignment' END, CASE WHEN checks >= 2 THEN 'check-size aligned' END], lambda x: x IS NOT NULL), ', ')"
REASON = f"""CASE WHEN {ACTS} <> '' AND {FUNDS} <> '' THEN {ACTS} || ' and ' || {FUNDS} || '.' WHEN {ACTS} <> '' THEN {ACTS} || CASE WHEN {TAGS} <> '' THEN '; ' || {TAGS} ELSE '' END || '.'
  WHEN {FUNDS} <> '' THEN upper(substr({FUNDS}, 1, 1)) || lower(substr({FUNDS}, 2)) || '; ' || CASE WHEN sector >= 2 THEN 'strong' WHEN sector >= 1 THEN 'partial' ELSE 'limited' END || ' fintech alignment.'
  WHEN fit_score >= 4 AND intent_score >= 3 THEN {FITS} || ' with ' || {INTENTS} || '.' WHEN fit_score >= 4 THEN {FITS} || ', but limited recent activity.' WHEN intent_score >= 3 THEN 'Shows ' || {INTENTS} || ', but sector alignment is limited.'
  WHEN total >= 4 THEN CASE WHEN sector >= 1 THEN 'Some sector overlap, but signals are mixed.' WHEN recent >= 1 OR fund >= 1 THEN 'Some activity signals, but overall fit is unclear.' ELSE 'Partial signals, but no strong fit or activity.' END ELSE 'No significant signals detected.' END"""
CLOSE = "wl IN ('Direct connection', '1st degree mutual')"
R = list(REPORT_COLUMNS)


def reason_of(rows: DataFrame):
    c = F.col
    activity = P.activity_clause(c("n7"), c("n6m"), c("n12m"), F.lit(""), c("last_date"), F.lit(AS_OF).cast("date"), c("sector"))
    fund = P.fund_clause(F.when(c("named"), "Fund II"), c("close_age"), F.lit(None).cast("date"), c("flagged"))
    return P.reason(activity, fund, *map(c, ("sector", "stage", "checks", "geo", "recent", "fund", "hiring", "public", "fit_score", "intent_score")))


@book.query(
    f"""WITH {REPORT} SELECT c_name AS "{R[0]}", s AS "{R[1]}", {PROB.format(c='conf')} AS "{R[2]}", {SIGNAL_TYPE} AS "{R[3]}", CASE WHEN sector >= 3 THEN 'High' WHEN sector >= 1 THEN 'Medium' ELSE 'Low' END AS "{R[4]}",
  CASE WHEN checks >= 2 THEN 'Perfect fit' WHEN checks = 1 THEN 'Slight mismatch' ELSE 'Poor fit' END AS "{R[5]}", wl AS "{R[6]}", recency AS "{R[7]}", conf AS "{R[8]}",
  {REASON} AS "{R[9]}",
  CASE WHEN s >= 75 AND fresh THEN CASE WHEN {CLOSE} THEN 'Prioritize with warm intro' ELSE 'Reach out immediately' END WHEN s >= 60 AND {CLOSE} THEN 'Prioritize with warm intro' WHEN s >= 60 AND (fresh OR intent_score >= 4) THEN 'Reach out immediately' WHEN s >= 40 THEN 'Monitor for now' ELSE 'Low priority' END AS "{R[10]}",
  CASE WHEN s >= 75 AND fresh OR s >= 70 AND intent_score >= 5 THEN 'Immediate Target' WHEN s >= 60 OR s >= 50 AND (fresh OR intent_score >= 4) THEN 'High Priority' WHEN s >= 35 THEN 'Secondary' ELSE 'Ignore' END AS "{R[11]}",
  CASE WHEN recency = 'Last 30 days' AND (s >= 65 OR intent_score >= 5) THEN 'Act within 14 days' WHEN fresh AND s >= 50 OR s >= 60 AND intent_score >= 4 THEN 'Act within 30 days' ELSE 'No urgency' END AS "{R[12]}",
  'Investor database' || CASE WHEN site <> '' THEN ', Official site' ELSE '' END AS "{R[13]}", coalesce(strftime(last_date, '%Y-%m-%d'), '') AS "{R[14]}" FROM r4"""
)
def signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 columns of the report, one row for each investor."""
    c = F.col
    rows = with_intent(with_fit(evidence(spark, sf_dir))).withColumn("total", c("fit_score") + c("intent_score"))
    rows = rows.withColumn("recency", S.recency(c("n7"), c("n6m"), c("n12m"), c("last_age"), c("close_age"), c("web_age"), S.hits(c("merged"), ACTIVITY_TERMS))).withColumn("s", S.score_100(c("total")))
    rows = rows.withColumn("fresh", c("recency").isin(*S.FRESH)).withColumn("conf", S.confidence(1 + (c("site") != "").cast("int"), c("total"), c("fresh"))).withColumn("wl", S.warm_label(c("warm_n")))
    columns = [
        c("c_name"), c("s"), S.probability(c("s"), c("conf")), S.signal_type(c("recent"), c("fund"), c("public"), c("sector"), c("flagged")), S.sector_relevance(c("sector")), S.check_label(c("checks")), c("wl"), c("recency"), c("conf"),
        reason_of(rows), S.action(c("s"), c("wl"), c("fresh"), c("intent_score")), S.signal_bucket(c("s"), c("fresh"), c("intent_score")),
        S.urgency(c("s"), c("recency"), c("intent_score")), S.data_sources(F.lit(True), c("site") != "", F.lit(False), F.lit(False)), F.coalesce(F.date_format("last_date", "yyyy-MM-dd"), F.lit("")),
    ]
    return rows.select(*[x.alias(name) for x, name in zip(columns, REPORT_COLUMNS, strict=True)])


@book.query(f"SELECT event_id, s::INT AS score, c AS confidence, {PROB.format(c='c')} AS probability FROM (SELECT event_id, s, c, round_even(2 + 0.78::DOUBLE * s, 0) AS b FROM (SELECT event_id, floor(abs(value))::BIGINT % 101 AS s, ['Low', 'Medium', 'High'][(user_id % 3 + 1)::INT] AS c FROM events))")
def probability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and confidences of events, as percentages."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.floor(F.abs("value")) % 101).cast("int").alias("score"), F.get(F.array(*map(F.lit, ("Low", "Medium", "High"))), (F.col("user_id") % 3).cast("int")).alias("confidence"))
    return rows.withColumn("probability", S.probability(F.col("score"), F.col("confidence")))
