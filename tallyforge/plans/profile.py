"""Queries over profiles, texts to embed, site candidates and outreach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.fixed import NEWS_FRAGMENTS, QUERY_KEYS, RECENT_VERBS, SITE_ACTIVITY_TERMS, SITE_WORDS, SOCIAL_FRAGMENTS
from tallyforge.functions.text import strings
from tallyforge.operators import candidates as C
from tallyforge.operators import matching as M
from tallyforge.operators import profile as P
from tallyforge.plans.book import Book, quoted, sql_any, sql_hits, table
from tallyforge.plans.matching import DEAL, DESCRIBED, FEATURES, SHORT, _amount, described, featured

book = Book()

DEALS = """d AS (SELECT o_orderkey AS deal_id, 'Co ' || o_orderkey AS company_name, CASE WHEN o_orderkey % 2 = 0 THEN 'fintech' ELSE 'health' END AS industry, o_totalprice * 40 AS raise_amount, CASE o_orderkey % 4 WHEN 0 THEN 'Series B' WHEN 1 THEN 'angel' END AS stage_label,
  CASE o_orderkey % 3 WHEN 0 THEN 'Dallas; Texas, ' WHEN 1 THEN '' END AS geography, CASE WHEN o_orderkey % 5 = 0 THEN 'A problem.' END AS problem, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice * 200 END AS valuation, CASE WHEN o_orderkey % 7 = 0 THEN 'hiring' ELSE '' END AS funds FROM orders)"""
MONEY = "('$' || format('{{:,}}', round_even({x}, 0)::BIGINT))"


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        k.alias("deal_id"), F.concat(F.lit("Co "), k).alias("company_name"), F.when(k % 2 == 0, "fintech").otherwise("health").alias("industry"), (price * 40).alias("raise_amount"), F.when(k % 4 == 0, "Series B").when(k % 4 == 1, "angel").alias("stage_label"),
        F.when(k % 3 == 0, "Dallas; Texas, ").when(k % 3 == 1, "").alias("geography"), F.when(k % 5 == 0, "A problem.").alias("problem"), F.lit(None).cast("string").alias("solution"), F.lit(None).cast("string").alias("market_size"),
        F.when(k % 6 == 0, price * 200).alias("valuation"), F.when(k % 7 == 0, "hiring").otherwise("").alias("use_of_funds_breakdown"),
    )


@book.query(
    f"""WITH {DEALS} SELECT deal_id, CASE WHEN stage_label = 'Series B' THEN 'series_b' WHEN raise_amount <= 1500000 THEN 'seed' WHEN raise_amount <= 5000000 THEN 'series_a' WHEN raise_amount <= 15000000 THEN 'series_b' ELSE 'growth' END AS stage,
  CASE WHEN geography <> '' THEN 'Dallas,Texas' ELSE 'United States' END AS places, company_name || ' is a ' || industry || ' company raising ' || {MONEY.format(x='raise_amount')} || '.' AS company_core,
  coalesce(problem, company_name || ' addresses a core problem in ' || industry || '.') AS problem,
  'Raising ' || {MONEY.format(x='raise_amount')} || ' over a 90-day process to fund growth milestones, investor outreach, and execution.' || CASE WHEN funds <> '' THEN ' Use of funds: ' || funds ELSE '' END || CASE WHEN valuation IS NOT NULL THEN ' Valuation: ' || {MONEY.format(x='valuation')} ELSE '' END AS raise_thesis FROM d"""
)
def deal_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deal_profile(deals(spark, sf_dir)).select("deal_id", "stage", F.array_join("geography", ",").alias("places"), "company_core", "problem", "raise_thesis")


@book.query(f"WITH {DEALS} SELECT deal_id, 'Company: ' || company_name || chr(10) || 'Industry: ' || industry || CASE WHEN stage_label IS NOT NULL THEN chr(10) || 'Stage: ' || stage_label ELSE '' END || CASE WHEN problem IS NOT NULL THEN chr(10) || chr(10) || 'Problem:' || chr(10) || problem ELSE '' END AS body FROM d")
def deal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return deals(spark, sf_dir).select("deal_id", P.profile_text([("Company", c("company_name")), ("Industry", c("industry")), ("Stage", c("stage_label"))], [("Problem", c("problem")), ("Solution", c("solution"))]).alias("body"))


@book.query(
    f"""WITH c AS (SELECT c_custkey, c_name, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Backs ' || lower(c_mktsegment) END AS thesis, (c_custkey % 4) * 250000 AS lo, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2000000 END AS hi FROM customer)
SELECT c_custkey, CASE WHEN thesis <> '' THEN thesis || ' | ' ELSE '' END || 'Focus sectors: ' || seg || CASE WHEN c_custkey % 2 = 0 THEN ' | Stages: seed, growth' ELSE '' END || CASE WHEN lo <> 0 OR hi <> 0 THEN ' | Check size: ' || CASE WHEN lo <> 0 THEN {MONEY.format(x='lo')} ELSE '?' END || '–' || CASE WHEN hi <> 0 THEN {MONEY.format(x='hi')} ELSE '?' END ELSE '' END AS fund_thesis,
  c_name || ' at ' || seg || CASE WHEN c_custkey % 4 = 0 THEN ' | Based in Dallas' ELSE '' END || CASE WHEN thesis <> '' AND c_custkey % 2 = 1 THEN ' | ' || thesis ELSE '' END AS partner_bio,
  CASE WHEN c_custkey % 3 = 1 THEN 'Most recent investment: Acme on 2024-01-02' WHEN c_custkey % 3 = 2 THEN 'Last investment date: 2024-01-02' ELSE 'news one | news two' END || CASE WHEN c_custkey % 3 <> 0 THEN ' | Deals past 12 months: ' || (c_custkey % 6) || ' | Recent portfolio: B, C, D' ELSE '' END AS activity FROM c"""
)
def namespace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that are embedded, by namespace; metadata stands in where there are no activity signals."""
    k, none = F.col("c_custkey"), F.lit("")
    thesis = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Backs "), F.lower("c_mktsegment")))
    signals = F.when(k % 3 == 0, F.array(*[F.struct(F.lit(t).alias("source_type"), F.lit(x).alias("text")) for t, x in (("google_news", "news one"), ("pitchbook_profile", "static"), ("press_release", "news two"))])).otherwise(F.array().cast("array<struct<source_type:string,text:string>>"))
    meta = {"last_company": F.when(k % 3 == 1, "Acme"), "last_date": F.lit("2024-01-02"), "last_type": none, "count_12m": (k % 6).cast("string")}
    return table(spark, sf_dir, "customer").select(
        "c_custkey", P.fund_text(thesis, F.array("c_mktsegment"), strings([]), F.when(k % 2 == 0, strings(["seed", "growth"])).otherwise(strings([])), (k % 4) * 250_000, F.when(k % 5 == 0, 0).otherwise(2_000_000)).alias("fund_thesis"),
        P.partner_text(F.col("c_name"), none, F.col("c_mktsegment"), F.when(k % 4 == 0, "Dallas"), none, thesis, F.when(k % 2 == 0, thesis)).alias("partner_bio"), P.activity_text(signals, meta, strings(["A", "B", "C", "D"])).alias("activity"),
    )


HOST = "replace(lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)), 'www.', '')"
PATH = "regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@book.query(
    f"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://acme.com' WHEN 1 THEN 'https://acme.com/team/a/b' WHEN 2 THEN 'https://twitter.com/acme' WHEN 3 THEN 'https://other.org/blog' ELSE 'https://sub.acme.com/jobs' END AS u, CASE WHEN page_id % 2 = 0 THEN 'Acme Ventures official' ELSE 'listing' END AS title FROM pages),
b AS (SELECT *, {HOST} AS host, lower({HOST} || ' ' || title || ' ') AS blob, {PATH} AS path FROM p)
SELECT page_id, CASE WHEN {sql_any('host', SOCIAL_FRAGMENTS)} OR {sql_any('host', NEWS_FRAGMENTS)} THEN -999.0 ELSE CASE WHEN contains(blob, 'acme') THEN 25 ELSE -20 END + CASE WHEN contains(blob, 'acme ventures') THEN 16 ELSE 0 END + CASE WHEN contains(blob, 'acme') THEN 4 ELSE 0 END
  + CASE WHEN path IN ('', '/') THEN 8 WHEN contains(path, '/team') THEN 4 WHEN contains(path, '/blog') THEN 2 WHEN contains(path, '/jobs') THEN -3 ELSE 4 END + CASE WHEN {sql_any('blob', SITE_WORDS)} THEN 6 ELSE 0 END - CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 3 THEN 4 ELSE 0 END END::DOUBLE AS score FROM b"""
)
def official_site_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.when(k == 0, "https://acme.com").when(k == 1, "https://acme.com/team/a/b").when(k == 2, "https://twitter.com/acme").when(k == 3, "https://other.org/blog").otherwise("https://sub.acme.com/jobs")
    title = F.when(F.col("page_id") % 2 == 0, "Acme Ventures official").otherwise("listing")
    return table(spark, sf_dir, "pages").select("page_id", P.site_score(url, title, F.lit(""), F.lit("Acme Ventures")).alias("score"))


@book.query(
    f"""WITH x AS (SELECT doc_id, lower(text) || CASE doc_id % 3 WHEN 0 THEN ' led a funding round' WHEN 1 THEN ' portfolio' ELSE '' END AS t, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 500)::INT END AS age, (doc_id % 2)::INT AS n FROM documents)
SELECT doc_id, coalesce(age BETWEEN 0 AND 365 AND {sql_hits('t', SITE_ACTIVITY_TERMS)} >= 1, false) OR ({sql_hits('t', SITE_ACTIVITY_TERMS)} >= 3 AND {sql_any('t', RECENT_VERBS)}) AS active, CASE WHEN n > 0 OR length(trim(t)) >= 120 THEN {quoted([','.join(QUERY_KEYS[:4])])} ELSE {quoted([','.join(QUERY_KEYS)])} END AS query_keys FROM x"""
)
def search_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.lower("text"), F.when(k % 3 == 0, " led a funding round").when(k % 3 == 1, " portfolio").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"), F.when(k % 4 == 0, (k % 500).cast("int")).alias("age"), (k % 2).cast("int").alias("n"))
    return rows.select("doc_id", P.recently_active(F.col("t"), F.col("age")).alias("active"), F.array_join(P.query_keys(F.col("n"), F.col("t")), ",").alias("query_keys"))


@book.query(
    f"""WITH {FEATURES}, {SHORT}, {DESCRIBED}, best AS (SELECT *, row_number() OVER (ORDER BY score DESC, c_custkey)::INT AS rank FROM n SEMI JOIN short USING (c_custkey) QUALIFY rank <= 20),
r AS (SELECT *, list_filter([CASE WHEN semantic_fit >= 0.5 AND thesis <> '' THEN CASE WHEN rel IS NOT NULL THEN 'Thesis: "' || trim(substr(rel, 1, 130)) || '"' ELSE 'Fund sector focus: ' || focus END WHEN semantic_fit >= 0.25 THEN 'Sector overlap: ' || focus END,
  CASE WHEN stage_fit >= 0.9 THEN 'Invests at series a stage (' || replace(array_to_string(stage_focus, ', '), '_', ' ') || ')' END,
  CASE WHEN check_fit >= 0.9 AND check_max > 0 THEN 'Cheque range ' || CASE WHEN check_min > 0 THEN {_amount('check_min')} ELSE 'open' END || '–' || {_amount('check_max')} || ' fits a $' || {_amount('100000000.0')} || ' raise' END,
  CASE WHEN portfolio_adjacency >= 0.55 AND len(companies) > 0 THEN CASE WHEN len(near) > 0 THEN 'Portfolio includes adjacent bets: ' || array_to_string(near[1:3], ', ') ELSE 'Portfolio of ' || len(companies) || ' companies shows sector exposure' END END,
  CASE WHEN recent_activity >= 0.7 THEN CASE WHEN count_12m > 0 THEN 'Actively deploying: ' || count_12m || ' deals in last 12 months' WHEN contains(deal.t, 'company:') THEN 'Recent investment: Acme Co (' || deal.d[1:7] || ')' WHEN deal IS NOT NULL THEN 'Recent investment activity recorded (' || deal.d[1:7] || ')' END END,
  CASE WHEN geography_fit >= 1.0 THEN 'Geographic focus includes ' || coalesce(list_filter(geography, lambda g: contains(lower(g), 'america') OR contains('america', lower(g)))[1], geography[1]) END, CASE WHEN warm_paths > 0 THEN 'Warm path 1' END], lambda x: x IS NOT NULL) AS l FROM best)
SELECT rank, c_custkey::VARCHAR AS investor_id, c_name AS full_name, round_even(score * 100, 0)::INT AS fit_score, CASE WHEN len(l) > 0 THEN array_to_string(l[1:4], '; ') ELSE 'Passed eligibility filters; borderline fit — review manually' END AS why_good_fit,
  CASE WHEN contains(lower(thesis), 'infrastructure') OR contains(lower(thesis), 'developer') THEN 'deep_tech' WHEN contains(lower(thesis), 'application') OR contains(lower(thesis), 'saas') THEN 'software' WHEN warm_paths > 0 THEN 'warm_network' ELSE 'general_early_stage' END AS match_segment,
  warm_paths AS n_warm, round(score, 4) AS final_score FROM r"""
)
def outreach_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = M.ranked(M.shortlisted(featured(spark, sf_dir), "c_custkey", 20), "c_custkey", 20)
    rows = described(best).withColumn("explanation", M.explanation(DEAL)).withColumns({"investor_id": F.col("c_custkey").cast("string"), "full_name": F.col("c_name")})
    return P.outreach(rows).select("rank", "investor_id", "full_name", "fit_score", "why_good_fit", "match_segment", "n_warm", "final_score")


@book.query("SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END + 1)::INT AS n_pending, (o_orderkey % 4 = 0) AS needs_approval FROM orders")
def wires_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wires that are not completed, those without a status included."""
    k = F.col("o_orderkey")
    wires = F.array(F.struct(F.when(k % 3 == 0, "completed").otherwise("pending").alias("status")), F.struct(F.lit(None).cast("string").alias("status")))
    status = F.when(k % 4 == 0, "client_confirmed").otherwise("pending")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(P.pending_wires(wires)).alias("n_pending"), C.needs_approval(status).alias("needs_approval"))


@book.query("SELECT user_id, min(event_id) FILTER (props <> '' AND event_type <> 'view') AS event_id, arg_min(props, event_id) FILTER (props <> '' AND event_type <> 'view') AS props FROM events GROUP BY user_id HAVING count(*) FILTER (props <> '' AND event_type <> 'view') > 0")
def first_non_empty_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("props")).otherwise("").alias("props"))
    return P.first_non_empty(rows, "user_id", "event_id", "props")


@book.query("SELECT doc_id, item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels) LEFT JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT item_id * item_id AS item_id FROM benchmark)) USING (i)")
def positional_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th labelled document with the i-th item; ids of both have gaps."""
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * F.col("item_id")).alias("item_id"))
    return P.positional_join(table(spark, sf_dir, "labels").select("doc_id"), items, "doc_id", "item_id")


@book.query("SELECT c.conv_id, c.turn, coalesce(u.status, 'keep') AS status FROM conversations c LEFT JOIN (SELECT conv_id, turn, 'discard' AS status FROM conversations WHERE turn % 5 = 3) u USING (conv_id, turn)")
def review_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    edits = items.filter("turn % 5 = 3").withColumn("status", F.lit("discard"))
    return items.join(edits, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("status", F.lit("keep")).alias("status"))
