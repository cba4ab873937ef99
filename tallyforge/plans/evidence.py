"""Queries over merged evidence, validation and reliability. Parts stand for investors; what was found is made from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.fixed import BENIGN_STATUSES, FIT_KEYS, INTENT_KEYS, QUERY_KEYS, REPORT_COLUMNS, SECTOR_TERMS, STAGE_TERMS, TARGET_US_PLACES
from tallyforge.functions.text import strings
from tallyforge.operators import evidence as E
from tallyforge.operators import investor_run as R
from tallyforge.plans.book import Book, quoted, spread, sql_any, sql_hits, table

book = Book()

#: Name, modulus, remainder and value of made-up fields: the value where the key leaves the remainder, else empty.
FIELDS = {
    "description": (3, 0, "Fintech Payments fund"), "preferred_industry": (5, 0, "Lending"), "keywords": (11, 3, "vc startup"), "primary_type": (7, 0, "VC"), "hq_location": (4, 0, "Dallas, Texas"), "preferred_geography": (9, 2, "U.S."),
    "latest_note": (6, 0, "Seed note"), "last_investment_company": (8, 1, "Acme Banking"), "site_text": (4, 1, "Official portfolio: banking and fintech partners"), "found_official": (8, 1, "More Official"), "found_news": (3, 1, "News of funding"),
    "recent_deal_text": (2, 0, "led a seed round in payments and lending"), "new_fund_text": (10, 4, "new fund"), "hiring_text": (9, 0, "hiring analyst"), "public_signal_text": (13, 0, "press"), "outreach_text": (17, 0, "contact us"), "website": (2, 1, "acme.com"),
}
EMPTY = ("preferred_verticals", "all_industries", "primary_industry_sector", "primary_industry_group", "other_types", "preferred_investment_types", "hq_city", "hq_state", "hq_country")
LISTS = {
    "site_urls": (4, 1, "https://acme.com/a"), "found_official_urls": (8, 1, "https://acme.com/a"), "found_news_urls": (3, 1, "https://reuters.com/n"), "site_errors": (5, 0, "http 500"), "site_warnings": (5, 1, "w"), "query_errors": (7, 0, "q"), "query_warnings": (7, 1, "w"),
    "scrape_errors": (11, 0, "s"), "scrape_warnings": (11, 1, "w"), "notes": (19, 0, "fit breakdown does not sum to Fit Score"),
}
K = "p_partkey"
MADE = (
    "i AS (SELECT p_partkey, p_name AS name, " + ", ".join(f"CASE WHEN {K} % {m} = {r} THEN {quoted([v])} ELSE '' END AS {n}" for n, (m, r, v) in FIELDS.items()) + ", "
    + ", ".join(f"CASE WHEN {K} % {m} = {r} THEN [{quoted([v])}] ELSE [] END AS {n}" for n, (m, r, v) in LISTS.items()) + ", CASE WHEN p_partkey % 10 = 0 THEN 'Careers Page' ELSE '' END AS site_careers FROM part)"
)


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    fields = [F.when(k % m == r, v).otherwise("" if i % 2 else F.lit(None).cast("string")).alias(n) for i, (n, (m, r, v)) in enumerate(FIELDS.items())]
    lists = [F.when(k % m == r, F.array(F.lit(v))).otherwise(F.lit(None).cast("array<string>") if i % 2 else strings([])).alias(n) for i, (n, (m, r, v)) in enumerate(LISTS.items())]
    by = F.when(k % 10 == 0, F.create_map(F.lit("careers"), F.lit("Careers Page"), F.lit("team"), F.lit("t")))
    # long expressions over short rows: a file of some MB is work for all cores
    return spread(table(spark, sf_dir, "part")).select(K, F.col("p_name").alias("name"), *fields, *lists, *[F.lit("").alias(n) for n in EMPTY], by.alias("site_by"), F.lit(None).cast("map<string,string>").alias("found_by"))


def _blob(fields: tuple[str, ...]) -> str:
    return "lower(" + " || ' ' || ".join("''" if f in EMPTY else f for f in fields) + ")"


def _tiered(sheet: str, terms: list[str], thin: int) -> str:
    m = f"array_to_string(list_filter([trim({_blob(E.SHEET[sheet])}), o, n], lambda x: x <> ''), ' ')"
    return f"CASE WHEN q <> '' AND (length({m}) < {thin} OR {sql_hits(m, terms)} = 0 OR {sql_hits('q', terms)} > {sql_hits(m, terms)}) THEN trim({m} || CASE WHEN {m} <> '' THEN ' ' ELSE '' END || q) ELSE {m} END"


def _joined(*parts: str) -> str:
    return f"lower(array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), ' '))"


MERGED = f"""{MADE}, j AS (SELECT *, lower(trim(site_text || ' ' || found_official)) AS o, lower(found_news) AS n, lower({" || ' ' || ".join(QUERY_KEYS[:4])}) AS q0 FROM i), g AS (SELECT *, trim(q0) AS q FROM j)"""
GEO = ["u.s.", *TARGET_US_PLACES]


@book.query(
    f"""WITH {MERGED} SELECT p_partkey, {_tiered('sector', SECTOR_TERMS['fintech'], 12)} AS merged_sector, {_tiered('stage', STAGE_TERMS['seed'], 12)} AS merged_stage, {_tiered('geo', GEO, 8)} AS merged_geo, {_tiered('strategic', SECTOR_TERMS['fintech'], 12)} AS merged_strategic,
  {_joined('o', 'n', 'q0')} AS merged_recent, {_joined('o', 'n', 'hiring_text', 'site_careers')} AS merged_hiring, {_joined('latest_note', 'o', 'n', 'q0')} AS merged_public, len(list_distinct(site_urls || found_official_urls)) AS n_official, length(o) AS official_chars, length(n) > 0 AS has_news FROM g"""
)
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged texts that scoring reads, with what they were made of."""
    rows = E.merged_evidence(made(spark, sf_dir))
    texts = [f"merged_{n}" for n in ("sector", "stage", "geo", "strategic", "recent", "hiring", "public")]
    d = F.col("merge_debug")
    return rows.select(K, *texts, F.size(d.official_urls).cast("long").alias("n_official"), d.lengths.official.cast("long").alias("official_chars"), d.present.news.alias("has_news"))


FLAGS = """f AS (SELECT *, len(site_urls) > 0 OR length(trim(site_text)) >= 120 AS has_site, len(found_official_urls) > 0 OR len(found_news_urls) > 0 OR recent_deal_text || new_fund_text || hiring_text || public_signal_text || outreach_text <> '' OR length(trim(found_news)) >= 120 AS has_search FROM i),
h AS (SELECT *, list_sort(list_filter([CASE WHEN website = '' THEN 'website_missing_input' END, CASE WHEN len(site_warnings) > 0 THEN 'website_fetch_degraded' END, CASE WHEN len(query_warnings) > 0 THEN 'ddgs_query_fallback_used' END, CASE WHEN len(scrape_warnings) > 0 THEN 'ddgs_optional_scrape_blocked' END,
    CASE WHEN len(site_errors) > 0 AND NOT has_site AND has_search THEN 'website_unreachable_but_search_available' END, CASE WHEN len(query_errors) > 0 AND has_search THEN 'ddgs_query_degraded_but_partial_results_available' END, CASE WHEN len(scrape_errors) > 0 AND (has_site OR has_search) THEN 'search_scrape_partially_failed' END,
    CASE WHEN website <> '' AND NOT has_site AND len(site_errors) = 0 THEN 'website_present_but_weak_evidence' END], lambda x: x IS NOT NULL)) AS warned,
  list_sort(list_filter([CASE WHEN len(site_errors) > 0 AND NOT has_site AND NOT has_search THEN 'website_unreachable' END, CASE WHEN len(query_errors) > 0 AND NOT has_search THEN 'ddgs_query_failed' END, CASE WHEN len(scrape_errors) > 0 AND NOT has_site AND NOT has_search THEN 'search_scrape_failed' END,
    CASE WHEN NOT has_site AND NOT has_search THEN 'no_web_evidence' END, CASE WHEN len(notes) > 0 THEN 'validation_failed' END], lambda x: x IS NOT NULL)) AS failed FROM f)"""


@book.query(f"WITH {MADE}, {FLAGS} SELECT p_partkey, CASE WHEN len(failed) > 0 THEN 'partial_failure' ELSE 'success' END AS status, coalesce(failed[1], '') AS failure_reason, array_to_string(failed, ',') AS failures, array_to_string(warned, ',') AS warnings, has_site, has_search FROM h")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.reliability(made(spark, sf_dir))
    return rows.select(K, "status", "failure_reason", F.array_join("failure_reasons", ",").alias("failures"), F.array_join("warning_reasons", ",").alias("warnings"), "has_site", "has_search")


@book.query(
    f"""WITH {MADE}, {FLAGS}, c AS (SELECT coalesce(failed[1], '') AS r, count(*) AS n FROM h GROUP BY 1) SELECT count(*) AS investors, count(*) FILTER (len(failed) = 0) AS succeeded, count(*) FILTER (len(failed) > 0) AS partially_failed, count(*) FILTER (NOT has_site) AS no_website_evidence,
  (SELECT string_agg(r || '=' || n, ',' ORDER BY r) FROM c WHERE r <> '') AS reasons FROM h"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run, with the first failure reasons."""
    s = E.run_summary(E.reliability(made(spark, sf_dir)))
    pairs = F.transform(F.map_entries("failure_reason_counts"), lambda e: F.concat(e.key, F.lit("="), e.value))
    return s.select("investors", "succeeded", "partially_failed", "no_website_evidence", F.array_join(pairs, ",").alias("reasons"))


@book.query(
    """WITH x AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '' ELSE p_name END AS name, CASE p_partkey % 3 WHEN 0 THEN 'http:///x' WHEN 1 THEN 'acme.com' ELSE '' END AS w FROM part)
SELECT k AS p_partkey, array_to_string(list_filter([CASE WHEN name IN ('nan', '') THEN 'missing required field: name' END, CASE WHEN k % 3 = 0 THEN 'website field is present but malformed' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM x"""
)
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    name = F.when(k % 4 == 0, "nan").when(k % 4 == 1, "").otherwise(F.col("p_name"))
    website = F.when(k % 3 == 0, "http:///x").when(k % 3 == 1, "acme.com")
    return table(spark, sf_dir, "part").select(K, F.array_join(E.input_warnings({"name": name}, website), "; ").alias("warnings"))


@book.query(
    """WITH x AS (SELECT p_partkey AS k, (p_partkey % 3 + 2)::INT AS fs, (p_partkey % 5)::INT AS ins FROM part), y AS (SELECT *, fs + (k % 2 = 0)::INT AS fit, ins + (k % 7 = 0)::INT AS intent FROM x), z AS (SELECT *, fit + intent + (k % 11 = 0)::INT AS total FROM y)
SELECT k AS p_partkey, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'fit breakdown does not sum to Fit Score' END, CASE WHEN k % 7 = 0 THEN 'intent breakdown does not sum to Intent Score' END, CASE WHEN k % 11 = 0 THEN 'Fit Score + Intent Score does not equal Total Score' END], lambda x: x IS NOT NULL), '; ') AS issues, fs AS fit_sum FROM z"""
)
def score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakdowns against the totals that go with them; a breakdown begins with zeros."""
    k = F.col(K)
    fit = F.map_concat(F.map_filter(E.empty_points(FIT_KEYS), lambda n, v: ~n.isin("Sector Match", "Stage Match")), F.create_map(F.lit("Sector Match"), (k % 3).cast("int"), F.lit("Stage Match"), F.lit(2)))
    intent = F.map_concat(F.map_filter(E.empty_points(INTENT_KEYS), lambda n, v: n != "Hiring"), F.create_map(F.lit("Hiring"), (k % 5).cast("int")))
    rows = table(spark, sf_dir, "part").select(K, fit.alias("fp"), intent.alias("ip")).withColumns({"fit": E.map_sum(F.col("fp")) + (k % 2 == 0).cast("int"), "intent": E.map_sum(F.col("ip")) + (k % 7 == 0).cast("int")})
    total = F.col("fit") + F.col("intent") + (k % 11 == 0).cast("int")
    return rows.select(K, F.array_join(E.score_issues(F.col("fit"), F.col("fp"), F.col("intent"), F.col("ip"), total), "; ").alias("issues"), E.map_sum(F.col("fp")).alias("fit_sum"))


@book.query(
    f"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 6 = 0 THEN 'missing result field: {REPORT_COLUMNS[7]}' END, CASE WHEN p_partkey % 5 = 0 THEN 'result row is missing investor name' END, CASE WHEN p_partkey % 120 > 100 THEN 'Signal Score outside 0-100 range' END,
  CASE WHEN p_partkey % 9 = 0 THEN 'Investment Probability outside 0-100 range' END], lambda x: x IS NOT NULL), '; ') AS issues FROM part"""
)
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows with missing fields, no name, and values out of range."""
    k = F.col(K)
    value = {REPORT_COLUMNS[0]: F.when(k % 5 == 0, "").otherwise(F.col("p_name")), REPORT_COLUMNS[1]: (k % 120).cast("string"), REPORT_COLUMNS[2]: F.when(k % 9 == 0, "-1").otherwise("50")}
    row = F.create_map(*[x for n in REPORT_COLUMNS for x in (F.lit(n), value.get(n, F.lit("x")))])
    row = F.map_filter(row, lambda n, v: ~((k % 6 == 0) & (n == REPORT_COLUMNS[7])))
    return table(spark, sf_dir, "part").select(K, F.array_join(E.row_issues(row), "; ").alias("issues"))


ERRORS = {"HTTP 404": (404, True), "http 500 of it": (500, False), "unsupported content-type: image/png": (None, True), "timeout": (None, False), "": (None, False), "xhttp 403": (None, False)}


@book.query(
    f"SELECT p_partkey, [{', '.join('NULL' if s is None else str(s) for s, _ in ERRORS.values())}][(p_partkey % {len(ERRORS)} + 1)::INT] AS status, [{', '.join(str(b).lower() for _, b in ERRORS.values())}][(p_partkey % {len(ERRORS)} + 1)::INT] AS benign, "
    f"CASE p_partkey % 4 WHEN 0 THEN 'lost' WHEN 1 THEN 'http 40{BENIGN_STATUSES[0] % 10}' WHEN 2 THEN 'unsupported content-type: image/png' END AS fetch_error FROM part"
)
def fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and weight of errors, and what recorded answers are errors for."""
    k = F.col(K)
    error = F.get(F.array(*map(F.lit, ERRORS)), (k % len(ERRORS)).cast("int"))
    answer = E.fetch_error(F.when(k % 4 == 1, BENIGN_STATUSES[0]).otherwise(200), F.when(k % 4 == 2, "Image/PNG").otherwise("text/HTML; x"), F.when(k % 4 == 0, "lost"))
    return table(spark, sf_dir, "part").select(K, E.http_status(error).alias("status"), E.benign_error(error).alias("benign"), answer.alias("fetch_error"))


@book.query(
    """WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN DATE '2023-05-06' WHEN 1 THEN DATE '2030-01-01' END AS a, CASE WHEN p_partkey % 4 = 0 THEN DATE '2023-06-01' END AS b, CASE p_partkey % 5 WHEN 0 THEN DATE '2023-07-04' WHEN 1 THEN DATE '2024-12-31' WHEN 2 THEN DATE '2021-03-01' END AS c FROM part)
SELECT p_partkey, coalesce(strftime(greatest(CASE WHEN a <= DATE '2024-01-20' THEN a END, CASE WHEN b <= DATE '2024-01-20' THEN b END, CASE WHEN c <= DATE '2024-01-20' THEN c END), '%Y-%m-%d'), '') AS newest FROM x"""
)
def evidence_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest date that backs a score: of the last investment, the last fund, or the newest one in the texts; not of the future."""
    k = F.col(K)
    today = F.lit("2024-01-20").cast("date")
    text = F.when(k % 5 == 0, "On July 4, 2023 and 2020-01-02 they led.").when(k % 5 == 1, "Due Dec 31, 2024; was 2023-02-02").when(k % 5 == 2, "March 2021 news").otherwise("no date")
    invested, fund = F.when(k % 3 == 0, "06-May-2023").when(k % 3 == 1, "2030-01-01"), F.when(k % 4 == 0, "2023/6/1")
    rows = table(spark, sf_dir, "part").select(K, E.evidence_date(invested, fund, text, today).alias("newest"))
    return rows.select(K, F.coalesce(F.date_format("newest", "yyyy-MM-dd"), F.lit("")).alias("newest"))


@book.query("SELECT p_partkey, CASE WHEN p_partkey % 11 >= 5 THEN 'Active' ELSE 'Inactive' END AS active, array_to_string(list_filter([p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'even' END, 'c', 'd', 'e', 'f', 'g'], lambda x: x IS NOT NULL)[1:6], ' | ') AS summary, (['b', 'a'] || CASE WHEN p_partkey % 3 = 0 THEN ['c'] ELSE [] END)::VARCHAR AS firsts FROM part")
def report_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    parts = F.array(F.col("p_brand"), F.when(k % 2 == 0, "even").otherwise(""), *map(F.lit, "cdefg"))
    items = F.concat(strings(["b", "a", "b"]), F.when(k % 3 == 0, strings(["c", "a"])).otherwise(strings(["b"])))
    first = E.distinct_in_order(items)
    return table(spark, sf_dir, "part").select(K, E.active_label(k % 11).alias("active"), E.evidence_summary(parts).alias("summary"), F.concat(F.lit("["), F.array_join(first, ", "), F.lit("]")).alias("firsts"))


@book.query(
    f"""WITH {MERGED} SELECT p_partkey, name, website, description, CASE WHEN length(trim(site_text)) <= 400 THEN trim(site_text) END AS site_summary, CASE WHEN site_careers <> '' THEN 2 ELSE 0 END AS n_buckets,
  array_to_string(list_distinct_in_order, ',') AS urls, ({' + '.join(f"({k} <> '')::INT" for k in QUERY_KEYS)})::INT AS n_snippets FROM (SELECT *, found_official_urls || list_filter(found_news_urls, lambda u: NOT list_contains(found_official_urls, u)) AS list_distinct_in_order FROM g)"""
)
def debug_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms of what an investor's scores were made of."""
    d = F.col("debug")
    rows = E.debug_record(E.merged_evidence(made(spark, sf_dir)))
    return rows.select(K, d.raw_input["name"].alias("name"), d.raw_input.website.alias("website"), d.raw_input.description.alias("description"), d.website_evidence.summary.alias("site_summary"), F.size(d.website_evidence.by_category_summary).alias("n_buckets"), F.array_join(d.search_evidence.source_urls, ",").alias("urls"), F.size(d.search_evidence.snippet_summary).alias("n_snippets"))


@book.query("""SELECT page_id, CASE WHEN has THEN 1 ELSE 0 END AS n_urls, CASE WHEN has THEN 1 ELSE 6 END AS n_buckets, 0 AS n_errors, CASE WHEN has THEN length(url) ELSE 0 END::INT AS n_text, 0 AS n_found, 6 AS n_found_buckets, '' AS texts FROM (SELECT page_id, url, contains(html, '<article') AS has FROM pages)""")
def empty_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that were read, and what stands for those whose page has no article, beside a search that was not made."""
    pages = table(spark, sf_dir, "pages").withColumns({"none": E.empty_site(), "search": E.empty_search()})
    none = F.col("none")
    read = none.withField("source_urls", F.array("url")).withField("combined_text", F.col("url")).withField("text_by_category", F.create_map(F.lit("general"), F.col("url")))
    rows = pages.withColumn("site", F.when(F.contains("html", F.lit("<article")), read).otherwise(none))
    return rows.select("page_id", F.size("site.source_urls").alias("n_urls"), F.size("site.text_by_category").alias("n_buckets"), F.size("site.notes.errors").alias("n_errors"), F.length("site.combined_text").alias("n_text"), F.size("search.official_urls").alias("n_found"), F.size("search.official_by_category").alias("n_found_buckets"), F.concat(*[F.col(f"search.{k}") for k in QUERY_KEYS]).alias("texts"))


# ---- whole runs; failures of each stage are planted by key


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up parts as the stages outside would answer for them, in JSON."""
    k = F.col(K)
    by = F.when(k % 37 == 4, "[1]").otherwise(F.to_json("site_by"))
    site = F.to_json(F.struct(F.col("site_text").alias("combined_text"), F.col("site_urls").alias("source_urls"), F.col("site_errors").alias("errors"), F.col("site_warnings").alias("warnings")))
    # the map goes in as it is, so that a wrong one can be planted
    site = F.concat(F.regexp_replace(site, r"\}$", ""), F.when(site == "{}", "").otherwise(", "), F.lit('"text_by_category": '), F.coalesce(by, F.lit("null")), F.lit("}"))
    search = F.struct(*QUERY_KEYS, F.col("found_official").alias("official"), F.col("found_news").alias("news"), F.col("found_official_urls").alias("official_urls"), F.col("found_news_urls").alias("news_urls"), "query_errors", "query_warnings", "scrape_errors", "scrape_warnings")
    return made(spark, sf_dir).withColumns({
        "discovery": F.when(k % 6 == 0, '{"website": "https://found.com"}').when(k % 6 == 4, "{}"), "discovery_error": F.when(k % 6 == 2, "timeout"), "site": F.when(k % 29 == 2, "{").otherwise(site), "site_error": F.when(k % 23 == 1, "http 503"),
        "search": F.to_json(search), "search_error": F.when(k % 31 == 3, "refused"), "n7": F.when(k % 41 == 5, "many").otherwise("1"),
    }).drop("notes", "site_text", "site_urls", "site_by", "site_errors", "site_warnings", "found_official", "found_news", "found_official_urls", "found_news_urls", "found_by", *QUERY_KEYS, "query_errors", "query_warnings", "scrape_errors", "scrape_warnings")


_NO_SITE, _NO_SEARCH = "(p_partkey % 23 = 1 OR p_partkey % 29 = 2)", "p_partkey % 31 = 3"
_SITE_ERROR = "CASE WHEN p_partkey % 23 = 1 THEN 'http 503' ELSE 'unreadable answer' END"
RUNS = f"""{MADE}, y AS (SELECT * REPLACE ({", ".join(f"CASE WHEN {_NO_SITE} THEN {e} ELSE {n} END AS {n}" for n, e in (("site_text", "''"), ("site_urls", "[]"), ("site_warnings", "[]"), ("site_errors", f"[{_SITE_ERROR}]")))},
  {", ".join(f"CASE WHEN {_NO_SEARCH} THEN {e} ELSE {n} END AS {n}" for n, e in [*((k, "''") for k in (*QUERY_KEYS, "found_official", "found_news")), *((k, "[]") for k in ("found_official_urls", "found_news_urls", "query_warnings", "scrape_errors", "scrape_warnings")), ("query_errors", "['refused']")])}, [] AS notes),
  CASE WHEN website <> '' THEN website WHEN p_partkey % 6 = 0 THEN 'https://found.com' ELSE '' END AS effective FROM i),
x AS (SELECT * REPLACE (CASE WHEN effective <> '' AND len(site_urls) > 0 THEN '' ELSE outreach_text END AS outreach_text) FROM y), {FLAGS.replace("FROM i)", "FROM x)")},
z AS (SELECT *, NOT {_NO_SITE} AND p_partkey % 37 = 4 AS unmerged, p_partkey % 41 = 5 AS unscored FROM h), zz AS (SELECT *, list_sort(list_concat(failed, list_filter([CASE WHEN unmerged THEN 'merge_failed' END, CASE WHEN unscored THEN 'scoring_failed' END], lambda x: x IS NOT NULL))) AS reasons FROM z)"""


@book.query(
    f"""WITH {RUNS} SELECT p_partkey, CASE WHEN len(reasons) > 0 THEN 'partial_failure' ELSE 'success' END AS status, coalesce(reasons[1], '') AS failure_reason, has_site, has_search, unscored, array_to_string(list_concat(list_filter([
  CASE WHEN website = '' THEN CASE p_partkey % 6 WHEN 0 THEN 'website discovered via search: https://found.com' WHEN 2 THEN 'website discovery failed: timeout' ELSE 'website missing and no confident official website discovered' END END,
  CASE WHEN {_NO_SITE} THEN 'website evidence failed: ' || {_SITE_ERROR} END,
  'search strategy: ' || CASE WHEN effective = '' THEN 'official_website_missing_or_not_discovered' WHEN has_site THEN 'augment_official_crawl_with_public_signals' ELSE 'website_evidence_weak_or_missing' END,
  CASE WHEN {_NO_SEARCH} THEN 'search evidence failed: refused' END, CASE WHEN unmerged THEN 'merge failed: site texts by bucket are no map' END, CASE WHEN unscored THEN 'scoring failed: n7 can''t be read: many' END], lambda x: x IS NOT NULL),
  list_transform(warned, lambda w: 'warning: ' || w), list_transform(reasons, lambda w: 'failure: ' || w)), '; ') AS notes, CASE WHEN unscored THEN 0 ELSE 3 END AS recent FROM zz"""
)
def investor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a part, whatever failed on the way."""
    rows = R.run(answers(spark, sf_dir), F.lit("2024-06-01").cast("date"))
    scores = F.col("record.scores")
    return rows.select(K, "status", "failure_reason", "has_site", "has_search", F.array_contains(scores["fit_evidence"], "fit[0]: scoring unavailable").alias("unscored"), F.array_join("record.processing_notes", "; ").alias("notes"), scores["intent_breakdown"]["Recent Investment"].alias("recent"))


@book.query(
    f"""WITH {RUNS}, c AS (SELECT coalesce(reasons[1], '') AS r, count(*) AS n FROM zz GROUP BY 1) SELECT 'investors_processed' AS what, count(*) AS n FROM zz UNION ALL SELECT 'succeeded', count(*) FILTER (len(reasons) = 0) FROM zz UNION ALL SELECT 'no_website_evidence', count(*) FILTER (NOT has_site) FROM zz UNION ALL SELECT r, n FROM c WHERE r <> ''
  UNION ALL SELECT * FROM (SELECT unnest(['discovery stage', 'site stage', 'search stage', 'merge stage', 'scoring stage']) AS what, unnest([count(*) FILTER (p_partkey % 6 = 2), count(*) FILTER ({_NO_SITE}), count(*) FILTER ({_NO_SEARCH}), count(*) FILTER (unmerged), count(*) FILTER (unscored)]) AS n FROM zz) WHERE n > 0"""
)
def investor_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are observed while the records are written."""
    seen = Observation()
    R.observed(R.run(answers(spark, sf_dir), F.lit("2024-06-01").cast("date")), seen).select("record").write.format("noop").mode("overwrite").save()
    s = R.summary(seen)
    counts = [(k, s[k]) for k in ("investors_processed", "succeeded", "no_website_evidence")] + list(s["partial_failure_reason_counts"].items()) + [(f"{k} stage", n) for k, n in s["stage_errors"].items()]
    return spark.createDataFrame(counts, "what string, n long")
