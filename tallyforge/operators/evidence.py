"""Evidence of one entity: merged texts, validation, reliability, run summary. Column -> Column over one row's columns.

Columns of an evidence row: the sheet's fields; site_text, site_urls, site_by (texts by bucket); found_official,
found_news, found_official_urls, found_news_urls, found_by; the five snippet texts of the query families; and the lists
site_errors, site_warnings, query_errors, query_warnings, scrape_errors, scrape_warnings, notes. All may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import fixed as V
from tallyforge.functions.dates import any_date, dates_in_text
from tallyforge.functions.text import clean_text, field_blob, has_any, strings, summarize, tiered_merge
from tallyforge.functions.urls import domain

#: Sheet fields of each merged text.
SHEET = {
    "sector": ("description", "preferred_industry", "preferred_verticals", "all_industries", "keywords", "primary_industry_sector", "primary_industry_group"),
    "stage": ("primary_type", "other_types", "preferred_investment_types", "description"),
    "geo": ("hq_location", "hq_city", "hq_state", "hq_country", "preferred_geography"),
    "strategic": ("description", "preferred_industry", "preferred_verticals", "keywords", "latest_note", "last_investment_company"),
}
SNIPPETS = V.QUERY_KEYS[:4]


def sector_terms(sector: str = V.TARGET_SECTOR) -> list[str]:
    return list(V.SECTOR_TERMS.get(sector.lower(), [sector.lower()]))


def stage_terms(stage: str = V.TARGET_STAGE) -> list[str]:
    return list(V.STAGE_TERMS.get(stage.lower(), [stage.lower()]))


def place_terms(place: str = V.TARGET_GEOGRAPHY) -> list[str]:
    return [place.lower(), *(V.TARGET_US_PLACES if place.lower() in V.TARGET_US else ())]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def joined(*parts: Column) -> Column:
    """What is not empty, by single blanks, in lower case."""
    return F.lower(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " "))


def by_bucket(site: Column, found: Column, bucket: str) -> Column:
    """The texts of a bucket from the site and from search."""
    a, b = (F.coalesce(F.try_element_at(m, F.lit(bucket)), F.lit("")) for m in (site, found))
    return F.lower(F.trim(F.concat(a, F.lit(" "), b)))


def merged_evidence(rows: DataFrame, sector: str = V.TARGET_SECTOR, stage: str = V.TARGET_STAGE, place: str = V.TARGET_GEOGRAPHY) -> DataFrame:
    """rows with the eight merged texts and the struct merge_debug."""
    official = F.lower(F.trim(F.concat(_text("site_text"), F.lit(" "), _text("found_official"))))
    news = F.lower(_text("found_news"))
    snippet = F.lower(F.array_join(F.array(*map(_text, SNIPPETS)), " "))
    sheet = {k: field_blob(*map(F.col, names)) for k, names in SHEET.items()}
    rows = rows.select("*", official.alias("_official"), news.alias("_news"), snippet.alias("_snippet"), sheet["sector"].alias("_sheet"))
    o, n, q = F.col("_official"), F.col("_news"), F.col("_snippet")

    def tiered(name: str, terms: list[str], thin: int) -> Column:
        return tiered_merge(sheet[name], o, n, q, terms, thin)

    urls = F.array_distinct(F.concat(_list("site_urls"), _list("found_official_urls")))
    careers = by_bucket(F.col("site_by"), F.col("found_by"), "careers")
    context = joined(o, n, q)
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        tiered("sector", sector_terms(sector), V.MERGE_THIN).alias("merged_sector"), tiered("stage", stage_terms(stage), V.MERGE_THIN).alias("merged_stage"),
        tiered("geo", place_terms(place), V.MERGE_THIN_GEO).alias("merged_geo"), tiered("strategic", sector_terms(sector), V.MERGE_THIN).alias("merged_strategic"),
        context.alias("merged_recent"), context.alias("merged_fund"), joined(o, n, _text("hiring_text"), careers).alias("merged_hiring"), joined(clean_text(F.col("latest_note")), o, n, q).alias("merged_public"),
        F.struct(
            urls.alias("official_urls"), _list("found_news_urls").alias("news_urls"),
            F.struct(*[F.length(c).alias(k) for k, c in (("sheet", F.col("_sheet")), ("official", o), ("news", n), ("snippets", q))]).alias("lengths"),
            F.struct(*[(F.trim(c) != "").alias(k) for k, c in (("sheet", F.col("_sheet")), ("official", o), ("news", n), ("snippets", q))]).alias("present"),
        ).alias("merge_debug"),
    )


# ---- validation ------------------------------------------------------------------------


def _kept(*messages: Column) -> Column:
    return F.array_compact(F.array(*messages))


def input_warnings(required: dict[str, Column], website: Column) -> Column:
    missing = [F.when(clean_text(c) == "", F.lit(f"missing required field: {name}")) for name, c in required.items()]
    return _kept(*missing, F.when((clean_text(website) != "") & (domain(clean_text(website)) == ""), "website field is present but malformed"))


def map_sum(points: Column) -> Column:
    return F.aggregate(F.map_values(points), F.lit(0), lambda a, b: a + b.cast("int"))


def score_issues(fit: Column, fit_points: Column, intent: Column, intent_points: Column, total: Column) -> Column:
    return _kept(
        F.when(map_sum(fit_points) != fit, "fit breakdown does not sum to Fit Score"),
        F.when(map_sum(intent_points) != intent, "intent breakdown does not sum to Intent Score"),
        F.when(fit + intent != total, "Fit Score + Intent Score does not equal Total Score"),
    )


def row_issues(row: Column) -> Column:
    """Problems of a report row, given as a map of its fields to texts."""
    def out_of_range(name: str) -> Column:
        return ~F.coalesce(F.try_element_at(row, F.lit(name)).try_cast("double").between(0, 100), F.lit(True))

    missing = [F.when(~F.map_contains_key(row, name), F.lit(f"missing result field: {name}")) for name in V.REPORT_COLUMNS]
    return _kept(
        *missing, F.when(F.coalesce(F.try_element_at(row, F.lit("Investor")), F.lit("")) == "", "result row is missing investor name"),
        F.when(out_of_range("Signal Score"), "Signal Score outside 0-100 range"), F.when(out_of_range("Investment Probability (%)"), "Investment Probability outside 0-100 range"),
    )


def empty_points(keys: tuple[str, ...]) -> Column:
    """A breakdown of zeros (FIT_KEYS, INTENT_KEYS)."""
    return F.create_map(*[F.lit(x) for k in keys for x in (k, 0)])


def empty_site() -> Column:
    """The evidence of a site that was not read: no text, no URLs, an empty text for each bucket, empty lists of notes."""
    none = F.array().cast("array<string>")
    notes = F.struct(*[none.alias(n) for n in ("attempted_home_urls", "attempted_page_urls", "discovered_pages", "errors", "warnings")])
    return F.struct(F.lit("").alias("combined_text"), none.alias("source_urls"), F.create_map(*[F.lit(x) for b in V.TEXT_BUCKETS for x in (b, "")]).alias("text_by_category"), notes.alias("notes"))


def empty_search() -> Column:
    """The evidence of a search that was not made: empty texts for each query family and source, empty lists of notes."""
    none = F.array().cast("array<string>")
    notes = F.struct(*[none.alias(n) for n in ("query_errors", "query_warnings", "ranked_candidates", "scrape_errors", "scrape_warnings")])
    by = F.create_map(*[F.lit(x) for b in V.TEXT_BUCKETS for x in (b, "")])
    return F.struct(*[F.lit("").alias(k) for k in V.QUERY_KEYS], F.lit("").alias("official"), F.lit("").alias("news"), by.alias("official_by_category"), none.alias("official_urls"), none.alias("news_urls"), notes.alias("notes"))


def active_label(intent: Column) -> Column:
    return F.when(intent >= V.ACTIVE_INTENT, "Active").otherwise("Inactive")


# ---- reliability -----------------------------------------------------------------------


def has_snippets() -> Column:
    out = F.lit(False)
    for k in V.QUERY_KEYS:
        out = out | (F.trim(_text(k)) != "")
    return out


def reliability(rows: DataFrame) -> DataFrame:
    """rows with status, failure_reason, failure_reasons, warning_reasons, has_site, has_search, has_any."""
    def some(name: str) -> Column:
        return F.size(_list(name)) > 0

    def noted(*fragments: str) -> Column:
        return F.exists(_list("notes"), lambda n: has_any(n, fragments))

    site = some("site_urls") | (F.length(F.trim(_text("site_text"))) >= V.LEAST_SITE_CHARS)
    search = some("found_official_urls") | some("found_news_urls") | has_snippets() | (F.length(F.trim(_text("found_news"))) >= V.LEAST_SEARCH_CHARS)
    rows = rows.withColumns({"has_site": site, "has_search": search}).withColumn("has_any", F.col("has_site") | F.col("has_search"))
    no_site, no_search, nothing, given = ~F.col("has_site"), ~F.col("has_search"), ~F.col("has_any"), _text("website") != ""
    warnings = _kept(
        F.when(~given, "website_missing_input"), F.when(some("site_warnings"), "website_fetch_degraded"), F.when(some("query_warnings"), "ddgs_query_fallback_used"), F.when(some("scrape_warnings"), "ddgs_optional_scrape_blocked"),
        F.when(some("site_errors") & no_site & F.col("has_search"), "website_unreachable_but_search_available"), F.when(some("query_errors") & F.col("has_search"), "ddgs_query_degraded_but_partial_results_available"),
        F.when(some("scrape_errors") & F.col("has_any"), "search_scrape_partially_failed"), F.when(given & no_site & ~some("site_errors"), "website_present_but_weak_evidence"),
    )
    failures = _kept(
        F.when(some("site_errors") & no_site & no_search, "website_unreachable"), F.when(some("query_errors") & no_search, "ddgs_query_failed"), F.when(some("scrape_errors") & nothing, "search_scrape_failed"), F.when(nothing, "no_web_evidence"),
        F.when(noted("merge failed"), "merge_failed"), F.when(noted("scoring failed"), "scoring_failed"), F.when(noted("does not sum", "missing result field"), "validation_failed"),
    )
    rows = rows.withColumns({"warning_reasons": F.array_sort(warnings), "failure_reasons": F.array_sort(failures)})
    return rows.withColumns({"status": F.when(F.size("failure_reasons") > 0, "partial_failure").otherwise("success"), "failure_reason": F.coalesce(F.get("failure_reasons", F.lit(0)), F.lit(""))})


def run_summary(rows: DataFrame) -> DataFrame:
    """One row: investors, succeeded, partially_failed, no_website_evidence, and the counts of first failure reasons as a map."""
    by = rows.groupBy("failure_reason").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("ok"), F.count_if(~F.col("has_site")).alias("no_site"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("failure_reason") != "", F.struct("failure_reason", "n")))))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("investors"), F.coalesce(F.sum("ok"), F.lit(0)).alias("succeeded"), (F.coalesce(F.sum("n"), F.lit(0)) - F.coalesce(F.sum("ok"), F.lit(0))).alias("partially_failed"), F.coalesce(F.sum("no_site"), F.lit(0)).alias("no_website_evidence"), counts.alias("failure_reason_counts"))


def evidence_summary(parts: Column, most: int = 6) -> Column:
    """The first parts that are not empty, separated by bars."""
    return F.array_join(F.slice(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), 1, most), " | ")


def debug_record(rows: DataFrame) -> DataFrame:
    """One struct a row: input, site and search evidence and merged texts in short forms, URL lists in first-seen order."""
    def short(c: Column, most: int = 300) -> Column:
        return summarize(F.coalesce(c, F.lit("")), most)

    def by_key(texts: Column) -> Column:
        filled = F.map_filter(F.coalesce(texts, F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v, F.lit("")) != "")
        return F.transform_values(filled, lambda k, v: short(v, V.DEBUG_CHARS))

    snippets = F.map_filter(F.create_map(*[x for k in V.QUERY_KEYS for x in (F.lit(k), short(_text(k)))]), lambda k, v: v != "")
    record = F.struct(
        F.struct(_text("name").alias("name"), _text("website").alias("website"), *[short(_text(n)).alias(n) for n in ("description", "preferred_industry", "preferred_geography")]).alias("raw_input"),
        F.struct(_list("site_urls").alias("source_urls"), short(_text("site_text"), V.DEBUG_CHARS).alias("summary"), by_key(F.col("site_by")).alias("by_category_summary")).alias("website_evidence"),
        F.struct(F.concat(_list("found_official_urls"), F.filter(_list("found_news_urls"), lambda u: ~F.array_contains(_list("found_official_urls"), u))).alias("source_urls"), snippets.alias("snippet_summary"), short(_text("found_official")).alias("official_summary"), short(_text("found_news")).alias("news_summary")).alias("search_evidence"),
        F.struct(*[short(F.col(f"merged_{n}")).alias(f"{n}_summary") for n in ("sector", "stage", "geo", "strategic", "recent")]).alias("merged_evidence"),
    )
    return rows.withColumn("debug", record)


def distinct_in_order(items: Column) -> Column:
    """Each item once, by first appearance."""
    return F.array_distinct(items)


def http_status(error: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(error, F.lit(""))), r"\bhttp (\d{3})\b", 1).try_cast("int")


def benign_error(error: Column) -> Column:
    """Errors of a fetch that say nothing against the site: refused or missing pages, other content types."""
    return F.coalesce(http_status(error).isin(*V.BENIGN_STATUSES), F.lit(False)) | F.contains(F.lower(F.coalesce(error, F.lit(""))), F.lit("unsupported content-type"))


def fetch_error(status: Column, content_type: Column, failure: Column) -> Column:
    """Why a recorded answer is no page: the failure, a status of 400 and more, a type that is no text; null: it is one."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(failure.isNotNull(), failure).when(status >= 400, F.concat(F.lit("http "), status)).when((kind != "") & ~has_any(kind, ("html", "text/plain")), F.concat(F.lit("unsupported content-type: "), kind))


def strategy_reason(found_site: Column, active: Column) -> Column:
    return F.when(~found_site, "website_evidence_weak_or_missing").when(~active, "augment_official_crawl_with_public_signals").otherwise("public_signals_collected_alongside_official_crawl")


def string_list(values: Column) -> Column:
    return F.array_join(F.coalesce(values, strings([])), "; ")


def evidence_date(last_investment: Column, last_fund: Column, text: Column, today: Column) -> Column:
    """The newest date that backs a score: of the last investment, the last fund (each in any writing), or the newest one in
    the texts; not of the future; null if there is none."""
    found = F.array(any_date(last_investment), any_date(last_fund), F.array_max(dates_in_text(text, today)))
    return F.array_max(F.filter(found, lambda d: d <= today))
