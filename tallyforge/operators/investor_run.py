"""The whole run of an investor in one plan: stages whose failures are data, the report row, the debug record, the run's counts.

A row holds the sheet's fields as texts, and what outside stages answered: `discovery`, `site`, `search` (JSON texts) with
`discovery_error`, `site_error`, `search_error` (null: none). A stage gives a value or an error, never an exception: an answer
that is missing or is no JSON of its form, a bucket map that can't be merged or a figure that is no number is that stage's error
in that row. The next stages go on with the stage's empty value, so every investor has one report row and one record.

Everything is a function of the row, so the run needs no shuffle; its counts are observed while its rows are written.
Defined cases: null fields are empty, repeated rows stay, an empty table gives no rows and counts of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.functions import fixed as V
from tallyforge.functions.dates import any_date, dates_in_text, recent_points
from tallyforge.functions.text import clean_text, field_blob, hits, strings
from tallyforge.operators import evidence as E
from tallyforge.operators import phrases as P
from tallyforge.operators import profile as PR
from tallyforge.operators import signals as S

LISTS = "array<string>"
DISCOVERY = "website string, source_url string"
SITE = f"combined_text string, source_urls {LISTS}, text_by_category string, errors {LISTS}, warnings {LISTS}"
SEARCH = ", ".join(f"{k} string" for k in V.QUERY_KEYS) + f", official string, news string, official_by_category string, official_urls {LISTS}, news_urls {LISTS}, query_errors {LISTS}, query_warnings {LISTS}, scrape_errors {LISTS}, scrape_warnings {LISTS}"
#: Figures of the sheet, as texts; empty: not stated.
COUNTS, AMOUNTS, DATES = ("n7", "n6m", "n12m"), ("low", "high", "middle"), ("last_date", "close_date")
TEXTS = ("name", "website", "fund_name", "fundraising", "last_company")
FIELDS = tuple(dict.fromkeys([*TEXTS, *[n for names in E.SHEET.values() for n in names], "latest_note", *COUNTS, *AMOUNTS, *DATES]))
STAGES = ("discovery", "site", "search", "merge", "scoring")
REASONS = ("website_unreachable", "ddgs_query_failed", "search_scrape_failed", "no_web_evidence", "merge_failed", "scoring_failed", "validation_failed")


def attempt(value: Column, error: Column) -> Column:
    """A stage's outcome: its value, or why there is none."""
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def answered(raw: Column, failure: Column, schema: str) -> Column:
    """The outcome of a stage outside of Spark, from its answer's JSON and the failure noted for it."""
    value = F.from_json(raw, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    error = F.when(F.coalesce(failure, F.lit("")) != "", failure).when(F.trim(F.coalesce(raw, F.lit(""))) == "", "no answer").when(value["_bad"].isNotNull(), "unreadable answer")
    return attempt(value, error)


def _noted(stage: str, message: str) -> Column:
    error = F.col(f"{stage}_stage.error")
    return F.when(error.isNotNull(), F.concat(F.lit(f"{message} failed: "), error))


def _with_notes(rows: DataFrame, *notes: Column) -> DataFrame:
    return rows.withColumn("notes", F.concat("notes", F.array_compact(F.array(*notes))))


def _each(items: Column, text, before: str) -> Column:
    """The text of each item, after `before`."""
    return F.transform(items, lambda x: F.concat(F.lit(before), text(x)))


def _buckets(raw: Column) -> Column:
    return F.from_json(raw, "map<string,string>")


def gathered(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows through discovery, site and search: the columns that merging and reliability read, notes in the order of the stages."""
    c = F.col
    rows = rows.withColumns({n: clean_text(c(n)) if n in rows.columns else F.lit("") for n in FIELDS})
    rows = rows.withColumn("notes", E.input_warnings({"name": c("name")}, c("website")))
    asked = c("website") == ""
    rows = rows.withColumn("discovery_stage", F.when(asked, answered(c("discovery"), c("discovery_error"), DISCOVERY)))
    found = F.coalesce(c("discovery_stage.value.website"), F.lit(""))
    rows = rows.withColumn("effective_website", F.when(asked, found).otherwise(c("website")))
    quiet = asked & c("discovery_stage.error").isNull()
    rows = _with_notes(rows, F.when(quiet & (found != ""), F.concat(F.lit("website discovered via search: "), found)), F.when(quiet & (found == ""), "website missing and no confident official website discovered"), _noted("discovery", "website discovery"))

    rows = rows.withColumn("site_stage", answered(c("site"), c("site_error"), SITE))
    rows = _with_notes(rows, _noted("site", "website evidence"))
    site, none = c("site_stage.value"), F.array().cast(LISTS)
    rows = rows.withColumns({
        "site_text": F.coalesce(site["combined_text"], F.lit("")), "site_urls": F.coalesce(site["source_urls"], none), "site_warnings": F.coalesce(site["warnings"], none),
        "site_errors": F.when(c("site_stage.error").isNotNull(), F.array(c("site_stage.error"))).otherwise(F.coalesce(site["errors"], none)),
    })

    newest = F.datediff(as_of, F.array_max(dates_in_text(c("site_text"), as_of)))
    found_site = (F.size("site_urls") > 0) | (F.length(F.trim("site_text")) >= V.LEAST_SITE_CHARS)
    missing = c("effective_website") == ""
    rows = rows.withColumns({
        "query_keys": F.when(missing, strings(V.QUERY_KEYS)).otherwise(PR.query_keys(F.size("site_urls"), c("site_text"))),
        "strategy_reason": F.when(missing, "official_website_missing_or_not_discovered").otherwise(E.strategy_reason(found_site, PR.recently_active(F.lower("site_text"), newest))),
    })
    rows = _with_notes(rows, F.concat(F.lit("search strategy: "), c("strategy_reason")))

    rows = rows.withColumn("search_stage", answered(c("search"), c("search_error"), SEARCH))
    rows = _with_notes(rows, _noted("search", "search evidence"))
    search = c("search_stage.value")
    lists = {"found_official_urls": "official_urls", "found_news_urls": "news_urls", "query_warnings": "query_warnings", "scrape_errors": "scrape_errors", "scrape_warnings": "scrape_warnings"}
    return rows.withColumns({
        **{k: F.when(F.array_contains("query_keys", k), F.coalesce(search[k], F.lit(""))).otherwise("") for k in V.QUERY_KEYS}, "found_official": F.coalesce(search["official"], F.lit("")), "found_news": F.coalesce(search["news"], F.lit("")),
        **{k: F.coalesce(search[v], none) for k, v in lists.items()}, "query_errors": F.when(c("search_stage.error").isNotNull(), F.array(c("search_stage.error"))).otherwise(F.coalesce(search["query_errors"], none)),
    })


def merged(rows: DataFrame) -> DataFrame:
    """rows with merged texts; where texts by bucket are no map of texts, merged from the sheet alone."""
    c = F.col
    site_by, found_by = c("site_stage.value.text_by_category"), c("search_stage.value.official_by_category")
    wrong = F.when(site_by.isNotNull() & _buckets(site_by).isNull(), "site texts by bucket are no map").when(found_by.isNotNull() & _buckets(found_by).isNull(), "search texts by bucket are no map")
    rows = _with_notes(rows.withColumn("merge_stage", attempt(F.struct(_buckets(site_by).alias("site_by"), _buckets(found_by).alias("found_by")), wrong)), F.when(wrong.isNotNull(), F.concat(F.lit("merge failed: "), wrong)))
    used = ("site_text", "found_official", "found_news", "site_urls", "found_official_urls", "found_news_urls", *V.QUERY_KEYS)
    # merging reads emptied columns in failed rows; what was found stays for reliability and the record
    fine = c("merge_stage.error").isNull()
    work = rows.withColumns({f"was_{n}": c(n) for n in used}).withColumns({n: F.when(fine, c(n)) for n in used} | {"site_by": c("merge_stage.value.site_by"), "found_by": c("merge_stage.value.found_by")})
    out = E.merged_evidence(work)
    return out.withColumns({n: c(f"was_{n}") for n in used}).drop(*[f"was_{n}" for n in used])


def scored(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows with fit, intent and total, their points by name, and evidence phrases; zeros where a figure can't be read."""
    c = F.col
    kinds = {**dict.fromkeys(COUNTS, "bigint"), **dict.fromkeys(AMOUNTS, "double")}
    read = {n: c(n).try_cast(t) for n, t in kinds.items()} | {n: any_date(c(n)) for n in DATES}
    errors = [F.when((c(n) != "") & v.isNull(), F.concat(F.lit(f"{n} can't be read: "), F.substring(c(n), 1, 80))) for n, v in read.items()]
    rows = rows.withColumn("scoring_stage", attempt(F.struct(*[(F.coalesce(v, F.lit(0)) if n in COUNTS else v).alias(n) for n, v in read.items()]), F.coalesce(*errors)))
    rows = _with_notes(rows, _noted("scoring", "scoring"))
    f = {n: c(f"scoring_stage.value.{n}") for n in read}
    blobs = {k: field_blob(*map(c, names)) for k, names in E.SHEET.items()}
    inst = S.institutional(blobs["sector"])
    points = recent_points(f["last_date"], as_of)
    close_age = F.datediff(as_of, f["close_date"])
    named, flagged = c("fund_name") != "", c("fundraising") != ""
    age = F.datediff(as_of, F.array_max(dates_in_text(c("merged_recent"), as_of)))
    warm = S.warm_signals(c("merged_geo"), c("merged_sector"), c("merged_public"), c("merged_recent"), c("description") != "")
    rows = rows.withColumns({"warm_signals": warm, "close_age": close_age, "web_age": age})
    parts = {
        "fit": dict(zip(V.FIT_KEYS, (S.fit_sector(blobs["sector"], c("merged_sector"), inst), S.fit_stage(c("merged_stage"), inst), S.fit_check(f["low"], f["high"], f["middle"]), S.fit_geography(c("merged_geo")), S.fit_strategic(blobs["strategic"], c("merged_strategic"), inst)), strict=True)),
        "intent": dict(zip(V.INTENT_KEYS, (S.intent_recent(f["n7"], f["n6m"], f["n12m"], points, c("web_age"), c("merged_recent")), S.intent_fund(named, c("close_age"), F.lit(False), flagged, c("merged_fund")), S.intent_hiring(c("merged_hiring")), S.intent_public(points, c("merged_public")), S.intent_warm(F.size("warm_signals"))), strict=True)),
    }
    fine = c("scoring_stage.error").isNull()
    for kind, by in parts.items():
        made = F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.coalesce(v.cast("int"), F.lit(0)))])
        rows = rows.withColumn(f"{kind}_points", F.when(fine, made).otherwise(E.empty_points(tuple(by))))
        shown = _each(F.map_entries(f"{kind}_points"), lambda e: F.concat(F.lit("["), e.value, F.lit("]: "), e.key), kind)
        rows = rows.withColumns({f"{kind}_score": F.least(F.lit(10), E.map_sum(c(f"{kind}_points"))), f"{kind}_evidence": F.when(fine, shown).otherwise(strings([f"{kind}[0]: scoring unavailable"]))})
    return rows.withColumn("total", c("fit_score") + c("intent_score"))


def run(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows with status, failure and warning reasons, notes, `report` (a map of the report's columns to texts) and `record`."""
    c = F.col
    rows = scored(merged(gathered(rows, as_of)), as_of)
    rows = rows.withColumn("notes", F.concat("notes", E.score_issues(c("fit_score"), c("fit_points"), c("intent_score"), c("intent_points"), c("total"))))
    rows = E.reliability(rows)
    f = {n: c(f"scoring_stage.value.{n}") for n in (*COUNTS, *DATES)}
    counts = {n: F.coalesce(f[n], F.lit(0)) for n in COUNTS}
    p = {k: c("fit_points")[k] for k in V.FIT_KEYS} | {k: c("intent_points")[k] for k in V.INTENT_KEYS}
    sector, stage, checks, geo, _, recent, fund, hiring, public, _ = p.values()
    named, flagged = F.when(c("fund_name") != "", c("fund_name")), c("fundraising") != ""
    rows = rows.withColumn("recency", S.recency(*counts.values(), F.datediff(as_of, f["last_date"]), c("close_age"), c("web_age"), hits(c("merged_recent"), V.ACTIVITY_TERMS)))
    fresh = c("recency").isin(*S.FRESH)
    rows = rows.withColumns({"score_100": S.score_100(c("total")), "confidence": S.confidence(c("has_site").cast("int") + c("has_search").cast("int"), c("total"), fresh), "warm_label": S.warm_label(F.size("warm_signals"))})
    rows = rows.withColumn("probability", S.probability(c("score_100"), c("confidence")))
    reason = P.reason(P.activity_clause(*counts.values(), c("last_company"), f["last_date"], as_of, sector), P.fund_clause(named, c("close_age"), f["close_date"], flagged), sector, stage, checks, geo, recent, fund, hiring, public, c("fit_score"), c("intent_score"))
    present = c("merge_debug.present")
    cells = [
        c("name"), c("score_100"), c("probability"), S.signal_type(recent, fund, public, sector, flagged), S.sector_relevance(sector), S.check_label(checks), c("warm_label"), c("recency"), c("confidence"), reason,
        S.action(c("score_100"), c("warm_label"), fresh, c("intent_score")), S.signal_bucket(c("score_100"), fresh, c("intent_score")), S.urgency(c("score_100"), c("recency"), c("intent_score")),
        S.data_sources(present["sheet"], present["official"], present["news"], present["snippets"]), F.coalesce(F.date_format(E.evidence_date(c("last_date"), c("close_date"), c("merged_recent"), as_of), "yyyy-MM-dd"), F.lit("")),
    ]
    rows = rows.withColumn("report", F.create_map(*[x for k, v in zip(V.REPORT_COLUMNS, cells, strict=True) for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]))
    said = [_each(c(n), lambda r: r, w) for n, w in (("warning_reasons", "warning: "), ("failure_reasons", "failure: "))]
    rows = rows.withColumn("notes", F.concat("notes", E.row_issues(c("report")), *said))
    rows = E.debug_record(rows)
    scores = F.struct(
        c("fit_score").alias("fit"), c("intent_score").alias("intent"), c("total"), c("score_100"), c("probability").alias("investment_probability"), c("warm_signals").alias("warm_intro_signals"),
        c("fit_points").alias("fit_breakdown"), c("intent_points").alias("intent_breakdown"), c("fit_evidence"), c("intent_evidence"),
    )
    head = F.struct(
        c("name").alias("investor"), c("website"), c("status"), c("failure_reason"), c("failure_reasons"), c("warning_reasons"), c("notes").alias("processing_notes"), c("report").alias("business_output"),
        *[c(f"debug.{n}").alias(n) for n in ("raw_input", "website_evidence", "search_evidence", "merged_evidence")], scores.alias("scores"),
        F.struct(*[c(f"{s}_stage.error").alias(s) for s in STAGES]).alias("stage_errors"),
    )
    return rows.withColumn("record", head)


def observed(done: DataFrame, seen: Observation) -> DataFrame:
    """done, whose counts are in `seen` once its rows were written: no second pass."""
    counts = [F.count(F.lit(1)).alias("investors"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(~F.col("has_site")).alias("no_website_evidence")]
    counts += [F.count_if(F.col("failure_reason") == r).alias(r) for r in REASONS]
    counts += [F.count_if(F.col(f"{s}_stage.error").isNotNull()).alias(f"{s}_errors") for s in STAGES]
    return done.observe(seen, *counts)


def summary(seen: Observation) -> dict:
    """The run's summary from what was observed."""
    n = {k: v or 0 for k, v in seen.get.items()}
    return {
        "investors_processed": n.get("investors", 0), "succeeded": n.get("succeeded", 0), "partially_failed": n.get("investors", 0) - n.get("succeeded", 0), "no_website_evidence": n.get("no_website_evidence", 0),
        "partial_failure_reason_counts": {r: n[r] for r in REASONS if n.get(r)}, "stage_errors": {s: n[f"{s}_errors"] for s in STAGES if n.get(f"{s}_errors")},
    }
