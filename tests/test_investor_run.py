"""A run whose stages fail, one by one: each investor keeps its row, and the counts come without a second pass."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyforge.functions.fixed import REPORT_COLUMNS
from tallyforge.operators import investor_run as R

SITE = {"combined_text": "Fintech seed fund. Payments portfolio, lending. " * 4, "source_urls": ["https://acme.com/"], "text_by_category": {"careers": "hiring analyst"}, "errors": [], "warnings": []}
SEARCH = {"recent_deal_text": "led a seed round in payments", "official_urls": [], "news_urls": ["https://news.com/a"], "query_errors": [], "news": "announced a fund"}
GOOD = {
    "name": "Acme", "website": "acme.com", "description": "Fintech payments, banking and lending seed fund in Texas", "preferred_industry": "fintech", "hq_location": "Dallas, Texas", "n7": "2", "n6m": "3", "n12m": "4", "low": "500000", "high": "2e6", "last_date": "2024-05-30",
    "site": json.dumps(SITE), "search": json.dumps(SEARCH),
}
CASES = {
    "good": {}, "found": {"website": "", "discovery": '{"website": "https://acme.com"}'}, "unfound": {"website": "", "discovery": "{}"}, "discovery": {"website": None, "discovery_error": "timeout"},
    "site": {"site": None, "site_error": "http 500"}, "site_json": {"site": "{broken"}, "search": {"search": "", "search_error": "refused"}, "nothing": {"site_error": "x", "search_error": "y"},
    "merge": {"site": json.dumps(SITE | {"text_by_category": [1, 2]})}, "scoring": {"n7": "many"}, "date": {"last_date": "soonish"}, "nameless": {"name": None}, "empty": dict.fromkeys(GOOD),
}


@pytest.fixture(scope="module")
def done(spark):
    names = ["id", *GOOD, "discovery", "discovery_error", "site_error", "search_error"]
    rows = [tuple({**GOOD, **change, "id": k}.get(n) for n in names) for k, change in CASES.items()]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    seen = Observation()
    out = {r.id: r for r in R.observed(R.run(df, F.lit("2024-06-01").cast("date")), seen).collect()}
    return out, R.summary(seen)


def test_each_investor_keeps_its_row(done):
    rows, _ = done
    assert set(rows) == set(CASES)
    assert all(set(r.report) == set(REPORT_COLUMNS) for r in rows.values())
    errors = {k: {s: e for s, e in r.record.stage_errors.asDict().items() if e} for k, r in rows.items()}
    assert errors == {
        "good": {}, "found": {}, "unfound": {}, "nameless": {}, "discovery": {"discovery": "timeout"}, "site": {"site": "http 500"}, "site_json": {"site": "unreadable answer"}, "search": {"search": "refused"}, "nothing": {"site": "x", "search": "y"},
        "merge": {"merge": "site texts by bucket are no map"}, "scoring": {"scoring": "n7 can't be read: many"}, "date": {"scoring": "last_date can't be read: soonish"}, "empty": {"discovery": "no answer", "site": "no answer", "search": "no answer"},
    }


def test_status_and_notes(done):
    rows, _ = done
    assert {k: (r.status, r.failure_reason) for k, r in rows.items() if r.status != "success"} == {
        "search": ("partial_failure", "ddgs_query_failed"), "nothing": ("partial_failure", "ddgs_query_failed"), "merge": ("partial_failure", "merge_failed"), "scoring": ("partial_failure", "scoring_failed"), "date": ("partial_failure", "scoring_failed"), "empty": ("partial_failure", "ddgs_query_failed"),
    }
    assert rows["found"].notes[0] == "website discovered via search: https://acme.com"
    assert rows["unfound"].notes[:2] == ["website missing and no confident official website discovered", "search strategy: official_website_missing_or_not_discovered"]
    assert rows["discovery"].notes[0] == "website discovery failed: timeout"
    assert rows["site"].notes[0] == "website evidence failed: http 500" and "warning: website_unreachable_but_search_available" in rows["site"].notes
    assert "result row is missing investor name" in rows["nameless"].notes and rows["nameless"].notes[0] == "missing required field: name"


def test_scores(done):
    rows, _ = done
    good = rows["good"].record.scores
    assert good.fit_breakdown == {"Sector Match": 3, "Stage Match": 2, "Check Size Match": 2, "Geography Match": 1, "Strategic Alignment": 2}
    assert good.intent_breakdown["Recent Investment"] == 3 and good.intent_breakdown["Hiring"] == 1
    assert good.fit_evidence[0] == "fit[3]: Sector Match"
    assert good.total == good.fit + good.intent and rows["good"].report["Signal Score"] == str(good.score_100)
    # no scores without figures, but the merged texts stay
    assert rows["scoring"].record.scores.total == 0 and rows["scoring"].record.scores.fit_evidence == ["fit[0]: scoring unavailable"] and rows["scoring"].merged_sector == rows["good"].merged_sector
    # merged from the sheet alone, while the record keeps what was found
    assert "payments portfolio" not in rows["merge"].merged_sector and rows["merge"].site_urls == ["https://acme.com/"]
    assert rows["site"].record.scores.fit == 10


def test_counts_without_a_second_pass(done):
    rows, counts = done
    first = [r.failure_reason for r in rows.values() if r.failure_reason]
    assert counts["investors_processed"] == len(CASES) and counts["succeeded"] == len(CASES) - len(first) and counts["partially_failed"] == len(first)
    assert counts["partial_failure_reason_counts"] == {r: first.count(r) for r in set(first)}
    assert counts["stage_errors"] == {"discovery": 2, "site": 4, "search": 3, "merge": 1, "scoring": 2}


def test_no_rows(spark):
    df = spark.createDataFrame([], ", ".join(f"{n} string" for n in [*GOOD, "discovery", "discovery_error", "site_error", "search_error"]))
    seen = Observation()
    assert R.observed(R.run(df, F.lit("2024-06-01").cast("date")), seen).collect() == []
    assert R.summary(seen)["investors_processed"] == 0


def test_parts_are_dealt_over_all_cores(spark, sf):
    """A small file makes one partition, and the run's long expressions are work for every core."""
    from tallyforge.plans import evidence

    assert evidence.answers(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
