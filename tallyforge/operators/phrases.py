"""Sentences of the report: clauses on activity and funds, phrases on fit and intent, and the reason made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def activity_clause(n7: Column, n6m: Column, n12m: Column, company: Column, last: Column, as_of: Column, sector: Column, label: str = "fintech") -> Column:
    """What was invested in lately, by the shortest span that has a count, or the last known date within a year."""
    named = F.coalesce(company, F.lit("")) != ""

    def counted(n: Column, span: str, qualified: bool) -> Column:
        kind = F.when((sector >= 2) & F.lit(qualified), f"{label} ").otherwise("")
        return F.concat(F.lit("Invested in "), n, F.lit(" "), kind, F.when(n == 1, "company").otherwise("companies"), F.lit(f" in the last {span}"), F.when(named, F.concat(F.lit(", most recently "), company)).otherwise(""))

    dated = F.concat(F.lit("Last known investment in "), F.date_format(last, "MMM yyyy"), F.when(named, F.concat(F.lit(" ("), company, F.lit(")"))).otherwise(""))
    return F.when(n7 >= 1, counted(n7, "7 days", True)).when(n6m >= 1, counted(n6m, "6 months", True)).when(n12m >= 1, counted(n12m, "12 months", False)).when(F.datediff(as_of, last) <= 365, dated).otherwise("")


def fund_clause(name: Column, close_age: Column, closed: Column, flagged: Column) -> Column:
    """name null: no named fund; closed: its date, for the month in the phrase (null: left out)."""
    month = F.coalesce(F.concat(F.lit(" in "), F.date_format(closed, "MMM yyyy")), F.lit(""))
    return (
        F.when(name.isNotNull() & (close_age <= 730), F.concat(F.lit("recently closed "), name))
        .when(name.isNotNull() & (close_age <= 1825), F.concat(F.lit("closed "), name, month))
        .when(name.isNotNull(), F.concat(F.lit("named fund: "), name))
        .when(flagged, "actively fundraising")
        .otherwise("")
    )


def fit_phrase(sector: Column, stage: Column, geo: Column, label: str = "fintech") -> Column:
    def one_of(both: str, place: str, plain: str) -> Column:
        return F.when(stage >= 2, both).when(geo >= 1, place).otherwise(plain)

    cap = label.capitalize()
    return (
        F.when(sector >= 3, one_of(f"Strong {label} and stage fit", f"Strong {label} fit in target geography", f"Strong {label} fit"))
        .when(sector >= 2, one_of(f"{cap} and stage match", f"{cap} match in target geography", f"{cap} sector match"))
        .when(sector >= 1, F.when(stage >= 2, "Partial sector overlap and good stage fit").otherwise("Some sector overlap"))
        .otherwise(one_of("Good stage fit", "Geographic match", "Some alignment"))
    )


def intent_phrase(recent: Column, fund: Column, hiring: Column, public: Column) -> Column:
    latest = F.when(fund >= 1, "very recent deals and fund activity").when(hiring >= 1, "very recent deals and team growth").when(public >= 1, "very recent deals and public signals").otherwise("very recent deal activity")
    late = F.when(public >= 1, "recent deals and public signals").when(fund >= 1, "recent deals and fund activity").when(hiring >= 1, "recent deals and hiring signals").otherwise("recent investing activity")
    return (
        F.when(recent >= 3, latest)
        .when(recent >= 2, late)
        .when(fund >= 2, "a recently closed fund")
        .when(fund >= 1, F.when(recent >= 1, "fund activity and some deals").otherwise("new fund or fundraising signals"))
        .when(recent >= 1, F.when(public >= 1, "some deal activity and public signals").otherwise("some recent deal activity"))
        .when(public >= 1, "public portfolio signals")
        .when(hiring >= 1, "hiring for investment roles")
        .otherwise("some activity")
    )


def joined(fit: Column, intent: Column) -> Column:
    return F.concat(fit, F.when(F.contains(F.lower(fit), F.lit(" with ")), "; ").otherwise(" with "), intent, F.lit("."))


def reason(activity: Column, fund_text: Column, sector: Column, stage: Column, checks: Column, geo: Column, recent: Column, fund: Column, hiring: Column, public: Column, fit_score: Column, intent_score: Column, label: str = "fintech") -> Column:
    """One sentence: from clauses where there are any, else from fit and intent."""
    tags = F.concat_ws(", ", F.when(sector >= 2, f"strong {label} alignment").when(sector >= 1, f"partial {label} alignment"), F.when(checks >= 2, "check-size aligned"))
    alone = F.concat(F.upper(F.substring(fund_text, 1, 1)), F.lower(F.substring(fund_text, 2, 10_000)))
    aligned = F.when(sector >= 2, "strong").when(sector >= 1, "partial").otherwise("limited")
    fit, intent = fit_phrase(sector, stage, geo, label), intent_phrase(recent, fund, hiring, public)
    mixed = F.when(sector >= 1, "Some sector overlap, but signals are mixed.").when((recent >= 1) | (fund >= 1), "Some activity signals, but overall fit is unclear.").otherwise("Partial signals, but no strong fit or activity.")
    return (
        F.when((activity != "") & (fund_text != ""), F.concat(activity, F.lit(" and "), fund_text, F.lit(".")))
        .when(activity != "", F.concat(activity, F.when(tags != "", F.concat(F.lit("; "), tags)).otherwise(""), F.lit(".")))
        .when(fund_text != "", F.concat(alone, F.lit("; "), aligned, F.lit(f" {label} alignment.")))
        .when((fit_score >= 4) & (intent_score >= 3), joined(fit, intent))
        .when(fit_score >= 4, F.concat(fit, F.lit(", but limited recent activity.")))
        .when(intent_score >= 3, F.concat(F.lit("Shows "), intent, F.lit(", but sector alignment is limited.")))
        .when(fit_score + intent_score >= 4, mixed)
        .otherwise("No significant signals detected.")
    )
