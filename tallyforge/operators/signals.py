"""Signal rubric: fit and intent points, classifiers and report columns, over merged evidence text and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.fixed import ACTIVITY_TERMS, FINTECH_EXPLICIT, FINTECH_WEAK, FUND_ACTIONS, FUND_TOPICS, HIRING_ROLES, HIRING_TERMS, INSTITUTIONAL_MARKERS, PORTFOLIO_MARKERS, PUBLIC_ACTIVITY, PUBLIC_MEDIUM, PUBLIC_STRONG, ROUND_TERMS, SECTOR_TERMS, STAGE_TERMS, TARGET_CHECK, US_TOKENS, VENTURE_MARKERS, WARM_PLACES
from tallyforge.functions.text import has_any, hits

FRESH = ("Last 30 days", "Last 30-60 days")


def institutional(blob: Column) -> Column:
    return has_any(blob, INSTITUTIONAL_MARKERS) & ~has_any(blob, VENTURE_MARKERS)


# ---- fit, 0 to 10 ----------------------------------------------------------------------


def fit_sector(sheet: Column, merged: Column, inst: Column) -> Column:
    es, em, weak = hits(sheet, FINTECH_EXPLICIT), hits(merged, FINTECH_EXPLICIT), hits(merged, FINTECH_WEAK)
    less = F.when(inst, 1).otherwise(0)
    return F.when((es >= 2) | ((es >= 1) & (em >= 3)), 3 - less).when(es >= 1, 2 - less).when(em >= 1, 1).when((weak >= 2) & ~inst, 1).otherwise(0)


def fit_stage(merged: Column, inst: Column, hints: tuple[str, ...] = ("venture", "angel", "early")) -> Column:
    less = F.when(inst, 1).otherwise(0)
    return F.when(has_any(merged, STAGE_TERMS["seed"]), 2 - less).when(has_any(merged, hints), 1 - less).otherwise(0)


def fit_check(low: Column, high: Column, middle: Column, target: float = TARGET_CHECK) -> Column:
    """low, high: stated least and greatest amount; middle: the stated amount nearest to the target. Null: not stated."""
    both = low.isNotNull() & high.isNotNull()
    m = middle / target
    by_middle = F.when(m.between(0.6, 1.6), 2).when(m.between(0.25, 4.0), 1).otherwise(0)
    by_low, by_high = F.try_divide(F.lit(target), low), high / target
    return (
        F.when(both & (F.lit(target) >= low) & (F.lit(target) <= high), 2)
        .when(both & ((F.lit(target) < 0.35 * low) | (F.lit(target) > 3.0 * high)), 0)
        .when(both, 1)
        .when(low.isNotNull() & by_low.between(0.35, 1.5), 1)
        .when(low.isNotNull() & (by_low > 1.5), 1)
        .when(high.isNotNull() & by_high.between(0.5, 3.0), 1)
        .when(high.isNotNull() & (by_high < 0.5), 0)
        .when(middle.isNotNull(), by_middle)
        .when(low.isNotNull() | high.isNotNull(), 1)
        .otherwise(0)
    )


def fit_geography(text: Column) -> Column:
    return has_any(text, US_TOKENS).cast("int")


def fit_strategic(sheet: Column, merged: Column, inst: Column) -> Column:
    s, m = hits(sheet, SECTOR_TERMS["fintech"]), hits(merged, SECTOR_TERMS["fintech"])
    less = F.when(inst, 1).otherwise(0)
    return F.when(s >= 2, 2 - less).when((s == 1) | (m >= 1), 1 - less).otherwise(0)


# ---- intent, 0 to 10 -------------------------------------------------------------------


def intent_recent(n7: Column, n6m: Column, n12m: Column, last_points: Column, web_age: Column, web: Column) -> Column:
    """Counts and last date from the sheet, age of the newest date and terms from the web."""
    sheet = F.when(n7 >= 1, 3).when(n6m >= 3, 3).when((n6m >= 1) | (n12m >= 4), 2).otherwise(last_points)
    dated = F.when(web_age <= 90, 2).when(web_age <= 365, 1).otherwise(0)
    dated = F.coalesce(dated, F.lit(0))
    from_web = F.when(~has_any(web, ACTIVITY_TERMS), 0).when((dated == 0) & (hits(web, ROUND_TERMS) >= 2), 1).otherwise(dated)
    return F.when((sheet >= 2) & (from_web >= 2), 3).otherwise(F.greatest(sheet, from_web))


def intent_fund(named: Column, close_age: Column, sized: Column, flagged: Column, web: Column, topics: tuple[str, ...] = FUND_TOPICS, actions: tuple[str, ...] = FUND_ACTIONS) -> Column:
    sheet = F.when(named & (close_age <= 730), 2).when(named & (close_age.isNotNull() | sized), 1).when(flagged, 1).otherwise(0)
    return F.greatest(sheet, (has_any(web, topics) & has_any(web, actions)).cast("int"))


def intent_hiring(text: Column, acts: tuple[str, ...] = HIRING_TERMS, roles: tuple[str, ...] = HIRING_ROLES) -> Column:
    return (has_any(text, acts) & has_any(text, roles)).cast("int")


def intent_public(dated: Column, text: Column) -> Column:
    strong, medium = hits(text, PUBLIC_STRONG), hits(text, PUBLIC_MEDIUM)
    return F.when((dated >= 2) & ((strong >= 1) | (medium >= 2)), 2).when((dated >= 1) & (strong >= 1), 1).when(strong >= 2, 1).when((strong >= 1) & (medium >= 1), 1).otherwise(0)


def warm_signals(geo: Column, sector: Column, public: Column, recent: Column, described: Column) -> Column:
    """Names of the warm-intro signals that merged texts show, in order."""
    target, both = SECTOR_TERMS["fintech"], F.concat_ws(" ", public, recent)
    return F.array_compact(
        F.array(
            F.when(has_any(geo, WARM_PLACES), "shared geography"),
            F.when(has_any(sector, target), "same industry"),
            F.when(has_any(both, PORTFOLIO_MARKERS) & has_any(both, target), "similar portfolio"),
            F.when(has_any(public, PUBLIC_ACTIVITY) & has_any(public, target), "public activity in same space"),
            F.when(described, "existing database / history"),
        )
    )


def data_sources(sheet: Column, site: Column, news: Column, snippets: Column) -> Column:
    """Names of the sources that evidence came from; search only counts without news."""
    found = F.concat_ws(", ", F.when(sheet, "Investor database"), F.when(site, "Official site"), F.when(news, "News/press"), F.when(snippets & ~news, "Public search"))
    return F.when(found == "", "Limited evidence").otherwise(found)


def intent_warm(signals: Column) -> Column:
    return F.when(signals >= 3, 2).when(signals >= 1, 1).otherwise(0)


def capped(*points: Column) -> Column:
    return F.least(F.lit(10), sum(points, F.lit(0)))


# ---- classifiers -----------------------------------------------------------------------


def score_100(total: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total / 20 * 100).cast("int")))


def probability(score: Column, confidence: Column) -> Column:
    """Half-even rounding at both steps."""
    b = F.bround(2 + 0.78 * score)
    p = F.when(confidence == "Low", F.bround(b * 0.7)).when(confidence == "High", F.bround(F.least(F.lit(85.0), b * 1.05))).otherwise(b)
    return F.greatest(F.lit(0), F.least(F.lit(85), p.cast("int")))


def signal_type(recent: Column, fund: Column, public: Column, sector: Column, flagged: Column) -> Column:
    return (
        F.when(recent >= 2, "Active Investing")
        .when(fund >= 1, F.when(flagged, "Fundraising").otherwise("New Fund"))
        .when((recent >= 1) & (public >= 1), "Active Investing")
        .when(public >= 2, "Public Activity")
        .when(public >= 1, "Similar Portfolio Activity")
        .when(recent >= 1, "Active Investing")
        .when(sector >= 2, "Sector Match Only")
        .otherwise("Weak / No Recent Signal")
    )


def sector_relevance(points: Column) -> Column:
    return F.when(points >= 3, "High").when(points >= 1, "Medium").otherwise("Low")


def recency(n7: Column, n6m: Column, n12m: Column, last_age: Column, close_age: Column, text_age: Column, terms: Column) -> Column:
    ages = F.array_compact(
        F.array(F.when(n7 >= 1, 7), F.when(n6m >= 3, 30).when(n6m >= 1, 60), F.when(n12m >= 4, 60).when(n12m >= 1, 90), last_age, F.when(close_age <= 365, F.least(close_age, F.lit(90))), text_age)
    )
    least = F.array_min(F.filter(ages, lambda a: a >= 0))
    return F.when(least <= 30, "Last 30 days").when(least <= 60, "Last 30-60 days").when(least <= 180, "Last 60-90 days").when(terms >= 3, "Last 60-90 days").otherwise("Older / unclear")


def confidence(sources: Column, total: Column, fresh: Column) -> Column:
    return F.when(sources == 0, "Low").when((sources == 2) & (total >= 10) & fresh, "High").when((sources == 2) & (total >= 8), "Medium").when((sources >= 1) & (total >= 6) & fresh, "Medium").otherwise("Low")


def check_label(points: Column) -> Column:
    return F.when(points >= 2, "Perfect fit").when(points == 1, "Slight mismatch").otherwise("Poor fit")


def warm_label(n: Column) -> Column:
    return F.when(n >= 4, "Direct connection").when(n == 3, "1st degree mutual").when(n >= 1, "2nd degree").otherwise("None")


def signal_bucket(score: Column, fresh: Column, intent: Column) -> Column:
    return F.when(((score >= 75) & fresh) | ((score >= 70) & (intent >= 5)), "Immediate Target").when((score >= 60) | ((score >= 50) & (fresh | (intent >= 4))), "High Priority").when(score >= 35, "Secondary").otherwise("Ignore")


def action(score: Column, warm: Column, fresh: Column, intent: Column) -> Column:
    close = warm.isin("Direct connection", "1st degree mutual")
    return (
        F.when((score >= 75) & fresh, F.when(close, "Prioritize with warm intro").otherwise("Reach out immediately"))
        .when((score >= 60) & close, "Prioritize with warm intro")
        .when((score >= 60) & (fresh | (intent >= 4)), "Reach out immediately")
        .when(score >= 40, "Monitor for now")
        .otherwise("Low priority")
    )


def urgency(score: Column, label: Column, intent: Column) -> Column:
    fresh = label.isin(*FRESH)
    return F.when((label == "Last 30 days") & ((score >= 65) | (intent >= 5)), "Act within 14 days").when((fresh & (score >= 50)) | ((score >= 60) & (intent >= 4)), "Act within 30 days").otherwise("No urgency")
