"""Hybrid matching: eligibility waterfall, features, final score, shortlist, rank, explanation.

Candidates are a DataFrame with the columns that each operator names; a profile is a small set of literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.functions.dates import parse_date, recency_score
from tallyforge.functions.fixed import FINAL_WEIGHTS, INDUSTRY_NEEDLES, TERM_EXPANSION
from tallyforge.functions.text import bound, contains_any, geography_matches, has_any, strings, tag_terms
from tallyforge.functions.vectors import clamp01


@dataclass(frozen=True)
class Profile:
    industry: str
    stage: str
    geography: tuple[str, ...]
    raise_amount: float
    terms: tuple[str, ...] = ()
    as_of: str = "2002-06-01"
    extra: dict = field(default_factory=dict)

    @property
    def least_check(self) -> float:
        return max(25_000.0, self.raise_amount * 0.0025)

    @property
    def date(self) -> Column:
        return F.lit(self.as_of).cast("date")


def reject_reason(p: Profile) -> Column:
    """The first rule that fails: status, exclusions, stage_focus, check_max, geography, last_date, thesis_terms; null: eligible."""
    stage_ok = F.array_contains("stage_focus", p.stage) | ((F.lit(p.stage) == "series_a") & F.array_contains("stage_focus", "seed"))
    excluded = F.exists("exclusions", lambda e: F.contains(F.lit(p.industry.lower()), F.lower(e)))
    crypto = F.array_contains("thesis_terms", "crypto") & ~F.array_contains("thesis_terms", "fintech")
    return (
        F.when(F.col("status") != "active", "inactive_fund")
        .when(excluded, "sector_exclusion")
        .when((F.size("stage_focus") > 0) & ~stage_ok, "stage_mismatch")
        .when((F.col("check_max") > 0) & (F.col("check_max") < p.least_check), "check_size_too_small")
        .when((F.size("geography") > 0) & ~geography_matches(strings(p.geography), F.col("geography")), "geography_mismatch")
        .when(F.datediff(p.date, "last_date") > 1460, "dormant_fund")
        .when(F.lit("crypto" not in p.terms) & crypto, "crypto_sector_mismatch")
    )


def keyword_score(query: Column, candidate: Column) -> Column:
    return F.when(F.size(candidate) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(query, candidate)) / F.greatest(F.lit(6), F.size(query))))


def expand_terms(terms: Column) -> Column:
    added = F.array_compact(F.array(*[F.when(F.array_contains(terms, a), F.lit(b)) for a, b in TERM_EXPANSION.items()]))
    return F.array_distinct(F.concat(terms, added))


def industry_alignment(profile_terms: Column, focus_terms: Column, investor_terms: Column) -> Column:
    def scored(x: Column) -> Column:
        common = F.size(F.array_intersect(x.own, x.p))
        s = F.lit(0.20) + F.lit(0.60) * F.try_divide(common, F.size(x.p)) + F.lit(0.20) * F.try_divide(common, F.size(x.own))
        broad = F.size(x.own) > F.greatest(F.lit(4), F.size(x.p) + 3)
        return (
            F.when(F.size(x.p) == 0, 0.0)
            .when((F.size(x.focus) > 0) & ~F.arrays_overlap(x.focus, x.p), 0.0)
            .when(F.size(x.own) == 0, 0.5)
            .when(common == 0, 0.0)
            .otherwise(F.least(F.lit(1.0), F.when(broad, F.least(s, F.lit(0.65))).otherwise(s)))
        )

    return bound(F.struct(bound(profile_terms, expand_terms).alias("p"), focus_terms.alias("focus"), investor_terms.alias("own")), scored)


def semantic_fit(vector: Column, keyword: Column, industry: Column) -> Column:
    gate = F.greatest(F.lit(0.15), industry)
    return F.least(F.lit(1.0), gate * F.greatest(0.8 * vector + 0.2 * keyword, 0.75 * industry + 0.25 * keyword))


def stage_fit(p: Profile, focus: Column) -> Column:
    return F.when(F.array_contains(focus, p.stage), 1.0).when(F.array_contains(focus, "seed"), 0.7).otherwise(0.3)


def check_fit(p: Profile, low: Column, high: Column) -> Column:
    return F.when(high <= 0, 0.5).when(high < p.least_check, 0.0).when(low > p.raise_amount, 0.2).when((low + high) / 2 <= p.raise_amount, 1.0).otherwise(0.8)


def activity_fit(last: Column, count_12m: Column, as_of: Column) -> Column:
    return F.least(F.lit(1.0), 0.6 * recency_score(last, as_of) + F.least(F.lit(0.4), 0.1 * count_12m))


def portfolio_fit(companies: Column, hits: Column) -> Column:
    return F.when(companies == 0, 0.2).otherwise(F.least(F.lit(1.0), 0.3 + 0.25 * hits))


def warm_fit(paths: Column) -> Column:
    return F.when(paths == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.4 + 0.3 * paths))


def features(c: DataFrame, p: Profile) -> DataFrame:
    """c with the nine features. Needs vector_score, keyword_score, industry_score and the profile-side columns."""
    return c.select(
        "*",
        semantic_fit(F.col("vector_score"), F.col("keyword_score"), F.col("industry_score")).alias("semantic_fit"),
        stage_fit(p, F.col("stage_focus")).alias("stage_fit"),
        check_fit(p, F.col("check_min"), F.col("check_max")).alias("check_fit"),
        activity_fit(F.col("last_date"), F.col("count_12m"), p.date).alias("recent_activity"),
        portfolio_fit(F.col("n_companies"), F.col("portfolio_hits")).alias("portfolio_adjacency"),
        F.when((F.size("geography") == 0) | geography_matches(strings(p.geography), F.col("geography")), 1.0).otherwise(0.5).alias("geography_fit"),
        warm_fit(F.col("warm_paths")).alias("warm_intro_score"),
        clamp01(F.col("quality")).alias("data_quality_confidence"),
    )


def final_score() -> Column:
    parts = {n: F.col(n) for n in FINAL_WEIGHTS if n != "stage_and_check"} | {"stage_and_check": (F.col("stage_fit") + F.col("check_fit")) / 2}
    return clamp01(sum((F.lit(w) * parts[n] for n, w in FINAL_WEIGHTS.items()), F.lit(0.0)))


def shortlisted(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The rows among the max(3k, 20) best by any of three scores, or with a warm path, each once.

    scored is read once: each row stands in three lists, and in one of its own where it has a warm path; the lists' limits
    are applied before the shuffle, too.
    """
    n = max(3 * k, 20)
    lists = [F.struct(F.lit(s).alias("list"), F.lit(None).cast("string").alias("own"), F.col(s).alias("by")) for s in ("vector_score", "keyword_score", "industry_score")]
    warm = F.when(F.col("warm_paths") > 0, F.struct(F.lit("warm").alias("list"), F.col(key).cast("string").alias("own"), F.lit(0.0).alias("by")))
    each = scored.withColumn("_in", F.explode(F.array_compact(F.array(*lists, warm))))
    w = W.Window.partitionBy("_in.list", "_in.own").orderBy(F.desc("_in.by"), key)
    return each.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).dropDuplicates([key]).drop("_in", "_n")


def shortlist(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The keys of the shortlisted rows."""
    return shortlisted(scored.select(key, "vector_score", "keyword_score", "industry_score", "warm_paths"), key, k).select(key)


def canonical(identifier: Column) -> Column:
    return F.regexp_replace(identifier.cast("string"), r"__dup\d+$", "")


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best by score, the first of each canonical key, with ranks from 1."""
    first = W.Window.partitionBy("_canonical").orderBy(F.desc("score"), key)
    best = scored.withColumn("_canonical", canonical(F.col(key))).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_canonical")
    # k rows only reach the one task that numbers them
    return best.orderBy(F.desc("score"), key).limit(k).withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("score"), key)))


def amount_text(x: Column) -> Column:
    return F.when(x >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", x / 1e6), F.lit("M"))).otherwise(F.concat(F.lit("$"), F.format_string("%.0f", x / 1e3), F.lit("K")))


def _words(p: Profile) -> list[str]:
    return sorted(set(re.sub(r"[^a-z\s]", "", p.industry.lower()).split()))


def portfolio_hits(p: Profile, companies: Column) -> Column:
    """How many companies have a word of the profile's industry in their names."""
    return F.size(F.filter(companies, lambda c: contains_any(F.lower(c), p.industry.lower().split())))


def last_activity(stated: Column, signals: Column) -> Column:
    """The stated date of the last investment, else the newest date of an activity signal."""
    dates = F.transform(F.filter(signals, lambda s: (s.source_type == "pitchbook_activity") & (s.date != "")), lambda s: parse_date(s.date))
    return F.coalesce(parse_date(stated), F.array_max(dates))


def aligned_with_texts(market: Column, industry: str, focus: Column, texts: list[Column]) -> Column:
    """industry_alignment over labels tagged from texts: of the deal (industry and market), of the focus lists, and of these
    with the investor's other texts."""
    profile = F.array_distinct(F.concat(tag_terms(F.lit(industry), INDUSTRY_NEEDLES), tag_terms(market, INDUSTRY_NEEDLES)))
    listed = F.array_join(F.coalesce(focus, strings([])), " ")
    every = F.concat(listed, *[F.concat(F.lit(" "), F.coalesce(t, F.lit(""))) for t in texts])
    return industry_alignment(profile, tag_terms(listed, INDUSTRY_NEEDLES), tag_terms(every, INDUSTRY_NEEDLES))


def reasons(p: Profile) -> Column:
    """Up to five reasons, in the order of the features, or the one for borderline fits.

    Needs the features, industry_focus, stage_focus, check_min, check_max, geography, count_12m, and: investment_thesis, companies,
    signals (structs with source_type, text, date), warm (texts of paths).
    """
    words, c = _words(p), F.col
    stages = F.array_join(F.transform(F.slice("stage_focus", 1, 3), lambda s: F.replace(s, F.lit("_"), F.lit(" "))), ", ")
    low = F.when(c("check_min") > 0, amount_text(c("check_min"))).otherwise("open")
    focus = F.array_join(F.slice("industry_focus", 1, 3), ", ")
    sentences = F.filter(F.transform(F.split(F.coalesce("investment_thesis", F.lit("")), "[.!?]"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)
    relevant = F.get(F.filter(sentences, lambda s: contains_any(F.lower(s), words)), F.lit(0))
    has_focus = F.size("industry_focus") > 0
    thesis = (
        F.when((c("semantic_fit") >= 0.5) & (F.coalesce("investment_thesis", F.lit("")) != ""), F.when(relevant.isNotNull(), F.concat(F.lit('Thesis: "'), F.trim(F.substring(relevant, 1, 130)), F.lit('"'))).when(has_focus, F.concat(F.lit("Fund sector focus: "), focus)).otherwise(f"Semantic signal indicates strong {p.industry} alignment"))
        .when((c("semantic_fit") >= 0.25) & has_focus, F.concat(F.lit("Sector overlap: "), focus))
    )
    near = F.filter("companies", lambda x: contains_any(F.lower(x), words))
    portfolio = F.when(F.size(near) > 0, F.concat(F.lit("Portfolio includes adjacent bets: "), F.array_join(F.slice(near, 1, 3), ", "))).otherwise(F.concat(F.lit("Portfolio of "), F.size("companies"), F.lit(" companies shows sector exposure")))
    deal = F.get(F.filter("signals", lambda s: (s.source_type == "pitchbook_activity") & (s.date != "")), F.lit(0))
    company = F.get(F.transform(F.filter(F.transform(F.split(deal.text, r"\|"), lambda x: F.trim(x)), lambda x: x.startswith("company:")), lambda x: F.trim(F.substr(x, F.lit(9)))), F.lit(0))
    month = F.substring(deal.date, 1, 7)
    recent = F.when(c("count_12m") > 0, F.concat(F.lit("Actively deploying: "), c("count_12m"), F.lit(" deals in last 12 months"))).when(F.coalesce(company, F.lit("")) != "", F.concat(F.lit("Recent investment: "), company, F.lit(" ("), month, F.lit(")"))).when(deal.isNotNull(), F.concat(F.lit("Recent investment activity recorded ("), month, F.lit(")")))

    def meets(g: Column) -> Column:
        out = F.lit(False)
        for own in p.geography:
            out = out | F.contains(F.lower(g), F.lit(own.lower())) | F.contains(F.lit(own.lower()), F.lower(g))
        return out

    place = F.coalesce(F.get(F.filter("geography", meets), F.lit(0)), F.get("geography", F.lit(0)))
    found = F.array_compact(
        F.array(
            thesis,
            F.when((c("stage_fit") >= 0.9) & (F.size("stage_focus") > 0), F.concat(F.lit(f"Invests at {p.stage.replace('_', ' ')} stage ("), stages, F.lit(")"))),
            F.when((c("check_fit") >= 0.9) & (c("check_max") > 0), F.concat(F.lit("Cheque range "), low, F.lit("–"), amount_text(c("check_max")), F.lit(" fits a $"), amount_text(F.lit(p.raise_amount)), F.lit(" raise"))),
            F.when((c("portfolio_adjacency") >= 0.55) & (F.size("companies") > 0), portfolio),
            F.when(c("recent_activity") >= 0.7, recent),
            F.when((c("geography_fit") >= 1.0) & (F.size("geography") > 0) & F.lit(bool(p.geography)), F.concat(F.lit("Geographic focus includes "), place)),
            F.get("warm", F.lit(0)),
        )
    )
    return F.when(F.size(found) > 0, F.slice(found, 1, 5)).otherwise(F.array(F.lit("Passed eligibility filters; borderline fit — review manually")))


def warnings() -> Column:
    """What to check before outreach. Needs data_quality_confidence, email, linkedin_url."""
    return F.array_compact(
        F.array(
            F.when(F.col("data_quality_confidence") < 0.75, "Data confidence moderate — verify before outreach"),
            F.when(F.coalesce("email", F.lit("")) == "", "No email on file — research required"),
            F.when(F.coalesce("linkedin_url", F.lit("")) == "", "No LinkedIn URL — verify identity before contacting"),
        )
    )


def segment(p: Profile, thesis: Column, warm: Column) -> Column:
    t, ai = F.lower(F.coalesce(thesis, F.lit(""))), "ai" in p.industry.lower()
    return F.when(has_any(t, ("infrastructure", "developer")), "ai_infra" if ai else "deep_tech").when(has_any(t, ("application", "saas")), "ai_apps" if ai else "software").when(F.size(warm) > 0, "warm_network").otherwise("general_early_stage")


def provenance(signals: Column) -> Column:
    """Where the first three signals come from."""
    return F.transform(F.slice(signals, 1, 3), lambda s: F.struct(s.source_type.alias("source_type"), s.source_url.alias("source_url"), s.date.alias("date"), s.confidence.alias("confidence")))


def explanation(p: Profile) -> Column:
    """Reasons, warnings, provenance and segment of a match, as one struct."""
    return F.struct(reasons(p).alias("reasons"), warnings().alias("warnings"), provenance(F.col("signals")).alias("source_provenance"), segment(p, F.col("investment_thesis"), F.col("warm")).alias("match_segment"))
