"""Profiles and texts: deal profiles, texts to embed by namespace, site candidates, search strategy, outreach records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.functions import urls as U
from tallyforge.functions.fixed import ACTIVITY_SOURCES, NEWS_FRAGMENTS, QUERY_KEYS, RECENT_VERBS, SITE_ACTIVITY_TERMS, SITE_WORDS, SOCIAL_FRAGMENTS
from tallyforge.functions.text import has_any, hits, normalize_stage, stage_from_raise, strings


NO_TRACTION = "Traction metrics pending detailed data room uploads; use placeholders until validated."


def dollars(x: Column) -> Column:
    """Whole dollars with thousands separators; halves go to the even dollar."""
    return F.concat(F.lit("$"), F.format_number(F.bround(x).cast("long"), 0))


def some(x: Column) -> Column:
    """Whether a text is there and not empty."""
    return x.isNotNull() & (x != "")


def split_places(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(";"), F.lit(",")), ","), lambda p: F.trim(p)), lambda p: p != "")


def deal_stage(label: Column, amount: Column) -> Column:
    return F.coalesce(normalize_stage(label), stage_from_raise(amount))


def deal_profile(d: DataFrame) -> DataFrame:
    """deal_id, stage, geography and the profile texts of deals (columns as read by read_deals)."""
    c = F.col
    places = split_places(c("geography"))
    raising = F.concat(F.lit("Raising "), dollars(c("raise_amount")), F.lit(" over a 90-day process to fund growth milestones, investor outreach, and execution."))
    worth = F.when(c("valuation").isNotNull() & (c("valuation") != 0), F.concat(F.lit("Valuation: "), dollars(c("valuation"))))
    return d.select(
        "deal_id", "company_name", "industry", "raise_amount", deal_stage(c("stage_label"), c("raise_amount")).alias("stage"), F.when(F.size(places) > 0, places).otherwise(strings(["United States"])).alias("geography"),
        F.concat(c("company_name"), F.lit(" is a "), c("industry"), F.lit(" company raising "), dollars(c("raise_amount")), F.lit(".")).alias("company_core"),
        F.when(some(c("problem")), c("problem")).otherwise(F.concat(c("company_name"), F.lit(" addresses a core problem in "), c("industry"), F.lit("."))).alias("problem"),
        F.coalesce("solution", F.lit("")).alias("solution"),
        F.concat(c("industry"), F.lit(" market opportunity. "), F.when(some(c("market_size")), c("market_size")).otherwise(F.concat(c("industry"), F.lit(" market opportunity.")))).alias("industry_market"),
        (c("traction_metrics") if "traction_metrics" in d.columns else F.lit(NO_TRACTION)).alias("traction"),
        F.concat_ws(" ", raising, F.when(some(c("use_of_funds_breakdown")), F.concat(F.lit("Use of funds: "), c("use_of_funds_breakdown"))), worth).alias("raise_thesis"),
    )


def profile_text(head: list[tuple[str, Column]], more: list[tuple[str, Column]]) -> Column:
    """Lines "label: value", then blocks "label:" and text for what is there."""
    lines = [F.when(some(v.cast("string")), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in head]
    blocks = [F.when(some(v), F.concat(F.lit(f"\n{k}:\n"), v)) for k, v in more]
    return F.concat_ws("\n", *lines, *blocks)


def fund_text(thesis: Column, sectors: Column, verticals: Column, stages: Column, low: Column, high: Column) -> Column:
    def listed(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))

    def amount(x: Column) -> Column:
        return F.when(F.coalesce(x, F.lit(0)) != 0, dollars(x)).otherwise("?")

    checks = F.when((F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0), F.concat(F.lit("Check size: "), amount(low), F.lit("–"), amount(high)))
    return F.concat_ws(" | ", F.when(some(thesis), thesis), listed("Focus sectors: ", sectors), listed("Verticals: ", verticals), listed("Stages: ", stages), checks)


def partner_text(name: Column, title: Column, firm: Column, place: Column, kind: Column, thesis: Column, fund_thesis: Column) -> Column:
    who = F.concat_ws(" ", F.when(some(name), name), F.when(some(title), title), F.lit("at"), F.when(some(firm), firm))
    own = F.when(some(thesis) & ~F.contains(F.coalesce(fund_thesis, F.lit("")), thesis), thesis)
    return F.concat_ws(" | ", who, F.when(some(place), F.concat(F.lit("Based in "), place)), F.when(some(kind), F.concat(F.lit("Investor type: "), kind)), own)


def activity_text(signals: Column, metadata: dict[str, Column], companies: Column) -> Column:
    """Texts of the first eight activity signals, or else a line made of metadata."""
    own = F.transform(F.slice(F.filter(signals, lambda s: F.array_contains(strings(ACTIVITY_SOURCES), s.source_type)), 1, 8), lambda s: s.text)
    m = metadata
    company, date, kind = m["last_company"], m["last_date"], m["last_type"]
    last = (
        F.when(some(date) & some(company), F.concat(F.lit("Most recent investment: "), company, F.lit(" on "), date, F.when(some(kind), F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise("")))
        .when(some(date), F.concat(F.lit("Last investment date: "), date))
        .when(some(company), F.concat(F.lit("Most recent portfolio company: "), company))
    )
    rest = [F.when(some(m[k]), F.concat(F.lit(label), m[k])) for k, label in (("total", "Total investments: "), ("five_years", "Investments past 5 years: "), ("two_years", "Investments past 24 months: "), ("count_12m", "Deals past 12 months: "), ("active", "Active portfolio companies: "), ("kind", "Investor type: "), ("place", "Based in: "), ("fundraising", "Fundraising status: ")) if k in m]
    n = F.size(companies)
    recent = F.when(n > 0, F.concat(F.lit("Recent portfolio: "), F.array_join(F.slice(companies, F.greatest(n - 2, F.lit(1)), F.lit(3)), ", ")))
    return F.when(F.size(own) > 0, F.array_join(own, " | ")).otherwise(F.concat_ws(" | ", last, *rest, recent))


def site_score(url: Column, title: Column, body: Column, name: Column) -> Column:
    """How likely a page is the entity's own home: -999 for social and news hosts."""
    u = U.normalize(url)
    host = U.domain(u)
    blob = F.lower(F.concat_ws(" ", host, F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    path = F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    words = F.array_distinct(U.name_tokens(name))
    bucket = U.bucket(u)
    by_path = F.when(path.isin("", "/"), 8.0).when(bucket.isin("team", "portfolio", "contact", "general"), 4.0).when(bucket == "news", 2.0).otherwise(-3.0)
    score = (
        F.when(U.entity_matches(name, F.lit(""), blob, u), 25.0).otherwise(-20.0)
        + F.when(F.contains(blob, F.lower(name)), 16.0).otherwise(0.0)
        + 4.0 * F.size(F.filter(words, lambda t: F.contains(blob, t)))
        + by_path
        + F.when(has_any(blob, SITE_WORDS), 6.0).otherwise(0.0)
        - F.when(depth >= 3, 4.0).otherwise(0.0)
    )
    return F.when((host == "") | has_any(host, SOCIAL_FRAGMENTS) | has_any(host, NEWS_FRAGMENTS), -999.0).otherwise(score)


def recently_active(text: Column, newest_age: Column) -> Column:
    """A date within a year and a term of site activity, or three terms and a verb."""
    terms = hits(text, SITE_ACTIVITY_TERMS)
    return F.coalesce((newest_age.between(0, 365) & (terms >= 1)), F.lit(False)) | ((terms >= 3) & has_any(text, RECENT_VERBS))


def query_keys(urls_found: Column, text: Column, least: int = 120) -> Column:
    """All five query families without evidence from the site; the four on recency with it."""
    return F.when((urls_found > 0) | (F.length(F.trim(text)) >= least), strings(QUERY_KEYS[:4])).otherwise(strings(QUERY_KEYS))


OUTREACH = ("firm", "title", "email", "phone", "linkedin_url", "twitter_handle", "website", "investment_thesis", "portfolio_companies", "check_size_range", "source_tags", "data_quality_confidence", "last_verified_at")


def outreach(ranked: DataFrame) -> DataFrame:
    """Ranked matches as outreach rows: score of 100 (half-even), the first four reasons, segment, provenance, first three
    signals, paths, and the contact columns that ranked has. Needs rank, investor_id, full_name, score, explanation, signals, warm."""
    why = F.array_join(F.slice("explanation.reasons", 1, 4), "; ")
    return ranked.select(
        "investor_id", "rank", "full_name", *[c for c in OUTREACH if c in ranked.columns], F.bround(F.col("score") * 100).cast("int").alias("fit_score"), F.when(why == "", "Hybrid matching score indicates strong fit.").otherwise(why).alias("why_good_fit"),
        "explanation", F.col("explanation.source_provenance").alias("source_provenance"), F.slice("signals", 1, 3).alias("recent_signals"), F.col("warm").alias("warm_intro_paths"), F.size("warm").alias("n_warm"),
        F.col("explanation.match_segment").alias("match_segment"), F.round("score", 4).alias("final_score"),
    )


def pending_wires(wires: Column) -> Column:
    """Wires that are not completed; a missing status counts as pending."""
    return F.filter(wires, lambda w: ~w.status.eqNullSafe(F.lit("completed")))


def first_non_empty(variants: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Of ordered variants of each key the first with a value."""
    return variants.filter(some(F.col(value))).groupBy(key).agg(F.min(F.struct(order, value)).alias("b")).select(key, F.col(f"b.{order}").alias(order), F.col(f"b.{value}").alias(value))


def positions(rows: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """rows with their positions (from 0) by order, which is unique: ranges of order are counted, so no task numbers all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a stated number of ranges, which adaptive execution leaves as they are
    cut = rows.select(order).repartitionByRange(n, order).select(order, F.spark_partition_id().alias("_p"))
    at = W.Window.partitionBy("_p").orderBy(order)
    sizes = cut.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row for each partition of the shuffle
    before = sizes.select("_p", (F.sum("_n").over(W.Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    placed = cut.withColumn("_i", F.row_number().over(at) - 1).join(F.broadcast(before), "_p").select(order, (F.col("_i") + F.col("_before")).cast("long").alias(name))
    return rows.join(placed, order)


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The i-th row of one side with the i-th of the other where there is one, each side in its own (unique) order."""
    return positions(left, left_order, "_i").join(positions(right, right_order, "_i"), "_i", "left").drop("_i")


def portfolio_text(companies: Column) -> Column:
    return F.array_join(F.coalesce(companies, strings([])), " ")


def profile_artifacts(profiles: DataFrame, embed) -> DataFrame:
    """deal_id, part, embedding for the five texts of a deal's profile that are embedded. embed: a function of a frame with a
    column text to the frame with a column embedding, row by row."""
    parts = ("company_core", "problem", "industry_market", "traction", "raise_thesis")
    long = profiles.select("deal_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(F.col(p), F.lit("")).alias("text")) for p in parts])).alias("x")).select("deal_id", "x.*")
    return embed(long).select("deal_id", "part", "embedding")
