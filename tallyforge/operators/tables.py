"""Table operators: sources in order, first-wins dedupe, running ids, staleness, coverage, signals from metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyforge.functions.text import clean_text


def in_order(*sources: DataFrame) -> DataFrame:
    """UNION ALL of sources with their priority in src_prio (from 0)."""
    out = sources[0].withColumn("src_prio", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("src_prio", F.lit(i)), allowMissingColumns=True)
    return out


def identity_key(email: Column, name: Column, firm: Column) -> Column:
    mail = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    return F.when(mail != "", mail).otherwise(F.concat_ws("|", F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(firm, F.lit("")))))


def first_wins(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    w = W.Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def running_ids(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """dup_id: the key, with __dup2, __dup3, ... from its second row on; blank keys stay, and are not gathered in one task."""
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    w = W.Window.partitionBy(key, F.when(blank, F.xxhash64(*order))).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumn("_n", n).withColumn("dup_id", F.when((F.col("_n") > 1) & (F.col(key).cast("string") != ""), F.concat(F.col(key).cast("string"), F.lit("__dup"), F.col("_n"))).otherwise(F.col(key).cast("string"))).drop("_n")


def stale_reason(cached: Column, old_hash: Column, new_hash: Column, force: bool = False) -> Column:
    return (
        F.when(F.lit(force), "force")
        .when(~cached, "missing_vector")
        .when(old_hash == "", "v1_no_hash")
        .when(old_hash != new_hash, "text_changed")
        .otherwise("up_to_date")
    )


STALE_REASONS = ("force", "missing_vector", "v1_no_hash", "text_changed", "up_to_date")


def staleness(texts: DataFrame, cache: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """texts (keys, text) with reason, by comparing the text's hash with the cache's (keys, old_hash)."""
    joined = texts.withColumn("new_hash", F.md5(F.coalesce("text", F.lit("")))).join(cache.select(*keys, "old_hash"), keys, "left")
    return joined.withColumn("reason", stale_reason(F.col("old_hash").isNotNull(), F.coalesce("old_hash", F.lit("")), F.col("new_hash"), force))


def stale_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in STALE_REASONS], F.count("*").alias("total"))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: total, and for each column how many rows have it and what per cent (one decimal)."""
    n = F.count("*")
    return rows.agg(n.alias("total"), *[F.count(c).alias(f"n_{c}") for c in columns], *[F.round(F.try_divide(F.lit(100.0) * F.count(c), n), 1).alias(f"pct_{c}") for c in columns])


def metadata_signals(meta: dict[str, Column], count_12m: Column, today: str) -> Column:
    """Up to three signal structs out of metadata: the last investment, counts of activity, the fundraising outlook.

    meta: last_company, last_date, last_type, last_size, total, five_years, two_years, active, fundraising, url (texts).
    """
    m = {k: clean_text(v) for k, v in meta.items()}
    m = {k: F.when(F.lower(v) == "null", "").otherwise(v) for k, v in m.items()}

    def part(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    def signal(kind: str, text: Column, day: Column, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("source_type"), text.alias("text"), m["url"].alias("source_url"), day.alias("date"), F.lit(confidence).alias("confidence"), F.lit("public").alias("visibility"))

    deal = F.concat_ws(" | ", F.lit("Most recent PitchBook investment"), part("company", m["last_company"]), part("date", m["last_date"]), part("type", m["last_type"]), part("size", m["last_size"]))
    many = F.when(F.coalesce(count_12m, F.lit(0)) != 0, F.concat(F.lit("investments past 12 months: "), count_12m.cast("string")))
    counts = F.concat_ws(" | ", part("total investments", m["total"]), part("investments past 5 years", m["five_years"]), part("investments past 24 months", m["two_years"]), part("active portfolio companies", m["active"]), many)
    now = F.lit(today)
    return F.array_compact(
        F.array(
            F.when((m["last_company"] != "") | (m["last_date"] != ""), signal("pitchbook_activity", deal, F.when(m["last_date"] != "", m["last_date"]).otherwise(now), 0.85)),
            F.when(counts != "", signal("pitchbook_activity_count", F.concat(F.lit("PitchBook activity counts | "), counts), now, 0.80)),
            F.when(m["fundraising"] != "", signal("fundraising_status", F.concat(F.lit("PitchBook fundraising outlook: "), m["fundraising"]), now, 0.75)),
        )
    )


def replace_kinds(existing: DataFrame, generated: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """existing without the generated kinds, and the generated rows."""
    return existing.filter(~F.col(kind).isin(kinds)).unionByName(generated)


def missing(names: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit("missing")) == "missing", F.lit(n)) for n in names]))
