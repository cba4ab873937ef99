"""Text scalars: tokens, taggers, cleaning, templates. Column -> Column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.fixed import GEO_ALIASES, GEO_BROAD, GEO_DERIVED, STAGE_ALIASES, STOP_WORDS


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value for a key of a fixed map; null where there is none."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(table, key)


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of more than two characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-zA-Z0-9_+#.-]+)"), F.lit(1))
    return F.array_except(F.filter(found, lambda t: F.length(t) > 2), strings(STOP_WORDS))


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms are substrings of the text."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms is a substring: one regular expression, so the text is evaluated once."""
    return text.rlike("|".join(re.escape(t) for t in terms))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms is a substring, by plain search; for a text that is a column or a bound variable."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tag_terms(text: Column, needles: dict[str, Sequence[str]]) -> Column:
    """Labels of which a needle is in the text, padded by a space on either side. Needles that contain others of a label
    are not searched for."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    least = {label: [w for w in words if not any(o != w and o in w for o in words)] for label, words in needles.items()}
    return bound(padded, lambda t: F.array_compact(F.array(*[F.when(contains_any(t, words), F.lit(label)) for label, words in least.items()])))


def _holds(word: str):
    return lambda x: F.contains(x, F.lit(word))


def geo_tokens(values: Column) -> Column:
    """Place names of a list of texts: split, squeezed, aliased, with the regions they imply."""
    parts = F.flatten(F.transform(values, lambda v: F.split(F.lower(F.coalesce(v, F.lit(""))), r"[,;/|]|\s+and\s+")))
    clean = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"\s+", " ")), lambda p: p != "")
    named = F.transform(clean, lambda p: F.coalesce(lookup(GEO_ALIASES, p), p))
    implied = F.array_compact(F.array(*[F.when(F.exists(clean, _holds(d)), F.lit(d)) for d in GEO_DERIVED]))
    return F.array_distinct(F.concat(named, implied))


def geography_matches(wanted: Column, there: Column) -> Column:
    """Whether two lists of places agree; empty lists and broad regions always do."""
    a, b = geo_tokens(wanted), geo_tokens(there)
    return (F.size(there) == 0) | (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(b, strings(GEO_BROAD)) | F.arrays_overlap(a, b)


def clean_text(value: Column) -> Column:
    t = F.trim(value.cast("string"))
    return F.when(value.isNull() | F.lower(t).isin("nan", "none", "nat"), "").otherwise(t)


def field_blob(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[clean_text(c) for c in columns]))


def summarize(text: Column, most: int) -> Column:
    """White space squeezed, cut to so many characters with an ellipsis."""
    def cut(t: Column) -> Column:
        return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))

    return bound(F.regexp_replace(clean_text(text), r"\s+", " "), cut)


def slugify(text: Column, fallback: str = "item") -> Column:
    s = F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9]+", "_"), F.lit("_")))
    return bound(s, lambda x: F.when(x == "", fallback).otherwise(x))


def safe_text(text: Column) -> Column:
    """No NUL, runs of blanks as one, at most one empty line in a row, trimmed."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \t\n\x0b\f\r"))


def normalize_stage(label: Column) -> Column:
    return lookup(STAGE_ALIASES, F.translate(F.lower(F.trim(label)), "- ", "__"))


def stage_from_raise(amount: Column) -> Column:
    return F.when(amount <= 1_500_000, "seed").when(amount <= 5_000_000, "series_a").when(amount <= 15_000_000, "series_b").otherwise("growth")


def tiered_merge(sheet: Column, official: Column, news: Column, snippet: Column, terms: Sequence[str], thin: int) -> Column:
    """Higher tiers always; the lowest only where they are blank, thin, or cover the terms less than it does."""
    s, o, n, q = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (sheet, official, news, snippet))
    so_far = F.array_join(F.filter(F.array(s, o, n), lambda x: x != ""), " ")

    def merged(x: Column) -> Column:
        weak = (F.length(x.m) < thin) | (hits(x.m, terms) == 0) | (hits(x.q, terms) > hits(x.m, terms))
        return F.when((x.q != "") & weak, F.trim(F.concat_ws(" ", F.when(x.m != "", x.m), x.q))).otherwise(x.m)

    return bound(F.struct(so_far.alias("m"), q.alias("q")), merged)
