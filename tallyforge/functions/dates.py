"""Dates and amounts out of text, and ladders over ages. All take the date to compare with; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.fixed import MONTH_PATTERN, MONTHS
from tallyforge.functions.text import bound


def parse_date(text: Column) -> Column:
    """A date in one of four formats, from the first 11 characters, or ISO from the first 10; else null."""
    head = F.trim(F.substring(text, 1, 11))
    tried = [F.to_date(F.try_to_timestamp(head, F.lit(f))) for f in ("yyyy-M-d", "d-MMM-yyyy", "yyyy/M/d", "M/d/yyyy")]
    return F.coalesce(*tried, F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))


#: Words that a date may have around its numbers and month (fixed values): they say nothing.
DATE_FILLERS = ("at", "on", "and", "ad", "of", "st", "nd", "rd", "th", "the", "mon", "monday", "tue", "tues", "tuesday", "wed", "wednesday", "thu", "thur", "thurs", "thursday", "fri", "friday", "sat", "saturday", "sun", "sunday")
MONTH_WORDS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: The last year of two digits that is of this century.
PIVOT = 68


def any_date(text: Column, dayfirst: bool = False) -> Column:
    """The date that a text names, in any common writing; null if it names none, or something else.

    The time of day is cut off. What is left is cut into numbers, words and signs, and one fold over these collects numbers
    (and how many digits each has), the month that a word names and where it stood; any other word makes the text none.
    The year is the number of four digits, or beyond 31; the rest is read as month and day, the month first unless it is
    beyond 12 (or dayfirst). Without a day it is the first; a quarter is its first day; without a year there is no date.
    """
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    clock = r"(?:^|[\sT,]|(?<=\d)t)\s*\d{1,2}(?::\d{2}){1,2}(?:[.,]\d+)?\s*(?:[ap]\.?m\.?)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"
    day_only = F.trim(F.regexp_replace(low, clock, " "))
    quarter = F.concat(F.regexp_extract(day_only, r"^(\d{4})[\s-]?q[1-4]$", 1), F.regexp_extract(day_only, r"^(?:q[1-4]|[1-4]q)[\s-]?(\d{4})$", 1))
    of_quarter = F.regexp_extract(day_only, r"(?:q([1-4])|^[1-4]q)", 1)
    nth = F.coalesce(of_quarter.try_cast("int"), F.regexp_extract(day_only, r"^([1-4])q", 1).try_cast("int"))
    tokens = F.regexp_extract_all(day_only, F.lit(r"([^\W\d_]+|\d+|[^\s\w.,;/'-]|_)"), F.lit(1))
    none = F.array().cast("array<int>")

    def month(word: Column) -> Column:
        names = F.array(*map(F.lit, MONTH_WORDS))
        at = F.array_position(F.transform(names, lambda m: (m == word) | ((F.length(word) == 3) & m.startswith(word)) | ((m == "september") & (word == "sept"))), True)
        return F.when(at > 0, at.cast("int"))

    def step(state: Column, token: Column) -> Column:
        number, named = token.rlike(r"^\d+$") & (F.length(token) <= 8), month(token)
        known = token.isin(*DATE_FILLERS)
        return F.struct(
            F.when(number, F.concat(state.nums, F.array(token.try_cast("int")))).otherwise(state.nums).alias("nums"), F.when(number, F.concat(state.digits, F.array(F.length(token)))).otherwise(state.digits).alias("digits"),
            F.coalesce(state.month, F.when(~number, named)).alias("month"), F.when(state.month.isNull() & ~number & named.isNotNull(), F.size(state.nums)).otherwise(state["at"]).alias("at"),
            (state.bad | (~number & ~known & named.isNull()) | (~number & named.isNotNull() & state.month.isNotNull())).alias("bad"),
        )

    start = F.struct(none.alias("nums"), none.alias("digits"), F.lit(None).cast("int").alias("month"), F.lit(None).cast("int").alias("at"), F.lit(False).alias("bad"))
    return bound(F.aggregate(tokens, start, step), lambda s: F.when(quarter != "", _day(quarter.try_cast("int"), 3 * nth - 2, F.lit(1))).when(~s.bad & ~F.array_contains(s.digits, 0), _resolved(s, dayfirst)))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.to_date(F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)))


def _full_year(y: Column, digits: Column) -> Column:
    return F.when((digits <= 2) & (y <= PIVOT), y + 2000).when(digits <= 2, y + 1900).when(digits == 4, y)


def _resolved(s: Column, dayfirst: bool) -> Column:
    """The date of up to three numbers and a month's name."""
    n = F.size(s.nums)
    num, digits = (lambda i: F.get(s.nums, F.lit(i))), (lambda i: F.get(s.digits, F.lit(i)))
    is_year = lambda i: F.coalesce((digits(i) == 4) | ((digits(i) == 2) & (num(i) > 31)), F.lit(False))
    year = lambda i: _full_year(num(i), digits(i))
    one = F.lit(1)

    def in_order(a: Column, b: Column, y: Column) -> Column:
        """A day and a month before or behind the year."""
        swap = (a > 12) | F.lit(dayfirst) & (b <= 12)
        return F.when(swap, _day(y, b, a)).otherwise(_day(y, a, b))

    whole = F.when((n == 1) & (digits(0) == 8), _day((num(0) / 10_000).cast("int"), (num(0) / 100).cast("int") % 100, num(0) % 100))
    named = (
        F.when((n == 1) & (is_year(0) | (digits(0) == 4)), _day(year(0), s.month, one))
        .when((n == 2) & is_year(0), _day(year(0), s.month, num(1))).when((n == 2) & is_year(1), _day(year(1), s.month, num(0)))
        .when(n == 2, _day(year(1), s.month, num(0)))
    )
    bare = (
        F.when((n == 1) & (digits(0) == 4), _day(year(0), one, one))
        .when((n == 2) & is_year(0) & (digits(0) == 4), _day(year(0), num(1), one)).when((n == 2) & is_year(1) & (digits(1) == 4), _day(year(1), num(0), one))
        .when((n == 3) & is_year(0), _day(year(0), num(1), num(2)))
        .when((n == 3) & (F.greatest(digits(0), digits(1)) <= 2), in_order(num(0), num(1), year(2)))
    )
    return F.when(whole.isNotNull(), whole).when(s.month.isNotNull(), named).otherwise(bare)


def recency_score(last: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, last)
    return F.when(last.isNull(), 0.5).when(days < 90, 1.0).when(days < 365, 0.7).when(days < 730, 0.4).when(days < 1095, 0.2).otherwise(0.05)


def recent_points(last: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, last)
    return F.when(last.isNull(), 0).when(days <= 90, 3).when(days <= 180, 2).when(days <= 365, 1).otherwise(0)


def dates_in_text(text: Column, as_of: Column) -> Column:
    """Dates that five patterns find in a text, of 2020 up to the year after as_of; in the order of the patterns."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(low, F.lit("(" + pattern + ")"), F.lit(1))

    def number(x: Column, pattern: str) -> Column:
        return F.regexp_extract(x, pattern, 1).cast("int")

    def month(x: Column) -> Column:
        return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.regexp_extract(x, r"([a-z]+)", 1), 1, 3)).cast("int")

    def made(array: Column, y: str, m: str | None, d: str | None) -> Column:
        return F.transform(array, lambda x: F.to_date(F.try_make_timestamp(number(x, y), number(x, m) if m else month(x), number(x, d) if d else F.lit(1), F.lit(0), F.lit(0), F.lit(0))))

    name = MONTH_PATTERN
    every = F.concat(
        made(found(r"\b20\d{2}-\d{1,2}-\d{1,2}\b"), r"^(\d{4})", r"-(\d{1,2})-", r"-(\d{1,2})$"),
        made(found(rf"\b{name}\s+\d{{1,2}}[,\s]+20\d{{2}}\b"), r"(\d{4})$", None, r"[a-z]\s+(\d{1,2})"),
        made(found(rf"\b\d{{1,2}}\s+{name}\s+20\d{{2}}\b"), r"(\d{4})$", None, r"^(\d{1,2})"),
        made(found(rf"\b{name}\s+20\d{{2}}\b"), r"(\d{4})$", None, None),
        made(found(r"\b\d{1,2}/\d{1,2}/20\d{2}\b"), r"(\d{4})$", r"^(\d{1,2})", r"/(\d{1,2})/"),
    )
    return F.filter(every, lambda d: d.isNotNull() & F.year(d).between(F.lit(2020), F.year(as_of) + 1))


def check_range(text: Column) -> tuple[Column, Column]:
    """Least and greatest amount of a cheque range such as $250K-$2M; one amount stands for itself and its double."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ",", ""), r"[$-]", " "), r"\s+")
    amounts = F.array_compact(F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+(\.\d+)?[km]$")), lambda p: (F.regexp_replace(p, "[km]$", "").cast("double") * F.when(p.endswith("k"), 1e3).otherwise(1e6)).cast("long")))
    n = F.size(amounts)
    low = F.when(n >= 1, F.array_min(amounts)).otherwise(F.lit(250_000))
    high = F.when(n >= 2, F.array_max(amounts)).when(n == 1, F.get(amounts, F.lit(0)) * 2).otherwise(F.lit(3_000_000))
    return low.cast("long"), high.cast("long")


def to_amount(text: Column) -> Column:
    """The first number, times the first of b, m, k that the text has anywhere."""
    t = F.regexp_replace(F.trim(text), ",", "")
    low = F.lower(t)
    n = F.when(t.rlike(r"\d"), F.regexp_extract(t, r"(\d+(\.\d+)?)", 1)).cast("double")
    return n * F.when(F.contains(low, F.lit("b")), 1e9).when(F.contains(low, F.lit("m")), 1e6).when(F.contains(low, F.lit("k")) | F.contains(low, F.lit("thousand")), 1e3).otherwise(1.0)
