"""References of pages against urljoin, dates in any writing, and parsed items."""

from __future__ import annotations

import datetime as dt
import itertools
import warnings
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F

from tallyforge.functions import layout
from tallyforge.functions.dates import any_date
from tallyforge.functions.urls import anchors, joined

#: The examples of RFC 3986, 5.4, and others that pages have.
REFERENCES = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "g#s/../x", "http:g", "HTTP:g", "https://x.org", "https://x.org/a/../b?q#f", "mailto:a@b.c", "javascript:void(0)", "tel:+1", "a//b", "//h.org//a", "/a//b/", "  /pad ", "a\tb\nc", "g?", "g#", "?", "#", "a b", "é/ß?ü", "a:b", "1:2", "./a:b", "ftp://f/x"]
BASES = ["http://a/b/c/d;p?q", "https://acme.com", "https://acme.com/", "https://acme.com/p?x=1#f", "https://acme.com/a/b/", "https://acme.com/a//b/../c", "http://a/..", ""]


def test_joined_equals_urljoin(spark):
    rows = list(itertools.product(BASES, REFERENCES))
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, h string").select("i", joined(F.col("b"), F.col("h")).alias("u")).collect()
    wrong = [(rows[r.i], r.u, urljoin(*rows[r.i])) for r in got if r.u != urljoin(*rows[r.i])]
    assert not wrong, wrong[:20]


def test_anchors(spark):
    html = """<p><A class=x HREF='/a?x=1&amp;y=2'>One <b>bold</b>
    text</A><a name=n>no</a><a href=plain>P</a> <a\nhref="q">open <a href="">e</a><abbr href="no">"""
    got = [tuple(x) for x in spark.createDataFrame([(html,)], "h string").select(F.inline(anchors(F.col("h")))).collect()]
    assert [(h, t) for _, h, t in got] == [("/a?x=1&y=2", "One bold text"), ("plain", "P"), ("q", "open"), ("", "e")] and [p for p, _, _ in got] == [0, 1, 2, 3]
    assert spark.createDataFrame([(None,)], "h string").select(F.inline(anchors(F.col("h")))).count() == 0


D = dt.date
#: Worked out by hand.
WRITINGS = {
    "2024-01-05": D(2024, 1, 5), "2024-1-5": D(2024, 1, 5), "2024/01/05": D(2024, 1, 5), "2024.01.05": D(2024, 1, 5), "20240105": D(2024, 1, 5), "2024-01": D(2024, 1, 1), "01-2024": D(2024, 1, 1), "1/2024": D(2024, 1, 1), "2024": D(2024, 1, 1),
    "01/05/2024": D(2024, 1, 5), "1/5/2024": D(2024, 1, 5), "13/5/2024": D(2024, 5, 13), "05-01-2024": D(2024, 5, 1), "1/5/24": D(2024, 1, 5), "1-5-99": D(1999, 1, 5),
    "January 5, 2024": D(2024, 1, 5), "Jan 5 2024": D(2024, 1, 5), "JAN 5, 2024": D(2024, 1, 5), "5 January 2024": D(2024, 1, 5), "5 Jan 2024": D(2024, 1, 5), "5-Jan-2024": D(2024, 1, 5), "05-JAN-24": D(2024, 1, 5), "Jan-05-2024": D(2024, 1, 5), "2024 Jan 5": D(2024, 1, 5), "2024-Jan-05": D(2024, 1, 5),
    "Jan 2024": D(2024, 1, 1), "January 2024": D(2024, 1, 1), "Jan. 2024": D(2024, 1, 1), "2024 January": D(2024, 1, 1), "Sept 5, 2023": D(2023, 9, 5), "Sep 5, 2023": D(2023, 9, 5), "September 2023": D(2023, 9, 1), "May 2024": D(2024, 5, 1), "5th of January 2024": D(2024, 1, 5), "January 5th, 2024": D(2024, 1, 5), "1st Feb 2024": D(2024, 2, 1), "22nd March 2024": D(2024, 3, 22), "3rd May 2024": D(2024, 5, 3),
    "Fri, 5 Jan 2024": D(2024, 1, 5), "Friday January 5, 2024": D(2024, 1, 5), "Fri Jan 5 2024": D(2024, 1, 5), "2024-01-05 10:30": D(2024, 1, 5), "2024-01-05T10:30:00": D(2024, 1, 5), "2024-01-05T10:30:00Z": D(2024, 1, 5), "2024-01-05 10:30:00.123456": D(2024, 1, 5), "2024-01-05T23:30:00+05:30": D(2024, 1, 5), "Jan 5, 2024 10:30 PM": D(2024, 1, 5), "5 Jan 2024 at 10:30": D(2024, 1, 5), "01/05/2024 10:30:15 am": D(2024, 1, 5), "20240105T103000": None,
    "2024Q1": D(2024, 1, 1), "2024-Q3": D(2024, 7, 1), "Q4 2023": D(2023, 10, 1), "q2-2024": D(2024, 4, 1), "  2024-01-05  ": D(2024, 1, 5), "2024-02-29": D(2024, 2, 29),
    "": None, "nan": None, "unknown": None, "n/a": None, "2023-02-29": None, "2024-13-05": None, "13/13/2024": None, "Jan 5": None, "5": None, "32 Jan 2024": None, "next Friday": None, "Jan Feb 2024": None, "about 2024": None, "2024-01-05 or so": None, "$5": None, "1/2/3/4": None, "99999": None,
}


def test_dates_in_any_writing(spark):
    keys = list(WRITINGS)
    got = spark.createDataFrame([(i, k) for i, k in enumerate([*keys, None])], "i int, t string").select("i", any_date(F.col("t")).alias("d")).orderBy("i").collect()
    wrong = [(k, r.d, WRITINGS.get(k)) for k, r in zip([*keys, None], got, strict=True) if r.d != WRITINGS.get(k)]
    assert not wrong, wrong
    assert spark.createDataFrame([("3/4/2024",)], "t string").select(any_date(F.col("t"), dayfirst=True).alias("d")).first().d == D(2024, 4, 3)


def test_dates_agree_with_pandas(spark):
    """Where pandas reads a writing of the table too, it reads the same day."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        read = {k: pd.to_datetime(k, errors="coerce") for k in WRITINGS}
    other = {k: (v, WRITINGS[k]) for k, v in read.items() if not pd.isna(v) and WRITINGS[k] is not None and v.date() != WRITINGS[k]}
    assert not other, other
    assert sum(not pd.isna(v) for v in read.values()) > 40


def test_items_of_all_shapes(spark):
    items = [
        '{"label": "table", "text": " a  b ", "prov": [{"page_no": 3, "bbox": {"l": 1, "t": "2", "r": 3.5, "b": 4, "coord_origin": "BOTTOMLEFT"}}]}',
        '{"class": "x", "orig": "o", "prov": {"page_index": 0, "bbox": {"bbox": [1, 2, 3, 4]}}}', '{"label": "", "caption": "c", "page": "7", "bbox": {"x0": 0, "y0": 1, "right": 2, "y1": 3}}', '{"prov": {"bbox": {"l": 1}}, "bbox": [5, 6, 7, 8]}', "no json", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "i int, t string").select("i", layout.parsed_item(F.col("t")).alias("v"))
    rows = df.select("i", layout.item_label(F.col("v")).alias("label"), layout.item_text(F.col("v")).alias("text"), layout.item_page(F.col("v")).alias("page"), layout.item_box(F.col("v")).alias("box")).orderBy("i").collect()
    assert [(r.label, r.text, r.page) for r in rows] == [("table", "a b", 3), ("x", "o", 1), ("", "c", 7), ("", "", None), ("", "", None), ("", "", None)]
    assert [None if r.box is None else tuple(r.box)[:4] for r in rows] == [(1, 2, 3.5, 4), (1, 2, 3, 4), (0, 1, 2, 3), (5, 6, 7, 8), None, None]
