"""Main text of an HTML page, by regular expressions; parser-grade extraction stays behind a pandas UDF."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def article_text(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1)
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(inner, r"<[^>]+>", " "), r"\s+", " ")))


class _Visible(HTMLParser):
    """Text of a page: all of it without navigation, header and footer, and that of its first main part."""

    never = frozenset({"script", "style", "noscript"})
    chrome = frozenset({"nav", "footer", "header"})
    beside = frozenset({"nav", "footer", "aside", "form"})
    empty = frozenset({"meta", "br", "img", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"})
    described_by = (("name", "description"), ("property", "og:description"), ("name", "twitter:description"))

    def __init__(self):
        super().__init__()
        self.open, self.main, self.done = [], None, False
        self.all, self.inner, self.described = [], [], {}

    @staticmethod
    def _is_main(tag, have) -> bool:
        classes = (have.get("class") or "").split()
        return tag in ("main", "article") or have.get("role") == "main" or have.get("id") in ("main", "content") or any(c in ("main-content", "content-main", "post-content", "entry-content") for c in classes)

    def handle_starttag(self, tag, attrs):
        have = dict(attrs)
        if tag == "meta":
            for key in self.described_by:
                if have.get(key[0]) == key[1] and have.get("content"):
                    self.described.setdefault(key, have["content"].strip())
        if tag in self.empty:
            return
        self.open.append(tag)
        if self.main is None and not self.done and self._is_main(tag, have):
            self.main = len(self.open)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open.pop() != tag:
            pass
        if self.main is not None and len(self.open) < self.main:
            self.main, self.done = None, True

    def handle_data(self, data):
        text = data.strip()
        if not text or not self.never.isdisjoint(self.open):
            return
        if self.chrome.isdisjoint(self.open):
            self.all.append(text)
        if self.main is not None and self.beside.isdisjoint(self.open[self.main :]):
            self.inner.append(text)


def visible_text(html: str | None) -> str:
    """Descriptions, and the text of the first main part, else of the page without its chrome; lower case."""
    p = _Visible()
    p.feed(html or "")
    p.close()
    body = p.inner if p.done or p.main is not None else p.all
    return " ".join([*(p.described[k] for k in p.described_by if k in p.described), " ".join(body)]).lower()


def page_text(html: Column) -> Column:
    """visible_text as a column, in Arrow batches."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield part.map(visible_text)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(work, "string")(html)
