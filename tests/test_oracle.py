"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from tallyforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def cell(v):
    if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if math.isfinite(v) and v == int(v) else f"{v:.5f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return str(v)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.execute(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    """A missing package leaves the other queries as they are."""
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("tallyforge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLE_SQL)
