from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make


#: Names that operators use for columns of their own, and one that needs quoting.
CLASHES = ["score", "_text", "_id", "_h", "_host", "_path", "_evidence", "_score", "_threshold", "_copies", "_copy", "_lang", "host_posterior", "path_posterior", "node", "kept", "rate", "target", "_row", "first_h", "a.b", "Component_Id"]


def odd_rows(spark, text_ids=False):
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [(1, None, "en", None, 1), (2, "", None, "a", 0), (3, "  \n\t ", "en", "a", 4), (4, long, "en", "a", 1), (5, "one", "en", "a", 3), (5, "one", "en", "a", 3), (None, "no id here at all", "en", "a", 17), (6, "ünï 漢字 😀 \x00 end", "de", None, 1)]
    kind = "string" if text_ids else "long"
    rows = [(f"doc/{i}" if text_ids and i is not None else i, *rest, *range(len(CLASHES))) for i, *rest in rows]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with what operators add."""
    return odd_rows(spark)


@pytest.fixture(scope="session")
def odd_text_ids(spark):
    """The same with ids that are texts."""
    return odd_rows(spark, True)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 != 0, i % 4 == 0) for i in range(60)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic")
