"""Word hashes, token counts and licence scans against plain versions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import common, license_scan, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans(license_scan.UPPER, license_scan.LOWER)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t-漢0", max_size=30)), max_size=6))
def test_words_follow_the_patterns(texts):
    for table, pattern in ((common.SPACE, r"[^\x20\x09-\x0D]+"), (common.NOT_ALNUM, license_scan.WORD)):
        got = common.words_of(pa.array(texts, pa.string()), table)
        words = [re.findall(pattern, (t or "").translate(LOW)) for t in texts]
        assert np.diff(got.offsets).tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        assert len(set(zip(flat, got.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(got.hashes.tolist()))


def test_words_of_long_texts_are_not_cut():
    texts = ["ab " * 900_000, "x" * 3_000_000 + " y", "", "z"]
    got = common.words_of(pa.array(texts), common.SPACE)
    assert np.diff(got.offsets).tolist() == [900_000, 2, 0, 1]
    assert len(set(got.hashes[:900_000].tolist())) == 1


def test_counts_equal_the_library():
    t = token_counts._tokenizer(PATH)
    texts = ["", "Hello  world\n\n x", "a<|endoftext|>b <|endoftext|>", "it's 12, é　ｆ  ", "\x00�", "zz" * 500, "   "]
    counter = token_counts.PreTokenCounter(PATH, token_counts.whole_tokens(PATH))
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want
    assert counter.count(texts) == want  # from the memo


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_counts_equal_the_library_on_any_text(text):
    t = token_counts._tokenizer(PATH)
    assert token_counts.PreTokenCounter(PATH, ["a"]).count([text]) == [len(t.encode(text, add_special_tokens=False).ids)]


def test_counts_equal_the_library_on_all_kinds_of_characters():
    """Every 29th code point, beside letters, digits, blanks and itself (all of them were swept once)."""
    t = token_counts._tokenizer(PATH)
    counter = token_counts.PreTokenCounter(PATH, token_counts.whole_tokens(PATH))
    points = [chr(x) for x in range(0, 0x110000, 29) if not 0xD800 <= x <= 0xDFFF]
    texts = [f"a{c}b{c}1 {c}{c} .{c}" for c in points]
    assert counter.count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_proved():
    t = token_counts._tokenizer(PATH)
    whole = token_counts.whole_tokens(PATH)
    assert len(whole) > 45_000 and all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::997])


def test_count_query_on_odd_rows(odd, none):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens > 0, r.over_limit) for r in token_counts.count_tokens(odd, PATH).collect())
    assert len(got) == 8 and got.count((5, 3, True, False)) == 2 and (1, 0, False, False) in got and (2, 0, False, False) in got and (4, got[[g[0] for g in got].index(4)][1], True, True) in got
    assert token_counts.count_tokens(none, PATH).count() == 0


def plain_scan(text):
    w = license_scan.words(text or "")
    places = {}
    for label, phrase, base in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        if at:
            places[label] = (at, base)
    base = [i for at, b in places.values() if b for i in at]
    return len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(n for n, (_, b) in places.items() if b)), sorted(places)


def test_scan_equals_plain_search(spark, docs, odd, none):
    mit = next(t for n, t in license_scan.BODIES if n == "mit-text")
    edited = mit.replace("without restriction", "with no restriction at all").replace("merge, ", "")
    texts = ["Released under the MIT License.", "mit licenseapache license", "GNU General Public License, version 3 and the mit license; MIT-LICENSE", None, "", "Kit license K", f"x y z {mit} end", f"{edited} and {mit}", mit[:60]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(rows)).collect()}
    for i, t in enumerate(texts):
        n, n_base, first, last, base, labels = plain_scan(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, base)
        assert [x for x in r.labels.split(",") if x and not x.endswith("-text")] == labels and 0 <= r.score <= 1
    assert "mit-text" in got[6].labels and "mit-text" in got[7].labels and "mit-text" not in got[8].labels
    spans = [(r.first_word, r.last_word) for r in license_scan.license_spans(docs(rows)).filter("doc_id = 6 AND label = 'mit-text'").collect()]
    assert spans == [(3, 2 + len(license_scan.words(mit)))]
    assert Counter(r.doc_id for r in license_scan.license_scan(odd).collect()) == Counter([1, 2, 3, 4, 5, 5, None, 6])
    assert license_scan.license_scan(none).count() == 0


def test_scan_equals_sql(spark, sf):
    import duckdb

    from tallyforge.llm.queries import op5_license_scan

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(str, c.execute(license_scan.license_scan_sql()).fetchall()))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(str(tuple(r)) for r in op5_license_scan(spark, sf).select(*names).collect()) == want


def test_scan_plan_is_native(spark, sf):
    from tallyforge.llm.queries import op5_license_scan

    plan = op5_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan
