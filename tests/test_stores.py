"""Stores on disk: JSON by byte ranges, tables in buckets, embedding runs that go on."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from tallyforge.operators import cache, embedding_run
from tallyforge.sources import json_ranges
from tallyforge.sources.bucket_store import BucketStore, StoreChanged, set_columns

# ---- ranges of JSON --------------------------------------------------------------------


def tricky(n, seed=1):
    """Names and hashes full of quotes, backslashes, brackets and letters of several bytes, between other members."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "漢", "a", " ", "\n", "\\\\", '\\"']) for _ in range(r.choice([0, 1, 3, 9])))
    members = {word() + str(i): {ns: r.choice([[1.5, -2e-7 * i], {"v": [float(i), 0.25], "h": word()}, {"v": [3.0], "h": ""}]) for ns in r.sample(cache.NAMESPACES, r.choice([1, 2, 4]))} for i in range(n)}
    return {"before": {"embeddings": {"no": {"fund_thesis": [9.0]}}, "x": word()}, "model": "m", "list": [[], {}, word()], "embeddings": members, "behind": {"id": {"portfolio": [1.0]}, "model": "other"}, "n": 3}


def expected(doc):
    return {(i, ns): (x, "") if isinstance(x, list) else (x["v"], x["h"]) for i, by in doc["embeddings"].items() for ns, x in by.items()}


@pytest.mark.parametrize("indent", [None, 3])
def test_ranges_give_the_same_members(spark, tmp_path, indent):
    doc = tricky(40)
    text = json.dumps(doc, indent=indent, ensure_ascii=indent is None)
    (tmp_path / "c.json").write_text(text)
    size = len(text.encode())
    for ranges in (1, 3, 50, 400):
        each = -(-size // ranges)
        got = cache.read(spark, f"{tmp_path}/c.json", "m", each)
        assert {(r.investor_id, r.namespace): (r.vector, r.text_hash) for r in got.collect()} == expected(doc), ranges
        if ranges == 50:
            assert got.rdd.getNumPartitions() > 30
    assert cache.read(spark, f"{tmp_path}/c.json", "other", 1000).count() == 0


def test_every_cut_is_right(tmp_path):
    """Two ranges, cut at every byte: the state at the cut, and the members on both sides."""
    text = json.dumps({"a": ['\\"', "}"], "o": {'k\\"{': {"x": ["]\\\\", 1]}, "": "v,", "k3": [], "é": {}}, "z": {"k": 1}}, ensure_ascii=False).encode()
    path = tmp_path / "j.json"
    path.write_bytes(text)
    want = [(k, json.dumps(v, ensure_ascii=False)) for k, v in json.loads(text)["o"].items()]
    with json_ranges.open_file(f"file://{path}") as file:
        for cut in range(1, len(text)):
            ranges = json_ranges.chain([(str(path), a, b, *json_ranges.summary(file, a, b)) for a, b in ((0, cut), (cut, len(text)))])
            marks = [m for r in ranges for m in json_ranges.root_members(file, r, ["o"])]
            at = [i for i, (_, n) in enumerate(marks) if n == "o"][0]
            got = []
            for r in ranges:
                r.first, r.last = marks[at][0] + 1, marks[at + 1][0]
                if r.end > marks[at][0] and r.start < r.last:
                    got += json_ranges.members(file, r)
            assert got == want, cut


def test_quotes_behind_backslashes():
    r = np.random.default_rng(1)
    for _ in range(300):
        block = r.choice(np.frombuffer(b'"\\\\a', np.uint8), r.integers(1, 12))
        for escaped in (False, True):
            want, esc = [], escaped
            for c in bytes(block):
                want.append(c == 34 and not esc)
                esc = c == 92 and not esc
            got, last = json_ranges.quotes(block.copy(), escaped)
            assert got.tolist() == want and last == esc


def test_odd_cache_files(spark, tmp_path):
    assert cache.read(spark, f"{tmp_path}/none.json", "m").count() == 0
    cases = {"empty": "", "cut": '{"model": "m", "embeddings": {"a": {"portfolio": [1', "list": "[1, 2]", "bare": '{"model": "m"}', "no": '{"model": "m", "embeddings": {}}', "twice": '{"model": "x", "embeddings": {"a": {"activity": [1]}}, "model": "m", "embeddings": {"b": {"activity": [2.0]}}}'}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    for name in ("empty", "bare", "no"):
        assert cache.read(spark, f"{tmp_path}/{name}.json", "m", 5).count() == 0
    with pytest.warns(UserWarning, match="cut off"):
        assert cache.read(spark, f"{tmp_path}/cut.json", "m", 5).count() == 0
    assert cache.read(spark, f"{tmp_path}/list.json", "m", 5).count() == 0
    assert [(r.investor_id, r.vector) for r in cache.read(spark, f"{tmp_path}/twice.json", "m", 7).collect()] == [("b", [2.0])]


def test_written_files_are_json_and_come_back(spark, tmp_path):
    rows = [(f'i"{i % 30}\\', ns, [float(i), 0.5], None if i % 3 == 0 else f"h{i}") for i, ns in enumerate(cache.NAMESPACES * 20) if i % 7]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    cache.write(spark.createDataFrame(rows, "investor_id string, namespace string, vector array<double>, text_hash string"), f"{tmp_path}/c", "m", 3)
    files = json_ranges.listing(spark, f"{tmp_path}/c")
    assert len(files) == 3 and all(json.load(open(p.removeprefix("file://")))["model"] == "m" for p, _ in files)
    got = {(r.investor_id, r.namespace, tuple(r.vector), r.text_hash) for r in cache.read(spark, f"{tmp_path}/c", "m", 100).collect()}
    assert got == {(a, b, tuple(v), h or "") for a, b, v, h in rows}


# ---- buckets ---------------------------------------------------------------------------

ROWS = "id long, x double, meta string"


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s")
    old = spark.createDataFrame([(i, float(i), "old") for i in range(200)], ROWS)
    store.create(["id"], old.schema, 8)
    assert store.read().count() == 0
    store.upsert(old)
    before, v = store.files(), store.version()
    new = spark.createDataFrame([(3, -3.0, "new"), (1000, 5.0, "new")], ROWS)
    touched = {r.b for r in new.select(store.bucket_of(v).alias("b")).collect()}
    store.upsert(new)
    after = store.files()
    assert 0 < len(touched) < 8 and all((after[b] == before[b]) == (b not in touched) for b in before)
    got = {r.id: (r.x, r.meta) for r in store.read().collect()}
    assert got == {i: (float(i), "old") for i in range(200)} | {3: (-3.0, "new"), 1000: (5.0, "new")}
    # the version before is there until it is cleared away
    assert store.read(store.version(2)).count() == 200
    assert store.vacuum() == 0 and store.versions() == [3]  # the first commit still holds buckets
    store.upsert(spark.createDataFrame([(i, 0.0, "") for i in range(200)] + [(1000, 0.0, "")], ROWS))
    assert store.vacuum() == 2 and store.read().agg({"x": "sum"}).first()[0] == 0.0


def test_columns_order_and_repeats(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s").create(["id"], spark.createDataFrame([], ROWS).schema, 4)
    store.upsert(spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (None, 7.0, "null key")], ROWS))
    new = spark.createDataFrame([(1, 5.0, "b", 2), (1, 6.0, "c", 1), (2, None, "d", 1), (3, 3.0, "e", 1), (None, 8.0, "f", 1)], ROWS + ", at int")
    store.upsert(new, set_columns("x"), order="at")
    assert {r.id: (r.x, r.meta) for r in store.read().collect()} == {1: (5.0, "a"), 2: (None, None), 3: (3.0, "e"), None: (8.0, "null key")}
    assert store.upsert(new.limit(0)).number == 3


def test_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    a = BucketStore(spark, f"{tmp_path}/s").create(["id"], spark.createDataFrame([], ROWS).schema, 4)
    b = BucketStore(spark, f"{tmp_path}/s")
    stale = b.version()
    a.upsert(spark.createDataFrame([(1, 1.0, "a")], ROWS))
    monkeypatch.setattr(b, "version", lambda number=None: stale)
    with pytest.raises(StoreChanged):
        b.upsert(spark.createDataFrame([(1, 2.0, "b")], ROWS))
    assert [(r.id, r.x) for r in a.read().collect()] == [(1, 1.0)]
    # half a manifest does not count
    (tmp_path / "s/manifest/0000000003.json").write_text('{"keys": ["id"')
    assert a.version().number == 2 and a.read().count() == 1


# ---- runs ------------------------------------------------------------------------------


def test_a_run_goes_on_where_it_ended(spark, tmp_path):
    texts = spark.createDataFrame([(str(i), ns, f"t{i}{ns}") for i in range(60) for ns in ("portfolio", "activity")], "investor_id string, namespace string, text string")
    seen = tmp_path / "seen"
    seen.mkdir()

    def embed(batch):
        import uuid

        if any(t.startswith("t7") for t in batch) and len(batch) > 1:
            raise ValueError("not in a batch")
        (seen / uuid.uuid4().hex).write_text("\n".join(batch))
        if batch[0] == "t7portfolio":
            raise ValueError("never")
        return [[float(len(t))] for t in batch]

    def asked():
        out = sorted(t for f in seen.iterdir() for t in f.read_text().split("\n"))
        for f in seen.iterdir():
            f.unlink()
        return out

    every = sorted(r.text for r in texts.collect())
    store = embedding_run.open_store(spark, f"{tmp_path}/s", 12)
    first = embedding_run.run(texts, store, "m", embed, 30, most_chunks=2)
    one = asked()
    assert first.chunks == 2 and 0 < len(one) < 120 and store.read().count() == first.embedded

    part = store.version().number
    with pytest.raises(Exception):  # noqa: B017, PT011 - a job that is lost within a chunk
        embedding_run.run(texts, store, "m", lambda b: (_ for _ in ()).throw(KeyboardInterrupt()), 30)
    assert store.version().number == part
    rest = embedding_run.run(texts, store, "m", embed, 30)
    two = asked()
    assert sorted(set(one + two)) == every and not set(one) & set(two) - {"t7portfolio"} and rest.failed + first.failed >= 1
    assert {(r.investor_id, r.namespace): r.vector for r in store.read().collect()} == {(str(i), ns): [float(len(f"t{i}{ns}"))] for i in range(60) for ns in ("portfolio", "activity") if (i, ns) != (7, "portfolio")}
    # nothing is left but the text that fails; another model begins anew
    last = embedding_run.run(texts, store, "m", embed)
    assert set(asked()) == {"t7portfolio"} and last.embedded == 0 and last.failed == 1 and last.fully_cached == 59
    assert embedding_run.run(texts, store, "n", embed).embedded == 119
