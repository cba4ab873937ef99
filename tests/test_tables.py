"""Sources, writers, dedupe, staleness, dossier relations and streaming forms."""

from __future__ import annotations

import json

import duckdb
from pyspark.sql import functions as F
from test_oracle import rows_of

from tallyforge.functions.fixed import REPORT_COLUMNS
from tallyforge.operators import dossier, tables, vectors
from tallyforge.plans import catalogue
from tallyforge.sources import readers, writers


def test_investor_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source": "one", "investors": [{"investor_id": "x", "full_name": "X", "firm": "F", "extra": 1}, {"investor_id": "", "full_name": "blank"}, {"investor_id": "", "full_name": "blank2"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"source": "two", "investors": [{"investor_id": "x", "full_name": "X again", "fund": {"status": "closed", "check_size_min": 5}}]}))
    (tmp_path / "c.json").write_text(json.dumps({"other": []}))
    rows = {r.full_name: r for r in readers.read_investors(spark, f"{tmp_path}/*.json").collect()}
    assert {n: r.investor_id for n, r in rows.items()} == {"X": "x", "X again": "x__dup2", "blank": "", "blank2": ""}
    assert rows["X"].fund.status == "active" and rows["X"].fund.check_size_max == 2_000_000 and rows["X"].fund.geography == ["United States"] and rows["X"].source_tags == ["one"] and rows["X"].data_quality_confidence == 0.5
    assert rows["X again"].fund.status == "closed" and rows["X again"].fund.check_size_min == 5


def test_signal_files_reach_all_rows_of_an_id(spark, tmp_path):
    inv, sig = tmp_path / "inv", tmp_path / "sig"
    inv.mkdir(), sig.mkdir()
    (inv / "a.json").write_text(json.dumps({"source": "s", "investors": [{"investor_id": "x"}, {"investor_id": "x"}, {"investor_id": "y"}]}))
    (sig / "x.json").write_text(json.dumps({"investor_id": "x", "signals": [{"source_type": "news", "text": "t", "unknown": 1}]}))
    (sig / "y.json").write_text(json.dumps([{"source_type": "bare", "text": "u"}]))
    rows = readers.attach_signals(readers.read_investors(spark, f"{inv}/*.json"), readers.read_signals(spark, f"{sig}/*.json"))
    assert {r.investor_id: [s.source_type for s in r.signals] for r in rows.collect()} == {"x": ["news"], "x__dup2": ["news"], "y": ["bare"]}


def test_deal_needs_its_fields(spark, tmp_path):
    good = {n: "v" for n in readers.DEAL_REQUIRED} | {"raise_amount": 1.0}
    (tmp_path / "d.json").write_text(json.dumps(good))
    assert readers.read_deals(spark, f"{tmp_path}/d.json").count() == 1
    (tmp_path / "e.json").write_text(json.dumps({k: v for k, v in good.items() if k != "industry"}))
    try:
        readers.read_deals(spark, f"{tmp_path}/e.json").collect()
        raise AssertionError("a missing field passed")
    except Exception as e:
        assert "missing required field industry" in str(e)


def test_people_snapshot(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"people": [{"name": "A", "firm": "B", "other": 1}]}))
    (tmp_path / "2.json").write_text(json.dumps([{"name": "C"}]))
    spark.dataSource.register(readers.PeopleSnapshot)
    got = spark.read.format("people_snapshot").option("path", f"file://{tmp_path}").load()
    assert sorted((r.name, r.firm) for r in got.collect()) == [("A", "B"), ("C", "")]


def test_json_with_a_default(spark, tmp_path):
    at = f"{tmp_path}/m.json"
    assert readers.read_json(spark, at, "a int, b string").count() == 0
    assert [tuple(r) for r in readers.read_json(spark, at, "a int, b string", [(1, "d")]).collect()] == [(1, "d")]
    (tmp_path / "m.json").write_text('[{"a": 2,\n "b": "x"}, {"a": 3}]')
    assert sorted(r.a for r in readers.read_json(spark, at, "a int, b string", [(1, "d")]).collect()) == [2, 3]


def test_sheet(spark):
    rows = spark.createDataFrame([(0, "Acme", "nan"), (1, " ", "x"), (2, "acme", "y"), (3, "Beta", "z")], "pos int, `Investors` string, `Note` string")
    got = readers.clean_sheet(rows, {"Investors": "name", "Note": "note"}, most=5).collect()
    assert [(r.name, r.note) for r in got] == [("Acme", ""), ("acme", "y"), ("Beta", "z")]  # names in other letters are others


def test_writers(spark, tmp_path, sf):
    from tallyforge.plans.signals import signal_report

    writers.write_report(signal_report(spark, sf), f"{tmp_path}/report")
    assert tuple(spark.read.option("header", True).csv(f"{tmp_path}/report").columns) == REPORT_COLUMNS
    v = spark.createDataFrame([("n", "a", [1.0]), ("n", "b", [2.0])], "namespace string, record_id string, vector array<float>")
    writers.write_vectors(v, f"{tmp_path}/v1")
    writers.upsert_vectors(spark.read.parquet(f"{tmp_path}/v1"), spark.createDataFrame([("n", "b", [3.0]), ("m", "c", [4.0])], v.schema), f"{tmp_path}/v2")
    assert {(r.namespace, r.record_id): r.vector[0] for r in spark.read.parquet(f"{tmp_path}/v2").collect()} == {("n", "a"): 1.0, ("n", "b"): 3.0, ("m", "c"): 4.0}
    writers.write_summary(v.agg(F.count("*").alias("n")), f"{tmp_path}/s")
    assert json.loads(spark.read.text(f"{tmp_path}/s").first().value) == {"n": 2}
    writers.write_sheets({"vectors": v}, f"{tmp_path}/sheets")
    writers.write_lines(v, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").count() == 2


def test_metadata_filter(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z"]), (3, None, None)], "i int, kind string, tags array<string>")
    pick = lambda c: [r.i for r in rows.filter(vectors.metadata_matches(c, {"tags"})).orderBy("i").collect()]
    assert pick({"kind": "a"}) == [1] and pick({"kind": ["a", "b"], "tags": ["z", "q"]}) == [2] and pick({}) == [1, 2, 3]


def test_stale_reasons(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id int, text string")
    import hashlib

    cache = spark.createDataFrame([(1, hashlib.md5(b"a").hexdigest()), (2, ""), (3, "other")], "id int, old_hash string")
    assert {r.id: r.reason for r in tables.staleness(texts, cache, ["id"]).collect()} == {1: "up_to_date", 2: "v1_no_hash", 3: "text_changed", 4: "missing_vector"}
    assert {r.reason for r in tables.staleness(texts, cache, ["id"], force=True).collect()} == {"force"}


def test_feed_keeps_header_of_discarded_documents(spark):
    items = spark.createDataFrame([("d1", 1, "b", "keep"), ("d1", 0, "a", "keep"), ("d2", 0, "c", "discard")], "doc string, o int, text string, status string")
    got = {r.doc: r.feed for r in dossier.feed(items, "doc", "o", F.col("text"), F.col("status") != "discard").collect()}
    assert got == {"d1": "# Document: d1\na\nb", "d2": "# Document: d2"}
    parts = dossier.split_feed(spark.createDataFrame([("# Document: d1\na\nb\n# Document: d2\n",)], "t string"), "t").collect()
    assert [(r.name, r.body.strip()) for r in parts] == [("d1", "a\nb"), ("d2", "d2")]  # an empty body is the part itself


def test_whole_texts_are_split(spark, tmp_path):
    from tallyforge.plans import catalogue

    rows = [(1, 0, "system", "left out"), (1, 1, "user", "two\n\nlines "), (1, 2, "assistant", "see\n# Document: other\nits text"), (2, 0, "system", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.name, r.body.strip()) for r in catalogue.QUERIES["doc_split_texts"](spark, str(tmp_path)).collect()}
    assert got == {("1", "[1] user: two\n\nlines \n[2] assistant: see"), ("other", "its text"), ("2", "2")}


def test_windows_match_batch(spark, sf, tmp_path):
    from tallyforge.streaming.recency import windowed_counts

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.start, r.event_type, r.n) for r in spark.table("w").collect()) == sorted((r.start, r.event_type, r.n) for r in windowed_counts(events).collect())


def test_last_seen_and_refresh(spark, sf, tmp_path):
    from tallyforge.streaming.recency import last_seen, refresh_cache

    events = spark.read.parquet(f"{sf}/events.parquet").limit(200)
    events.write.parquet(f"{tmp_path}/in")
    q = last_seen(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.user_id: r.n for r in spark.read.parquet(f"{tmp_path}/in").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert {r.user_id: r.n for r in spark.table("seen").collect()} == want
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    texts.write.parquet(f"{tmp_path}/texts")
    cache = spark.createDataFrame([(1, "0cc175b9c0f1b6a831c399e269772661")], "id int, old_hash string")
    q = refresh_cache(spark.readStream.schema(texts.schema).parquet(f"{tmp_path}/texts"), lambda: cache, lambda df: df.write.mode("append").parquet(f"{tmp_path}/out"), ["id"], f"{tmp_path}/c2")
    q.awaitTermination(120)
    assert [(r.id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(2, "missing_vector")]


def test_hash_embedding_equals_plain(spark):
    import hashlib
    import math
    import re

    texts = ["AI tools, ai C++ x", "", None, "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: list(r.embedding) for r in vectors.dense(vectors.hash_embedding(rows)).collect()}
    for i, t in enumerate(texts):
        v = [0.0] * 96
        for tok in re.findall(r"[a-zA-Z0-9_#+.-]+", (t or "").lower()):
            h = hashlib.sha256(tok.encode()).hexdigest()
            v[int(h[:8], 16) % 96] += (-1.0 if int(h[8:10], 16) % 2 else 1.0) * (1.0 + len(tok) / 20)
        n = math.sqrt(sum(x * x for x in v))
        assert (i in got) == (n > 0) and (n == 0 or max(abs(a - b / n) for a, b in zip(got[i], v, strict=True)) < 1e-5)


def test_halves_of_hashed_vectors_go_away_from_zero(spark, tmp_path):
    """In these two deals' profiles some cells are whole millionths and a half. The second's squares have no exact sum in floating
    point, so SQL rounds it by the order of its rows: here its exact cells are stated."""
    rows = spark.createDataFrame([(77933, 375904.68), (39648, 152421.53)], "o_orderkey long, o_totalprice double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet' WHERE o_orderkey = 77933")
    got = catalogue.QUERIES["profile_artifacts"](spark, str(tmp_path)).toPandas()
    assert rows_of(got[got.deal_id == 77933]) == rows_of(duck.execute(catalogue.ORACLE_SQL["profile_artifacts"]).df())
    assert got[(got.deal_id == 39648) & (got.part == "raise_thesis")].cell_sum.tolist() == [29984422]


def test_a_worker_that_hashes_holds_batches_of_bounded_rows(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        vectors.hash_embedding(spark.createDataFrame([(1, "a")], "doc_id int, text string"))
        assert int(spark.conf.get(key)) == 1000
    finally:
        spark.conf.set(key, before)
