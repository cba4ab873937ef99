"""Hot classes, sites and lengths are dealt over parts; ids and names of other kinds pass."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, mixing, near_dup, piece_sampling, quality, quote_threads, token_counts, vector_search

public_tokenizers = pytest.importorskip("public_tokenizers")


def parts_of(frame):
    """The rows of each partition of a frame."""
    return sorted(r.n for r in frame.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


def test_copies_of_one_text_are_dealt(spark, monkeypatch):
    """5,000 copies of one text among 500 others: no task gets them all, and the result is the same."""
    monkeypatch.setattr(common, "HOT_ROWS", 25)
    r = random.Random(4)
    copy = " ".join(f"c{i}" for i in range(30))
    rows = [(i, copy) for i in range(5_000)] + [(10_000 + i, " ".join(f"w{r.randrange(5_000)}" for _ in range(30))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert Counter((x.component_id == 0, x.kept) for x in got) == {(True, True): 1, (True, False): 4_999, (False, True): 500}
    sketched, members = near_dup.linked_components(df)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = parts_of(near_dup._of_classes(sketched, members))
    finally:
        for key in ("shuffle.partitions", "adaptive.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 5_500 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert near_dup.keep_one(df.withColumn("lang", F.lit("en"))).count() == 501


def test_sites_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    """One site of four fifths of all rows, rows without host or path, and many paths of one host."""
    r = random.Random(6)
    rows = [(i, "hot" if i % 5 else r.choice(["a", "b", None]), r.choice(["p", None]) if i % 7 else f"path {i}", r.gauss(0, 2)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, _host string, _path string, _evidence double")

    def scores():
        sites, mean, paths = quality.site_posteriors(df)
        return {x.doc_id: (round(x.host_posterior, 9), round(x.path_posterior, 9), round(x._score, 9)) for x in quality._scored(df, sites, mean, paths).collect()}

    want = scores()
    monkeypatch.setattr(quality, "BROADCAST_PATHS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    assert scores() == want and len(want) == 3_000


def test_many_lengths_of_vectors_give_the_same(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(r.choice([3, 8, 8, 8, 8]))]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = Counter(tuple(x) for x in vector_search.top_k(df, k=5).collect())
    monkeypatch.setattr(vector_search, "BROADCAST_DIMS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert Counter(tuple(x) for x in vector_search.top_k(df, k=5).collect()) == want


def test_conversations_named_by_texts(spark):
    rows = [("a/1", "0", "user", "What is the boiling point of water at sea level?"), ("a/1", "1", "assistant", "It is 100 degrees."), ("a/1", "2", "user", "> What is the boiling point of water at sea level?\nAnd of tea?"), ("b", None, "user", "x"), (None, "1", "user", "y"), ("b", "no turn", "user", "z")]
    got = {(x.conv_id, x.turn, x.content.strip()): (x.reply_to, x.n_linked) for x in quote_threads.link_quotes(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")).collect()}
    assert got[("a/1", 2, "And of tea?")] == (0, 1) and got[("a/1", 1, "It is 100 degrees.")] == (0, 0) and len(got) == 6
    whole = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "conv_id int, turn int, role string, text string")
    assert dict(quote_threads.link_quotes(whole).dtypes)["conv_id"] == "bigint"


def test_decoding_keeps_names_that_need_quotes(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, "two words", 5, 6, 7)], "doc_id long, text string, `a.b` int, `c0` int, `Decoded` int")
    coded = piece_sampling.encode_best(rows, path).join(rows.drop("text"), "doc_id")
    got = piece_sampling.decode_ids(coded, path)
    assert got.columns == [*coded.columns, "text"] and [(r["a.b"], r.c0, r.Decoded, r.text) for r in got.collect()] == [(5, 6, 7, "two words")]


def test_ids_draw_apart():
    ids = [-2, -1, 0, 1, 2**61 - 2, 2**61 - 1, 2**62, -(2**63), 2**63 - 1, None, "a", "b"]
    assert len({mixing.hash_id(i, 3) for i in ids}) == len(ids)


def test_long_pre_tokens_are_counted_and_not_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = token_counts.PreTokenCounter(path, token_counts.whole_tokens(path))
    texts = ["x" * 5_000 + " short", "é" * 100, "y " + "x" * 5_000]
    want = [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want and counter.count(texts) == want
    assert max(map(len, set(counter.memo) - set(counter.whole)), default=0) <= token_counts.MEMO_LENGTH
