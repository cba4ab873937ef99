"""Dossiers of several runs: prompts within their limit, no document lost, merged in rounds."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import rows_of

from tallyforge.operators import dossier
from tallyforge.plans import catalogue

KIND = "run string, doc_id string, file_name string, doc_fields map<string,struct<value:string,answer:string>>"


def rows(seed=1):
    r = random.Random(seed)
    out = []
    for run, n in (("hot", 300), ("one", 1), ("few", 4), ("empty fields", 2)):
        for i in range(n):
            fields = {f"field {j}": (f"value {run} {i} {j} " + "x" * r.choice([0, 5, 200, 3_000]), "a") for j in range(r.choice([0, 1, 3, 8]))} if run != "empty fields" else {"f": (None, "a")}
            out.append((run, f"doc_{i:03d}", f"{run}-{i}.pdf" * r.choice([1, 30]), fields))
    return out


@pytest.mark.parametrize("most", [3_000, 20_000, 5_000_000])
def test_each_prompt_is_under_its_limit_and_no_document_is_lost(spark, most):
    docs = rows()
    df = spark.createDataFrame(docs, KIND)
    got = dossier.merge_parts(df, "run", most, ("a", "b")).collect()
    head = dossier._merge_head(("a", "b"))
    assert all(len(p.prompt) <= most and p.prompt.startswith(head) for p in got)
    for run in {d[0] for d in docs}:
        own = sorted((p for p in got if p.run == run), key=lambda p: p.part)
        assert [p.part for p in own] == list(range(len(own))) and {p.n_parts for p in own} == {len(own)}
        assert {d for p in own for d in p.doc_ids} == {d[1] for d in docs if d[0] == run}
        text = "\n".join(p.prompt for p in own)
        room = (most - len(head) - 2) // 2 - 130
        for _, _, _, fields in (d for d in docs if d[0] == run):
            for name, (value, _) in fields.items():
                if value is not None:
                    # a line is there once, whole up to the room of a block
                    line = f"  {name}: {value}"[:room]
                    assert text.count(line.split(" x")[0] if len(line) < room else line) >= 1
    if most == 5_000_000:
        assert len(got) == 4


def test_rounds_end_with_one_part(spark):
    """Answers of parts are documents of the next round."""
    docs = spark.createDataFrame(rows(3), KIND)
    for _ in range(8):
        parts = dossier.merge_parts(docs, "run", 8_000, ("a",)).collect()
        if all(p.n_parts == 1 for p in parts):
            break
        answers = [(p.run, f"part_{p.part:04d}", f"part {p.part}", {"a": (f"merged {len(p.doc_ids)}", "")}) for p in parts]
        docs = spark.createDataFrame(answers, KIND)
    assert {p.run for p in parts} == {"hot", "one", "few", "empty fields"} and len(parts) == 4


def test_dossiers_of_runs(spark):
    docs = spark.createDataFrame([(r, f"d{i}", f"f{i}", "Unknown", "s", "l") for i, r in enumerate("aabc")], "run string, doc_id string, file_name string, document_category string, short_summary string, long_summary string")
    answers = spark.createDataFrame([("a", '{"short_summary": "A", "final_fields": {"x": {"value": "1", "answer": ""}}}', None), ("b", "", "timeout")], "run string, answer string, error string")
    got = {r.run: r for r in dossier.merged_dossier(docs, answers, ("x", "y"), run="run").collect()}
    assert got["a"].n_documents == 2 and got["a"].final_fields["x"].value == "1" and got["a"].n_fields == 1
    assert got["b"].short_summary == "Merge failed: timeout" and got["c"].short_summary.startswith("Merge failed") and got["c"].n_fields == 0
    with pytest.raises(ValueError, match="no room"):
        dossier.merge_parts(docs, "run", 300)


@pytest.mark.parametrize("name", ["dossiers_by_run", "extracted_fields", "extraction_prompts"])
def test_a_run_of_more_than_999_documents_equals_sql(spark, tmp_path, name):
    """Numbers of four digits stay whole in doc_ids."""
    rows = spark.range(1_103).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a text").alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert rows_of(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(duck.execute(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("most", [700, 3_000, 100_000])
def test_parts_have_the_whole_of_long_lines_and_names(spark, most):
    """Also of a document without a file name, and one without a run."""
    long = "".join(f"{i:05d}" for i in range(4_000))
    docs = [("a", "d1", "one.pdf", {"f": (long, "")}), ("a", "d2", "n" * 150 + long[:3_000] + ".pdf", {"g": ("short", "")}), (None, "d3", None, {"f": (long, ""), "g": ("last", "")})]
    parts = dossier.merge_parts(spark.createDataFrame(docs, KIND), "run", most, ("a",)).collect()
    assert all(len(p.prompt) <= most for p in parts) and {p.run for p in parts} == {"a", None}
    head = dossier._merge_head(("a",))
    room = (most - len(head) - 2) // 2 - 130
    for run, doc, name, fields in docs:
        title = f"Document: {name[:100]}\nFields:\n" if name else "Fields:\n"
        lines = ([f"  Document: {name}"] if name and len(name) > 100 else []) + [f"  {k}: {v}" for k, (v, _) in fields.items()]
        want = [""]
        for piece in [line[i : i + room] for line in lines for i in range(0, len(line), room)]:
            if want[-1] and len(want[-1]) + 1 + len(piece) > room:
                want.append(piece)
            else:
                want[-1] += ("\n" if want[-1] else "") + piece
        found = [b for p in parts if p.run == run and doc in p.doc_ids for b in p.prompt[len(head) + 1 :].split("\n\n")]
        assert sorted(b[len(title) :] for b in found if b.startswith(title)) == sorted(want)


def test_the_prompt_of_a_run_of_any_length_has_its_digest(spark):
    docs = [d for d in rows(5)] + [(None, "d", "no run.pdf", {"f": ("v", "")})]
    got = {r.run: r.prompt_md5 for r in dossier.merge_prompt_md5(spark.createDataFrame(docs, KIND), "run", ("a", "b")).collect()}
    for run in {d[0] for d in docs}:
        [whole] = dossier.merge_prompt(spark.createDataFrame([d for d in docs if d[0] == run], KIND), ("a", "b")).collect()
        assert got.pop(run) == hashlib.md5(whole.prompt.encode()).hexdigest()
    assert not got and dossier.merge_prompt_md5(spark.createDataFrame([], KIND), "run").count() == 0


def test_a_run_of_more_than_five_million_letters_has_its_dossier(spark, tmp_path):
    """One run of 130,000 documents: its prompt is whole, whatever a model would take."""
    rows = spark.range(130_000).select((F.col("id") * 7).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a text").alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = rows_of(catalogue.QUERIES["dossiers_by_run"](spark, str(tmp_path)).toPandas())
    assert len(got[1]) == 1 and got == rows_of(duck.execute(catalogue.ORACLE_SQL["dossiers_by_run"]).df())
