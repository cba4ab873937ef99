"""Dossier relations: layout items, feed, neighbours, document split, table cleaning, visuals, field extraction, phases.

Answers of language and vision models come in as tables of text; nothing here calls a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallyforge.functions.fixed import DOSSIER_FIELDS
from tallyforge.functions.layout import json_in_text, table_markdown
from tallyforge.functions.text import bound, safe_text, strings
from tallyforge.operators.vectors import _modest

TEXT_KINDS = ("user", "assistant")


def default_status(kind: Column, skim: Column) -> Column:
    return F.when((kind == "picture") & skim.isin("likely_empty", "likely_decorative"), "needs_review").when(kind == "table", "needs_correction").otherwise("keep")


def nearby(items: DataFrame, doc: str, order: str, kind: str, kinds: tuple[str, ...], reach: int = 3, most: int = 3000) -> DataFrame:
    """items with nearby_text: texts of the given kinds within so many rows on either side, in order."""
    w = W.Window.partitionBy(doc).orderBy(order).rowsBetween(-reach, reach)
    return items.withColumn("nearby_text", F.substring(F.array_join(F.collect_list(F.when(F.col(kind).isin(*kinds), F.col("text"))).over(w), "\n"), 1, most))


def feed(items: DataFrame, doc: str, order: str, line: Column, keep: Column) -> DataFrame:
    """One feed for each document: a header, and the lines of the items that are kept, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(order).alias("o"), line.alias("l"))))), lambda x: x.l)
    body = items.groupBy(doc).agg(lines.alias("lines"))
    return body.select(doc, F.array_join(F.concat(F.array(F.concat(F.lit("# Document: "), F.col(doc).cast("string"))), F.col("lines")), "\n").alias("feed"))


def split_feed(feeds: DataFrame, column: str) -> DataFrame:
    """feeds with part (from 0), name and body of each document of a feed text; a body that is empty is the part itself."""
    parts = feeds.select("*", F.posexplode(F.split(column, "# Document:")).alias("_i", "_t")).withColumn("_t", F.regexp_replace("_t", r"^\s+|\s+$", "")).filter("_t <> ''")
    name = F.trim(F.substring_index("_t", "\n", 1))
    rest = F.regexp_replace(F.substr("_t", F.length(F.substring_index("_t", "\n", 1)) + 1), r"^\s+|\s+$", "")
    return parts.select(*feeds.columns, F.col("_i").alias("part"), name.alias("name"), F.when(rest == "", F.col("_t")).otherwise(rest).alias("body")).drop(column)


def numbered_items(items: DataFrame, doc: str, order: str, kind: Column, skim: Column) -> DataFrame:
    """items with kind, item_id, their status, and the ids of tables and pictures, counted within each document."""
    w = W.Window.partitionBy(doc).orderBy(order)
    rows = items.withColumns({"kind": kind, "_skim": skim}).withColumn("reading_order", F.row_number().over(w))

    def counted(which: str, label: str) -> Column:
        n = F.count_if(F.col("kind") == which).over(w.rowsBetween(W.Window.unboundedPreceding, 0))
        return F.when(F.col("kind") == which, F.concat(F.col(doc).cast("string"), F.lit(f"_{label}_"), F.lpad(n.cast("string"), 3, "0")))

    item_id = F.concat(F.col(doc).cast("string"), F.lit("_item_"), F.lpad(F.col("reading_order").cast("string"), 4, "0"))
    return rows.withColumns({"item_id": item_id, "table_id": counted("table", "table"), "visual_id": counted("picture", "visual"), "human_status": default_status(F.col("kind"), F.col("_skim"))}).drop("_skim")


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: later ones win."""
    w = W.Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def whole_feed(items: DataFrame, cleaned: DataFrame, raw: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, feed: the text of each document for a model, from its items and three tables by item_id (the last row wins).

    items: doc_id, file_name, reading_order, item_id, kind, human_status, text, human_note. cleaned: item_id, table_id,
    caption, columns, rows (maps), pos. raw: item_id, table_id, raw_markdown, pos. summaries: item_id, visual_id, visual_type,
    summary, visible_text, pos. Discarded items are left out, a document's heading is not.
    """
    c = _latest(cleaned, "item_id", "pos").select("item_id", F.struct("table_id", "caption", "columns", "rows").alias("c"))
    r = _latest(raw, "item_id", "pos").select("item_id", F.struct("table_id", "raw_markdown").alias("r"))
    v = _latest(summaries, "item_id", "pos").select("item_id", F.struct("visual_id", "visual_type", "summary", "visible_text").alias("v"))
    full = items.join(c, "item_id", "left").join(r, "item_id", "left").join(v, "item_id", "left")
    text, note = safe_text(F.col("text")), safe_text(F.col("human_note"))

    def put(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def said(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit("None"))

    clean = F.array(put("\n### Cleaned Table: ", said(F.col("c.table_id")), "\n"), F.when(F.coalesce("c.caption", F.lit("")) != "", put("Caption: ", F.col("c.caption"), "\n")), table_markdown(F.col("c.columns"), F.col("c.rows")))
    plain = F.array(put("\n### Raw Docling Table: ", F.coalesce("r.table_id", "item_id"), "\n"), F.when(safe_text(F.col("r.raw_markdown")) != "", safe_text(F.col("r.raw_markdown"))).otherwise("(No raw table text available.)"))
    seen = F.array(
        put("\n### Visual Summary: ", said(F.col("v.visual_id")), "\n"), put("Type: ", said(F.col("v.visual_type")), "\n"), put("Summary: ", said(F.col("v.summary")), "\n"),
        F.when(F.size(F.coalesce("v.visible_text", F.array().cast("array<string>"))) > 0, put("Visible text: ", F.array_join("v.visible_text", "; "))),
    )
    kind = F.col("kind")
    lines = (
        F.when(F.coalesce("human_status", F.lit("keep")) == "discard", F.array().cast("array<string>"))
        .when((kind == "section_header") & (text != ""), F.array(put("\n## ", text, "\n")))
        .when((kind == "list_item") & (text != ""), F.array(put("- ", text)))
        .when((kind == "text") & (text != ""), F.array(text))
        .when((kind == "table") & F.col("c").isNotNull(), clean)
        .when(kind == "table", plain)
        .when((kind == "picture") & F.col("v").isNotNull(), seen)
        .when((kind == "picture") & (note != ""), F.array(put("\n### Visual Reviewer Note\n", note, "\n")))
        .otherwise(F.array().cast("array<string>"))
    )
    rows = full.select("doc_id", "file_name", "reading_order", F.filter(lines, lambda x: F.coalesce(F.trim(F.translate(x, "\n\t", "  ")), F.lit("")) != "").alias("lines"))
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "lines"))), lambda x: x.lines))
    # the heading names the file of the document's first item
    first = F.min_by("file_name", "reading_order")
    return rows.groupBy("doc_id").agg(F.array_join(F.concat(F.array(put("\n# Document: ", said(first), "\n")), body), "\n\n").alias("feed"))


def run_feed(feeds: DataFrame) -> DataFrame:
    """One row: the feeds of a run's documents, in order."""
    return feeds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "feed"))), lambda x: x.feed), "\n\n").alias("feed"))


def tables_text(cleaned: DataFrame, key: str, order: str) -> DataFrame:
    """key, markdown: the cleaned tables of each key as sections."""
    block = F.concat(F.lit("## "), F.coalesce(F.col("table_id").cast("string"), F.lit("None")), F.lit("\n\n"), F.coalesce("caption", F.lit("")), F.lit("\n\n"), table_markdown(F.col("columns"), F.col("rows"), "(No rows extracted.)"), F.lit("\n"))
    return cleaned.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x.b), "\n\n").alias("markdown"))


FALLBACK = "Fallback used because LLM correction did not run or failed."


def corrected_tables(raw: DataFrame, answers: DataFrame | None = None, wanted: list[str] | None = None) -> DataFrame:
    """table_id, caption, columns, rows, issues of raw tables (table_id, columns, rows, ...), from a model's answers.

    answers: table_id, answer (JSON text; null: no answer), error (null: none). Without answers, and where one has no columns
    or no rows, the raw table stands, with an issue that says so.
    """
    rows = raw if wanted is None else raw.filter(F.col("table_id").isin(wanted))
    keys = F.when(F.size(F.coalesce("columns", F.array().cast("array<string>"))) > 0, F.col("columns")).otherwise(F.coalesce(F.map_keys(F.get("rows", F.lit(0))), F.array().cast("array<string>")))
    kept = F.coalesce("rows", F.array().cast("array<map<string,string>>"))
    rest = [c for c in raw.columns if c not in ("table_id", "columns", "rows")]
    if answers is None:
        return rows.select("table_id", *rest, F.lit("").alias("caption"), keys.alias("columns"), kept.alias("rows"), F.array(F.lit(FALLBACK)).alias("issues"))
    found = rows.join(answers.select("table_id", "answer", "error"), "table_id", "left").withColumn("_a", F.from_json(json_in_text(F.coalesce("answer", F.lit(""))), "caption string, columns array<string>, rows array<map<string,string>>, issues array<string>"))
    failed = F.col("error").isNotNull()
    good = ~failed & (F.size(F.coalesce("_a.columns", F.array().cast("array<string>"))) > 0) & F.col("_a.rows").isNotNull()
    why = F.when(failed, F.concat(F.lit("LLM correction failed: "), "error")).otherwise("LLM output had missing columns/rows, fallback used.")
    return found.select(
        "table_id", *rest, F.when(good, safe_text(F.col("_a.caption"))).otherwise("").alias("caption"), F.when(good, F.col("_a.columns")).otherwise(keys).alias("columns"), F.when(good, F.col("_a.rows")).otherwise(kept).alias("rows"),
        F.when(good, F.coalesce("_a.issues", F.array().cast("array<string>"))).otherwise(F.array(F.lit(FALLBACK), why)).alias("issues"),
    )


def noted_visuals(visuals: DataFrame, updates: DataFrame) -> DataFrame:
    """visuals with the status and note of their updates (visual_id, human_status, human_note; nulls change nothing)."""
    u = updates.select("visual_id", F.col("human_status").alias("_s"), F.col("human_note").alias("_n"))
    own = {"human_status": F.coalesce("_s", "human_status"), "human_note": F.coalesce("_n", "human_note")}
    return visuals.join(u, "visual_id", "left").select(*[own[c].alias(c) if c in own else F.col(c) for c in visuals.columns])


def summarised_visuals(visuals: DataFrame, answers: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """visual_id, item_id, visual_type, summary, visible_text, importance, issues of the visuals that are kept or to be reviewed.

    answers: visual_id, answer (JSON text), error. A visual without a crop, and one whose answer failed, says so.
    """
    rows = visuals.filter(F.col("human_status").isin("keep", "needs_review"))
    rows = rows if wanted is None else rows.filter(F.col("visual_id").isin(wanted))
    found = rows.join(answers.select("visual_id", "answer", "error"), "visual_id", "left").withColumn("_a", F.from_json(json_in_text(F.coalesce("answer", F.lit(""))), "visual_type string, summary string, visible_text array<string>, importance string, issues array<string>"))
    bare, bad = F.col("crop_path").isNull(), F.col("error").isNotNull() | F.col("_a").isNull()
    none = F.array().cast("array<string>")

    def field(name: str, missing: Column | str) -> Column:
        return F.when(bare | bad, missing).otherwise(F.coalesce(f"_a.{name}", missing if isinstance(missing, Column) else F.lit(missing))).alias(name)

    summary = F.when(bare, "No crop image was available for VLM analysis.").when(bad, "VLM analysis failed.").otherwise(F.coalesce("_a.summary", F.lit("")))
    issues = F.when(bare, F.array(F.lit("Missing crop path."))).when(bad, F.array(F.coalesce("error", F.lit("VLM returned non-object JSON")))).otherwise(F.coalesce("_a.issues", none))
    return found.select("visual_id", "item_id", field("visual_type", "unknown"), summary.alias("summary"), field("visible_text", none), field("importance", "unclear"), issues.alias("issues"))


# ---- extraction ------------------------------------------------------------------------

NOT_FOUND = "Not found in any document."
FIELD = "struct<value:string,answer:string,evidence_quote:string>"


def extracted(docs: DataFrame, manifest: DataFrame, answers: DataFrame, names: tuple[str, ...] = DOSSIER_FIELDS) -> DataFrame:
    """One row a document of a feed: doc_id (doc_001, ...), file_name, category, summaries, and a struct for each field.

    docs: part (from 0), name. manifest: part, file_name. answers: part, answer (JSON text), error. A field that is no object
    is its own value. A document without a good answer has the category Unknown and says why.
    """
    rows = docs.join(manifest.select("part", F.col("file_name").alias("_file")), "part", "left").join(answers.select("part", "answer", "error"), "part", "left")
    json = json_in_text(F.coalesce("answer", F.lit("")))
    # three digits or more: a longer number stays whole
    number = (F.col("part") + 1).cast("string")
    rows = rows.withColumns({"_j": json, "file_name": F.coalesce("_file", "name"), "doc_id": F.concat(F.lit("doc_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))})
    good = F.col("error").isNull() & F.coalesce(F.ltrim("_j").startswith("{"), F.lit(False))
    why = F.concat(F.lit("Extraction failed: "), F.coalesce("error", F.lit("LLM returned non-object JSON")))
    # parsed once for all names
    rows = rows.withColumn("_f", F.when(good, F.from_json(F.get_json_object("_j", "$.fields"), "map<string,string>")))

    def one(name: Column) -> Column:
        def made(raw: Column) -> Column:
            is_object = F.coalesce(F.ltrim(raw).startswith("{"), F.lit(False))

            def field(x: Column) -> Column:
                quote = F.when(is_object, F.coalesce(x.evidence_quote, F.lit(""))).otherwise("")
                evidence = F.when(quote != "", F.array(F.struct(F.col("doc_id"), F.col("file_name"), quote.alias("quote")))).otherwise(F.array().cast("array<struct<doc_id:string,file_name:string,quote:string>>"))
                return F.struct(F.when(is_object, x.value).otherwise(raw).alias("value"), F.when(is_object, F.coalesce(x.answer, F.lit(""))).otherwise("").alias("answer"), evidence.alias("evidence"))

            return bound(F.from_json(raw, FIELD), field)

        return bound(F.try_element_at("_f", name), made)

    every = strings(names)
    def said(name: str, missing: str, failed: Column | str) -> Column:
        return F.when(good, F.coalesce(F.get_json_object("_j", f"$.{name}"), F.lit(missing))).otherwise(failed).alias(name)

    return rows.select(
        "doc_id", "file_name", said("document_category", "Unknown", "Unknown"), said("short_summary", "", why), said("long_summary", "", ""), F.get_json_object("_j", "$.key_people").alias("key_people"),
        F.map_from_arrays(every, F.transform(every, one)).alias("doc_fields"),
    )


def merged_dossier(documents: DataFrame, answer: DataFrame, names: tuple[str, ...] = DOSSIER_FIELDS, run: str | None = None) -> DataFrame:
    """One row: the merged dossier. documents: of `extracted`. answer: one row (answer, error) of the model that merged them.
    run: a column of both that tells dossiers apart; then one row for each run (of documents), also without an answer.

    Each field is there, those that the answer lacks as not found; n_fields counts those with a value.
    """
    keys = [] if run is None else [run]
    listed = documents.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("doc_id", "file_name", "document_category", "short_summary", "long_summary"))).alias("documents"), F.count("*").alias("n_documents"))
    row = answer.select(*keys, json_in_text(F.coalesce("answer", F.lit(""))).alias("_j"), "error")
    # without runs, one row each
    both = listed.crossJoin(row.limit(1)) if run is None else listed.join(row, run, "left")
    good = F.col("error").isNull() & F.coalesce(F.ltrim("_j").startswith("{"), F.lit(False))
    both = both.withColumn("_f", F.when(good, F.from_json(F.get_json_object("_j", "$.final_fields"), "map<string,struct<value:string,answer:string>>")))
    missing = F.struct(F.lit(None).cast("string").alias("value"), F.lit(NOT_FOUND).alias("answer"))
    every = strings(names)
    fields = F.map_from_arrays(every, F.transform(every, lambda n: F.coalesce(F.try_element_at("_f", n), missing)))
    why = F.concat(F.lit("Merge failed: "), F.coalesce("error", F.lit("Merge returned non-object JSON")))
    out = both.select(
        *keys, F.when(good, F.coalesce(F.get_json_object("_j", "$.short_summary"), F.lit(""))).otherwise(why).alias("short_summary"), F.when(good, F.coalesce(F.get_json_object("_j", "$.long_summary"), F.lit(""))).otherwise("").alias("long_summary"),
        fields.alias("final_fields"), "documents", "n_documents",
    )
    return out.withColumn("n_fields", F.size(F.filter(F.map_values("final_fields"), lambda f: f.value.isNotNull())))


# ---- prompts ---------------------------------------------------------------------------


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def document_prompt(name: Column, text: Column, fields: dict[str, str], categories: tuple[str, ...], most: int = 30_000) -> Column:
    """What to ask a model about one document: its fields, category, summaries and people, as JSON."""
    return _lines(
        "Read the document below and answer with one JSON object and nothing else.", F.concat(F.lit("Document: "), name), "Keys: document_category (one of the categories), short_summary, long_summary, fields, key_people.",
        "fields maps each field name below to value, answer and evidence_quote (copied from the text); value is null where the text does not say.", "Fields:", *[f"- {n}: {d}" for n, d in fields.items()], "Categories:", *[f"- {c}" for c in categories],
        "Text:", F.substring(F.coalesce(text, F.lit("")), 1, most),
    )


def _merge_head(names: tuple[str, ...]) -> str:
    return "\n".join(["Merge the fields that were found in these documents into one JSON object with short_summary, long_summary and final_fields.", "final_fields maps each name to value, answer and evidence; null where no document says it; lists are joined without repeats.", "Names: " + ", ".join(names)])


def _found_lines() -> Column:
    """A line for each field of a document that has a value."""
    found = F.filter(F.map_entries("doc_fields"), lambda e: e.value.value.isNotNull())
    return F.transform(found, lambda e: F.concat(F.lit("  "), e.key, F.lit(": "), e.value.value))


def _merge_part() -> Column:
    return _lines(F.concat(F.lit("Document: "), "file_name"), "Fields:", F.array_join(_found_lines(), "\n"))


def merge_prompt(documents: DataFrame, names: tuple[str, ...] = DOSSIER_FIELDS) -> DataFrame:
    """One row: what to ask a model that merges the fields of `extracted` documents; only fields with a value are listed."""
    listed = documents.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", _merge_part().alias("p")))), lambda x: x.p), "\n\n").alias("body"))
    return listed.select(_lines(_merge_head(names), F.col("body")).alias("prompt"))


def merge_prompt_md5(documents: DataFrame, run: str, names: tuple[str, ...] = DOSSIER_FIELDS) -> DataFrame:
    """run, prompt_md5: the MD5 of `merge_prompt` for each run, of any number of documents and any length: a run's documents go
    by in order, and only the digest of those before is held."""
    head = (_merge_head(names) + "\n").encode()
    rows = _modest(documents).select(F.col(run).alias("run"), "doc_id", _merge_part().alias("p")).repartition("run").sortWithinPartitions("run", "doc_id", "p").select("run", "p")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, ended = None, None, []
        for batch in batches:
            for own, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or own != now:
                    if digest is not None:
                        ended.append((now, digest.hexdigest()))
                    now, digest = own, hashlib.md5(head, usedforsecurity=False)
                else:
                    digest.update(b"\n\n")
                digest.update(part.encode())
            kind = batch.schema.field(0).type
        if digest is not None:
            ended.append((now, digest.hexdigest()))
            yield pa.record_batch([pa.array([r for r, _ in ended], kind), pa.array([d for _, d in ended], pa.string())], ["run", "prompt_md5"])

    made = rows.mapInArrow(work, T.StructType([T.StructField("run", documents.schema[run].dataType), T.StructField("prompt_md5", T.StringType())]))
    return made.select(F.col("run").alias(run), "prompt_md5")


def _blocks(lines: Column, most: int) -> Column:
    """Lines put together, line by line, into blocks of at most `most` letters; a longer line goes on in the next blocks."""
    def split(line: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / most) - 1, F.lit(0)).cast("int"))
        return F.transform(places, lambda i: F.substr(line, i * most + 1, F.lit(most)))

    def add(state: Column, line: Column) -> Column:
        fits = (state.open == "") | (F.length(state.open) + 1 + F.length(line) <= most)
        return F.when(fits, F.struct(state.done.alias("done"), F.concat(state.open, F.when(state.open == "", "").otherwise("\n"), line).alias("open"))).otherwise(F.struct(F.concat(state.done, F.array(state.open)).alias("done"), line.alias("open")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(F.flatten(F.transform(lines, split)), start, add, lambda s: F.concat(s.done, F.array(s.open)))


def merge_parts(documents: DataFrame, run: str, most: int = 60_000, names: tuple[str, ...] = DOSSIER_FIELDS) -> DataFrame:
    """run, part (from 0), n_parts, doc_ids, prompt: what to ask a model that merges the documents of each run, in prompts of
    at most `most` letters. documents: run, doc_id, file_name, doc_fields.

    A run with one part is merged by it. The answers of several are documents of the next round: with doc_id and file_name
    of the part and the answer's fields as doc_fields they go through here again, until each run has one part.

    A document's lines go into blocks of half a prompt's room at most, blocks into shares by a hash, and each share, which
    is of bounded size, into parts in order; so no task has to hold all documents of a run. Nothing is cut: a line that is
    longer than a block goes on in the next, and a name of more than 100 letters, of which each block's title has the first
    100, stands whole in a line of its own.
    """
    head = _merge_head(names)
    room = most - len(head) - 2
    if room < 400:
        raise ValueError(f"a prompt of {most} letters has no room beside its {len(head)} letters of instructions")
    title = _lines(F.concat(F.lit("Document: "), F.substring("file_name", 1, 100)), "Fields:")
    named = F.when(F.length("file_name") > 100, F.array(F.concat(F.lit("  Document: "), "file_name"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(named, F.coalesce(_found_lines(), F.array().cast("array<string>")))
    block_room = room // 2 - 130
    blocks = documents.select(run, "doc_id", title.alias("title"), F.posexplode(_blocks(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(""))), block_room)).alias("block", "text"))
    blocks = blocks.select(run, "doc_id", "block", F.concat("title", F.lit("\n"), "text").alias("text")).withColumn("size", F.length("text") + 2)
    # a share has about sixteen prompts of text
    shares = F.ceil(F.sum("size") / (16 * room)).cast("int")
    total = blocks.groupBy(F.col(run).alias("_run")).agg(shares.alias("shares"))
    placed = blocks.join(total, F.col(run).eqNullSafe(F.col("_run"))).withColumn("share", F.pmod(F.xxhash64("doc_id", "block"), F.col("shares")).cast("int"))
    order = W.Window.partitionBy(run, "share").orderBy("doc_id", "block")
    # blocks are at most half a room, so those that begin in one stretch of half a room fill at most one room
    begins = F.coalesce(F.sum("size").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.withColumn("stretch", F.floor(begins / (room - room // 2)).cast("int")).groupBy(run, "share", "stretch").agg(F.array_sort(F.collect_list(F.struct("doc_id", "block", "text"))).alias("x"))
    numbered = parts.withColumn("part", (F.row_number().over(W.Window.partitionBy(run).orderBy("share", "stretch")) - 1).cast("int")).withColumn("n_parts", F.count("*").over(W.Window.partitionBy(run)).cast("int"))
    body = F.array_join(F.transform("x", lambda b: b.text), "\n\n")
    return numbered.select(run, "part", "n_parts", F.array_distinct(F.transform("x", lambda b: b.doc_id)).alias("doc_ids"), F.concat(F.lit(head + "\n"), body).alias("prompt"))


def table_prompt(markdown: Column, html: Column, table_id: Column, file_name: Column, page: Column) -> Column:
    """What to ask a model that cleans one table."""
    where = F.concat(F.lit("Table "), F.coalesce(table_id, F.lit("")), F.lit(" of "), F.coalesce(file_name, F.lit("")), F.lit(", page "), F.coalesce(page.cast("string"), F.lit("unknown")))
    return _lines("Clean the table below. Answer with one JSON object: caption, columns, rows (objects by column) and issues. Keep every value; invent none.", where, "Markdown:", safe_text(markdown), "HTML:", F.substring(safe_text(html), 1, 8000))


def visual_prompt(visual_id: Column, file_name: Column, nearby_text: Column, note: Column) -> Column:
    """What to ask a model that looks at one picture."""
    said = F.when(safe_text(note) != "", safe_text(note)).otherwise("(none)")
    return _lines("Describe the picture. Answer with one JSON object: visual_type, summary, visible_text, importance and issues.", F.concat(F.lit("Picture "), visual_id, F.lit(" of "), file_name), "Text near it:", safe_text(nearby_text), "Reviewer's note:", said)


# ---- phases ----------------------------------------------------------------------------

PHASE_FILES = ("input/", "run_manifest.json", "layout_items.json", "cleaned_tables.json", "image_summaries.json", "file_llm_feed.md", "company_dossier_merged.json", "millenia_dossier_export.xlsx")


def phases(files: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """run, done (one flag for each phase, in order), n_done, n_phases, from the files that each run has (paths within it)."""
    flags = [F.coalesce(F.bool_or(F.col(path).startswith(f) if f.endswith("/") else F.col(path) == f), F.lit(False)) for f in PHASE_FILES]
    out = files.groupBy(run).agg(F.array(*flags).alias("done"))
    return out.withColumn("n_done", F.size(F.filter("done", lambda d: d))).withColumn("n_phases", F.lit(len(PHASE_FILES)))


def run_id(prefix: str, at: Column, key: Column) -> Column:
    """An id of a run from its time and a key: prefix, date, time, six hex digits of the key's hash."""
    return F.concat(F.lit(prefix + "_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(key.cast("string")), 1, 6))


def complete_fields(found: DataFrame, docs: DataFrame, doc: str, names: list[str]) -> DataFrame:
    """doc, field, value for every document and every name of a fixed list; null where nothing was found."""
    every = docs.select(doc, F.explode(F.array(*map(F.lit, names))).alias("field"))
    return every.join(found.select(doc, "field", "value"), [doc, "field"], "left")


def review(items: DataFrame, **wanted: list) -> DataFrame:
    """Rows that pass each filter given; None: no filter."""
    for name, values in wanted.items():
        if values is not None:
            items = items.filter(F.col(name).isin(values))
    return items
