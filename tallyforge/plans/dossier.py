"""Queries over dossier relations. Conversations stand for documents, turns for layout items, roles for item types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import layout as L
from tallyforge.functions.fixed import DOSSIER_FIELDS
from tallyforge.operators import dossier as O
from tallyforge.plans.book import Book, quoted, table

book = Book()
FIELDS = ["company_name", "website", "revenue", "valuation", "use_of_funds", "market_size"]


@book.query(
    """SELECT conv_id, '# Document: ' || conv_id || coalesce(chr(10) || string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) FILTER (role <> 'system'), '') AS feed FROM conversations GROUP BY conv_id"""
)
def feed_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("["), F.col("turn"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    return O.feed(table(spark, sf_dir, "conversations"), "conv_id", "turn", line, F.col("role") != "system")


@book.query("SELECT conv_id, turn, substr(coalesce(string_agg(CASE WHEN role IN ('user', 'assistant') THEN text END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ''), 1, 3000) AS nearby_text FROM conversations")
def nearby_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.nearby(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", O.TEXT_KINDS).select("conv_id", "turn", "nearby_text")


@book.query("SELECT conv_id::VARCHAR AS name, coalesce(string_agg('[' || turn || '] ' || role, chr(10) ORDER BY turn) FILTER (role <> 'system'), conv_id::VARCHAR) AS body FROM conversations GROUP BY conv_id")
def doc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("["), F.col("turn"), F.lit("] "), F.col("role"))
    feeds = O.feed(table(spark, sf_dir, "conversations"), "conv_id", "turn", line, F.col("role") != "system")
    return O.split_feed(feeds, "feed").select("name", "body")


@book.query("SELECT conv_id::VARCHAR AS name, coalesce(regexp_replace(string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) FILTER (role <> 'system'), '^\\s+|\\s+$', '', 'g'), conv_id::VARCHAR) AS body FROM conversations GROUP BY conv_id")
def doc_split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of feed_assembly, with whole texts, split. A marker within a text begins a document, too; the SQL's texts have none."""
    return O.split_feed(feed_assembly(spark, sf_dir), "feed").select("name", "body")


# ---- layout items of whole documents: conversations, whose turns are items of all kinds

KINDS = ["section_header", "text", "list_item", "table", "picture", "text"]
KIND = f"[{quoted(KINDS)}][(turn % 6 + 1)::INT]"
CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), chr(0), '', 'g')"


def _item(prefix: str = "") -> str:
    return f"{prefix}conv_id || '_item_' || lpad(({prefix}turn + 1)::VARCHAR, 4, '0')"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("turn") % 6).cast("int"))
    skim = F.when(F.col("turn") % 3 == 1, "likely_empty").otherwise("likely_useful")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return O.numbered_items(rows, "conv_id", "turn", kind, skim)


@book.query(
    f"""WITH x AS (SELECT conv_id, turn, {KIND} AS kind FROM conversations)
SELECT conv_id, turn, kind, conv_id || '_item_' || lpad(row_number() OVER w::VARCHAR, 4, '0') AS item_id, CASE WHEN kind = 'table' THEN conv_id || '_table_' || lpad((count(*) FILTER (kind = 'table') OVER w)::VARCHAR, 3, '0') END AS table_id,
  CASE WHEN kind = 'picture' THEN conv_id || '_visual_' || lpad((count(*) FILTER (kind = 'picture') OVER w)::VARCHAR, 3, '0') END AS visual_id, CASE WHEN kind = 'table' THEN 'needs_correction' WHEN kind = 'picture' AND turn % 3 = 1 THEN 'needs_review' ELSE 'keep' END AS human_status
FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def layout_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of documents with their ids, those of tables and pictures, and the status that they begin with."""
    return _items(spark, sf_dir).select("conv_id", "turn", "kind", "item_id", "table_id", "visual_id", "human_status")


@book.query(
    f"""WITH x AS (SELECT conv_id, turn, role, {KIND} AS kind, {CLEAN} AS t, {_item()} AS item_id, length(role) AS n FROM conversations),
y AS (SELECT *, CASE WHEN turn = 5 THEN '' WHEN kind = 'section_header' THEN CASE WHEN t <> '' THEN chr(10) || '## ' || t || chr(10) END WHEN kind = 'list_item' THEN CASE WHEN t <> '' THEN '- ' || t END WHEN kind = 'text' THEN t
  WHEN kind = 'table' AND conv_id % 2 = 0 THEN chr(10) || '### Cleaned Table: t' || turn || chr(10) || chr(10) || chr(10) || 'Caption: of ' || conv_id || chr(10) || chr(10) || chr(10) || '| ' || rpad('role', greatest(6, n)::INT, ' ') || ' | ' || lpad('n', greatest(3, length(turn::VARCHAR))::INT, ' ') || ' |' || chr(10) || '|:' || repeat('-', greatest(6, n)::INT + 1) || '|' || repeat('-', greatest(3, length(turn::VARCHAR))::INT + 1) || ':|' || chr(10) || '| ' || rpad(role, greatest(6, n)::INT, ' ') || ' | ' || lpad(turn::VARCHAR, greatest(3, length(turn::VARCHAR))::INT, ' ') || ' |'
  WHEN kind = 'table' THEN chr(10) || '### Raw Docling Table: ' || CASE WHEN conv_id % 3 = 0 THEN 'raw' ELSE item_id END || chr(10) || chr(10) || chr(10) || CASE WHEN conv_id % 3 = 0 THEN '| raw |' ELSE '(No raw table text available.)' END
  WHEN kind = 'picture' AND conv_id % 2 = 1 THEN chr(10) || '### Visual Summary: v' || turn || chr(10) || chr(10) || chr(10) || 'Type: chart' || chr(10) || chr(10) || chr(10) || 'Summary: None' || chr(10) || CASE WHEN conv_id % 3 = 0 THEN chr(10) || chr(10) || 'Visible text: a; b' ELSE '' END
  WHEN kind = 'picture' AND conv_id % 4 = 0 THEN chr(10) || '### Visual Reviewer Note' || chr(10) || 'a note' || chr(10) END AS line FROM x)
SELECT conv_id, chr(10) || '# Document: file ' || conv_id || '.pdf' || chr(10) || coalesce(chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY turn) FILTER (line <> ''), '') AS feed FROM y GROUP BY conv_id"""
)
def dossier_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text for a model: items with their cleaned or raw tables and picture summaries, the last of each item."""
    i = _items(spark, sf_dir)
    k, t = F.col("conv_id"), F.col("turn")
    items = i.select(k.alias("doc_id"), F.concat(F.lit("file "), k, F.lit(".pdf")).alias("file_name"), "reading_order", "item_id", "kind", F.when(t == 5, "discard").otherwise(F.col("human_status")).alias("human_status"), "text", F.when(k % 4 == 0, " a  note ").alias("human_note"))
    role = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    cleaned = i.join(role, ["conv_id", "turn"]).filter((F.col("kind") == "table") & (k % 2 == 0)).select("item_id", F.concat(F.lit("t"), t).alias("table_id"), F.concat(F.lit("of "), k).alias("caption"), F.array(F.lit("role"), F.lit("gone")).alias("columns"), F.array(F.create_map(F.lit("n"), t.cast("string"), F.lit("role"), F.col("role"))).alias("rows"), F.lit(2).alias("pos"))
    stale = cleaned.withColumns({"caption": F.lit("old"), "pos": F.lit(1)})
    raw = i.filter((F.col("kind") == "table") & (k % 3 == 0)).select("item_id", F.lit("raw").alias("table_id"), F.lit("| raw | ").alias("raw_markdown"), F.lit(1).alias("pos"))
    seen = i.filter((F.col("kind") == "picture") & (k % 2 == 1)).select("item_id", F.concat(F.lit("v"), t).alias("visual_id"), F.lit("chart").alias("visual_type"), F.lit(None).cast("string").alias("summary"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("visible_text"), F.lit(1).alias("pos"))
    return O.whole_feed(items, cleaned.unionByName(stale), raw, seen).select(F.col("doc_id").alias("conv_id"), "feed")


@book.query(
    """SELECT conv_id, string_agg('## t' || turn || chr(10) || chr(10) || 'cap' || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN '(No rows extracted.)' ELSE '| a   |' || chr(10) || '|:----|' || chr(10) || '| x   |' END || chr(10), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id"""
)
def tables_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned tables as sections of markdown."""
    t = F.col("turn")
    none = F.array().cast("array<map<string,string>>")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), t).alias("table_id"), F.lit("cap").alias("caption"), F.lit(None).cast("array<string>").alias("columns"), F.when(t % 2 == 0, none).otherwise(F.array(F.create_map(F.lit("a"), F.lit("x")))).alias("rows"))
    return O.tables_text(rows, "conv_id", "turn")


@book.query(
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'cap' ELSE '' END AS caption, CASE turn % 4 WHEN 0 THEN 'b' ELSE 'a' END AS columns, CASE turn % 4 WHEN 0 THEN '2' ELSE '1' END AS cell,
  CASE turn % 4 WHEN 0 THEN 'odd' WHEN 1 THEN 'F; LLM output had missing columns/rows, fallback used.' WHEN 2 THEN 'F; LLM correction failed: timeout' ELSE 'F; LLM output had missing columns/rows, fallback used.' END AS issues FROM conversations"""
)
def corrected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables with what a model made of them; where it failed the raw table stands."""
    t = F.col("turn")
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("conv_id", F.lit("/"), t).alias("table_id"), F.lit(None).cast("array<string>").alias("columns"), F.array(F.create_map(F.lit("a"), F.lit("1"))).alias("rows"))
    good = '```json\n{"caption": " cap ", "columns": ["b"], "rows": [{"b": "2"}], "issues": ["odd"]}\n```'
    answers = raw.select("table_id", F.when(t % 4 == 0, good).when(t % 4 == 1, '{"columns": [], "rows": [{"b": "2"}]}').when(t % 4 == 3, "none").alias("answer"), F.when(t % 4 == 2, "timeout").alias("error"))
    rows = O.corrected_tables(raw, answers)
    cell = F.try_element_at(F.get("rows", F.lit(0)), F.get("columns", F.lit(0)))
    return rows.select("conv_id", "turn", "caption", F.array_join("columns", ",").alias("columns"), cell.alias("cell"), F.replace(F.array_join("issues", "; "), F.lit(O.FALLBACK), F.lit("F")).alias("issues"))


@book.query("SELECT conv_id, turn, '' AS caption, CASE WHEN turn % 2 = 0 THEN 'z,a' ELSE 'a' END AS columns, 1 AS n_rows, 1 AS n_issues FROM conversations WHERE turn % 3 = 1")
def fallback_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen tables as they are, without a model."""
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), t % 3).alias("table_id"), F.when(t % 2 == 0, F.array(F.lit("z"), F.lit("a"))).alias("columns"), F.array(F.create_map(F.lit("a"), F.lit("1"))).alias("rows"))
    return O.corrected_tables(rows, None, ["t1"]).select("conv_id", "turn", "caption", F.array_join("columns", ",").alias("columns"), F.size("rows").alias("n_rows"), F.size("issues").alias("n_issues"))


@book.query(
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'chart' ELSE 'unknown' END AS visual_type, CASE WHEN turn % 5 = 0 THEN 'No crop image was available for VLM analysis.' WHEN turn % 4 = 0 THEN 'bars' WHEN turn % 4 = 1 THEN '' ELSE 'VLM analysis failed.' END AS summary,
  CASE WHEN turn % 5 = 0 THEN 'Missing crop path.' WHEN turn % 4 = 2 THEN 'timeout' WHEN turn % 4 = 3 THEN 'VLM returned non-object JSON' ELSE '' END AS issues, CASE WHEN turn % 4 = 0 THEN 2 ELSE 0 END AS n_texts, CASE WHEN turn % 6 = 0 THEN 'keep' ELSE 'needs_review' END AS status
FROM (SELECT *, turn AS t FROM conversations) WHERE NOT (turn % 7 = 6)""".replace("CASE WHEN turn % 4 = 0 THEN 'chart' ELSE 'unknown' END AS visual_type", "CASE WHEN turn % 4 = 0 AND turn % 5 <> 0 THEN 'chart' ELSE 'unknown' END AS visual_type").replace("CASE WHEN turn % 4 = 0 THEN 2 ELSE 0 END AS n_texts", "CASE WHEN turn % 4 = 0 AND turn % 5 <> 0 THEN 2 ELSE 0 END AS n_texts")
)
def visual_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that reviewers kept, with what a model saw in them, or why it saw nothing."""
    t = F.col("turn")
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("conv_id", F.lit("/"), t).alias("visual_id"), F.lit("i").alias("item_id"), F.when(t % 5 != 0, "crop.png").alias("crop_path"), F.lit("needs_review").alias("human_status"), F.lit("").alias("human_note"))
    edits = v.select("visual_id", F.when(t % 7 == 6, "discard").when(t % 6 == 0, "keep").alias("human_status"), F.lit(None).cast("string").alias("human_note"))
    noted = O.noted_visuals(v, edits)
    answers = v.select("visual_id", F.when(t % 4 == 0, 'Here: {"visual_type": "chart", "summary": "bars", "visible_text": ["a", "b"], "importance": "useful"}').when(t % 4 == 1, "{}").when(t % 4 == 3, "nothing").alias("answer"), F.when(t % 4 == 2, "timeout").alias("error"))
    rows = O.summarised_visuals(noted, answers)
    back = noted.select("visual_id", "conv_id", "turn", F.col("human_status").alias("status"))
    return rows.join(back, "visual_id").select("conv_id", "turn", "visual_type", "summary", F.array_join("issues", ",").alias("issues"), F.size("visible_text").alias("n_texts"), "status")


ANSWER = '{"document_category": "Term sheet", "short_summary": "s", "fields": {"company_name": {"value": "Acme", "answer": "said", "evidence_quote": "we are Acme"}, "revenue": "5M", "arr": {"value": null}}}'


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's feed stands for a run of its own documents; part is the document's place."""
    docs = O.split_feed(feed_assembly(spark, sf_dir), "feed").select(F.col("conv_id").alias("part"), "name")
    k = F.col("part")
    manifest = docs.filter(k % 2 == 0).select("part", F.concat(F.lit("f"), k, F.lit(".pdf")).alias("file_name"))
    answers = docs.select("part", F.when(k % 3 == 0, ANSWER).when(k % 3 == 1, "no json here").alias("answer"), F.when(k % 3 == 2, "timeout").alias("error"))
    return O.extracted(docs, manifest, answers)


DOCS = "d AS (SELECT DISTINCT conv_id AS k FROM conversations)"


@book.query(
    f"""WITH {DOCS}, f AS (SELECT k, unnest([{quoted(DOSSIER_FIELDS)}]) AS field FROM d)
SELECT 'doc_' || CASE WHEN k + 1 < 1000 THEN lpad((k + 1)::VARCHAR, 3, '0') ELSE (k + 1)::VARCHAR[1:3] END AS doc_id, field, CASE WHEN k % 3 = 0 THEN CASE field WHEN 'company_name' THEN 'Acme' WHEN 'revenue' THEN '5M' END END AS value, CASE WHEN k % 3 = 0 AND field = 'company_name' THEN 'said' ELSE '' END AS answer,
  CASE WHEN k % 3 = 0 AND field = 'company_name' THEN CASE WHEN k % 2 = 0 THEN 'f' || k || '.pdf' ELSE k::VARCHAR END || ': we are Acme' ELSE '' END AS evidence FROM f""".replace("CASE WHEN k + 1 < 1000 THEN lpad((k + 1)::VARCHAR, 3, '0') ELSE (k + 1)::VARCHAR[1:3] END", "CASE WHEN k + 1 < 1000 THEN lpad((k + 1)::VARCHAR, 3, '0') ELSE (k + 1)::VARCHAR END")
)
def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 62 fields of each document, from a model's answer, a bare value, or nothing."""
    rows = _extracted(spark, sf_dir).select("doc_id", F.explode("doc_fields").alias("field", "v"))
    found = F.array_join(F.transform("v.evidence", lambda e: F.concat(e.file_name, F.lit(": "), e.quote)), ";")
    return rows.select("doc_id", "field", F.col("v.value").alias("value"), F.col("v.answer").alias("answer"), found.alias("evidence"))


@book.query(
    f"""WITH {DOCS}, e AS (SELECT k, CASE k % 3 WHEN 0 THEN 'Term sheet' ELSE 'Unknown' END AS category, CASE k % 3 WHEN 0 THEN 's' WHEN 1 THEN 'Extraction failed: LLM returned non-object JSON' ELSE 'Extraction failed: timeout' END AS said FROM d)
SELECT 'all' AS short_summary, 62 AS n_fields, 2 AS n_found, count(*) AS n_documents, 'Acme' AS company_name, 'Not found in any document.' AS missing, count(*) FILTER (category = 'Unknown') AS n_unknown, count(DISTINCT said) AS n_summaries FROM e"""
)
def merged_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dossier of a run: every field, those that the merging model left out as not found."""
    docs = _extracted(spark, sf_dir)
    answer = spark.range(1).select(F.lit('{"short_summary": "all", "final_fields": {"company_name": {"value": "Acme", "answer": "a"}, "website": {"value": null, "answer": "none"}, "mrr": {"value": "5", "answer": "b"}}}').alias("answer"), F.lit(None).cast("string").alias("error"))
    d = O.merged_dossier(docs, answer)
    unknown = F.size(F.filter("documents", lambda x: x.document_category == "Unknown")).cast("long")
    said = F.size(F.array_distinct(F.transform("documents", lambda x: x.short_summary))).cast("long")
    return d.select("short_summary", F.size("final_fields").alias("n_fields"), F.col("n_fields").alias("n_found"), "n_documents", F.try_element_at("final_fields", F.lit("company_name")).value.alias("company_name"), F.try_element_at("final_fields", F.lit("arr")).answer.alias("missing"), unknown.alias("n_unknown"), said.alias("n_summaries"))


ASKED = ("Term sheet", "Unknown")
ASKS = [
    "Read the document below and answer with one JSON object and nothing else.", "Document: {0}", "Keys: document_category (one of the categories), short_summary, long_summary, fields, key_people.", "fields maps each field name below to value, answer and evidence_quote (copied from the text); value is null where the text does not say.",
    "Fields:", *[f"- {n}: the {n} it names" for n in DOSSIER_FIELDS], "Categories:", *[f"- {c}" for c in ASKED], "Text:", "{1}",
]
MERGES = ["Merge the fields that were found in these documents into one JSON object with short_summary, long_summary and final_fields.", "final_fields maps each name to value, answer and evidence; null where no document says it; lists are joined without repeats.", "Names: " + ", ".join(DOSSIER_FIELDS)]


@book.query(
    f"""WITH {DOCS}, e AS (SELECT k, 'doc_' || CASE WHEN k + 1 < 1000 THEN lpad((k + 1)::VARCHAR, 3, '0') ELSE (k + 1)::VARCHAR END AS doc_id, CASE WHEN k % 2 = 0 THEN 'f' || k || '.pdf' ELSE k::VARCHAR END AS file_name, CASE k % 3 WHEN 0 THEN 's' WHEN 1 THEN 'Extraction failed: LLM returned non-object JSON' ELSE 'Extraction failed: timeout' END AS said FROM d),
m AS (SELECT md5({quoted([chr(10).join(MERGES)])} || chr(10) || string_agg('Document: ' || file_name || chr(10) || 'Fields:' || chr(10) || CASE WHEN k % 3 = 0 THEN '  company_name: Acme' || chr(10) || '  revenue: 5M' ELSE '' END, chr(10) || chr(10) ORDER BY doc_id)) AS merge_md5 FROM e)
SELECT doc_id, md5(replace(replace({quoted([chr(10).join(ASKS)])}, '{{0}}', file_name), '{{1}}', said)) AS prompt_md5, merge_md5 FROM e, m"""
)
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for each document and for the merge, letter by letter."""
    docs = _extracted(spark, sf_dir)
    one = O.document_prompt(F.col("file_name"), F.col("short_summary"), {n: f"the {n} it names" for n in DOSSIER_FIELDS}, ASKED)
    return docs.select("doc_id", F.md5(one).alias("prompt_md5")).crossJoin(O.merge_prompt(docs).select(F.md5("prompt").alias("merge_md5")))  # one row


@book.query(
    f"""SELECT conv_id, turn, md5('Describe the picture. Answer with one JSON object: visual_type, summary, visible_text, importance and issues.' || chr(10) || 'Picture ' || conv_id || '/' || turn || ' of f.pdf' || chr(10) || 'Text near it:' || chr(10) || {CLEAN} || chr(10) || 'Reviewer''s note:' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'note' ELSE '(none)' END) AS picture_md5,
  md5('Clean the table below. Answer with one JSON object: caption, columns, rows (objects by column) and issues. Keep every value; invent none.' || chr(10) || 'Table ' || conv_id || '/' || turn || ' of f.pdf, page ' || CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE 'unknown' END || chr(10) || 'Markdown:' || chr(10) || '| ' || role || ' |' || chr(10) || 'HTML:' || chr(10) || substr({CLEAN}, 1, 8000)) AS table_md5 FROM conversations"""
)
def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for a picture and a table, letter by letter: ids, the text around, the reviewer's note, the table's text."""
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.concat("conv_id", F.lit("/"), "turn"))
    p = O.visual_prompt(F.col("id"), F.lit("f.pdf"), F.col("text"), F.when(t % 2 == 0, "note"))
    q = O.table_prompt(F.concat(F.lit("| "), "role", F.lit(" |")), F.col("text"), F.col("id"), F.lit("f.pdf"), F.when(t % 2 == 0, t))
    return rows.select("conv_id", "turn", F.md5(p).alias("picture_md5"), F.md5(q).alias("table_md5"))


@book.query(
    f"""WITH {DOCS}, e AS (SELECT k % 7 AS run, 'doc_' || CASE WHEN k + 1 < 1000 THEN lpad((k + 1)::VARCHAR, 3, '0') ELSE (k + 1)::VARCHAR END AS doc_id, CASE WHEN k % 2 = 0 THEN 'f' || k || '.pdf' ELSE k::VARCHAR END AS file_name, k FROM d),
m AS (SELECT run, count(*) AS n_documents, md5({quoted([chr(10).join(MERGES)])} || chr(10) || string_agg('Document: ' || file_name || chr(10) || 'Fields:' || chr(10) || CASE WHEN k % 3 = 0 THEN '  company_name: Acme' || chr(10) || '  revenue: 5M' ELSE '' END, chr(10) || chr(10) ORDER BY doc_id)) AS prompt_md5 FROM e GROUP BY run)
SELECT run, n_documents, prompt_md5, CASE WHEN run % 2 = 0 THEN 'merged ' || run ELSE 'Merge failed: Merge returned non-object JSON' END AS short_summary, CASE WHEN run % 2 = 0 THEN 'Acme ' || run END AS company_name FROM m"""
)
def dossiers_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven runs in one table: what each run's merging model is asked, and the dossiers out of the answers that there are."""
    docs = _extracted(spark, sf_dir).withColumn("run", (F.regexp_extract("doc_id", r"(\d+)$", 1).cast("long") - 1) % 7)
    asked = O.merge_prompt_md5(docs, "run")
    answers = docs.select("run").distinct().filter("run % 2 = 0").select("run", F.concat(F.lit('{"short_summary": "merged '), "run", F.lit('", "final_fields": {"company_name": {"value": "Acme '), "run", F.lit('", "answer": "a"}}}')).alias("answer"), F.lit(None).cast("string").alias("error"))
    made = O.merged_dossier(docs, answers, run="run")
    return made.join(asked, "run").select("run", "n_documents", "prompt_md5", "short_summary", F.try_element_at("final_fields", F.lit("company_name")).value.alias("company_name"))


PHASED = ["input/a.pdf", "run_manifest.json", "file_llm_feed.md", "other.txt", "company_dossier_merged.json"]


@book.query(f"WITH x AS (SELECT conv_id, [{quoted(PHASED)}][(turn % 5 + 1)::INT] AS path FROM conversations) SELECT conv_id, count(DISTINCT path) FILTER (path <> 'other.txt')::INT AS n_done, 8 AS n_phases, bool_or(path = 'file_llm_feed.md') AS has_feed FROM x GROUP BY conv_id")
def run_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phases each run has gone through, by the files that it has."""
    path = F.get(F.array(*map(F.lit, PHASED)), (F.col("turn") % 5).cast("int"))
    rows = O.phases(table(spark, sf_dir, "conversations").select("conv_id", path.alias("path")), "conv_id")
    return rows.select("conv_id", "n_done", "n_phases", F.get("done", F.lit(5)).alias("has_feed"))


@book.query("SELECT event_id, 'run_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || md5(event_id::VARCHAR)[1:6] AS run_id FROM events")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", O.run_id("run", F.col("ts"), F.col("event_id")).alias("run_id"))


@book.query("SELECT p_partkey, 'column_1,' || 'name,' || 'column_3' AS names, p_name || '|' || '' || '|' || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS cells FROM part")
def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of texts as records by header."""
    header = F.array(F.lit(" "), F.lit(" name "), F.lit(None).cast("string"))
    row = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit(" "), "p_name"), F.lit(None).cast("string"), F.lit("x"))).otherwise(F.array(F.concat("p_name", F.lit("  "))))
    one = F.get(L.text_records(header, F.array(row)), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.map_keys(one), ",").alias("names"), F.array_join(F.map_values(one), "|").alias("cells"))


@book.query(
    f"""WITH f AS (SELECT doc_id, unnest([{quoted(FIELDS)}]) AS field, quality, toxic FROM labels) SELECT doc_id, field, CASE field WHEN 'company_name' THEN quality::VARCHAR WHEN 'revenue' THEN toxic::VARCHAR END AS value FROM f"""
)
def field_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = labels.select("doc_id", F.lit("company_name").alias("field"), F.col("quality").cast("string").alias("value")).unionByName(labels.select("doc_id", F.lit("revenue").alias("field"), F.col("toxic").cast("string").alias("value")))
    return O.complete_fields(found, labels, "doc_id", FIELDS)


@book.query("SELECT field, count(*) AS n_docs, count(value) AS n_found FROM (SELECT unnest(['quality', 'toxic', 'lang']) AS field, unnest([quality::VARCHAR, toxic::VARCHAR, lang]) AS value FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY field")
def final_fields_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in ("quality", "toxic", "lang")])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count("*").alias("n_docs"), F.count("value").alias("n_found"))


@book.query("SELECT conv_id, turn, i::INT AS i, line FROM (SELECT conv_id, turn, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE line <> ''")
def explode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter("line <> ''")


@book.query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user') AND turn IN (0, 2, 4)")
def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.review(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), role=["user"], turn=[0, 2, 4], conv_id=None)


@book.query("SELECT conv_id, turn, CASE WHEN kind = 'picture' AND skim = 'likely_empty' THEN 'needs_review' WHEN kind = 'table' THEN 'needs_correction' ELSE 'keep' END AS status FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'picture' WHEN 'assistant' THEN 'table' ELSE 'text' END AS kind, CASE WHEN turn % 3 = 0 THEN 'likely_empty' ELSE 'useful' END AS skim FROM conversations)")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "picture").when(F.col("role") == "assistant", "table").otherwise("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", O.default_status(kind, F.when(F.col("turn") % 3 == 0, "likely_empty").otherwise("useful")).alias("status"))


@book.query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n_items, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role, true) AS starts FROM conversations")
def group_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import window as W

    doc = W.Window.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(doc).alias("n_items"), (~F.lag("role").over(doc.orderBy("turn")).eqNullSafe(F.col("role"))).alias("starts"))
