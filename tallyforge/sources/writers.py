"""Writers: reports, JSON lines, one-row summaries, dossier sheets, keyed overwrite of a table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.fixed import REPORT_COLUMNS
from tallyforge.operators.vectors import upsert


def write_report(rows: DataFrame, path: str) -> None:
    """The report's columns in their order, with a header, by score."""
    rows.select(*[F.col(f"`{c}`") for c in REPORT_COLUMNS]).orderBy(F.desc("Signal Score"), REPORT_COLUMNS[0]).write.mode("overwrite").option("header", True).csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """A one-row frame as one JSON document."""
    rows.limit(1).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vectors by namespace, so that a namespace is read alone."""
    rows.write.mode("overwrite").partitionBy("namespace").parquet(path)


def upsert_vectors(old: DataFrame, new: DataFrame, path: str, keys: tuple[str, ...] = ("namespace", "record_id")) -> None:
    """A new folder with old rows replaced by key; folders that are read are never written to."""
    write_vectors(upsert(old, new, list(keys)), path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Each sheet as a folder of its own; nested columns as JSON text."""
    for name, df in sheets.items():
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def dossier_sheets(documents: DataFrame, items: DataFrame, raw: DataFrame, cleaned: DataFrame, visuals: DataFrame, summaries: DataFrame, dossier: DataFrame, run: str) -> dict[str, DataFrame]:
    """The ten sheets of a run's export, by name, for write_sheets. cleaned: table_id, file_name, page_no, caption, columns, rows,
    issues. dossier: one row with final_fields (a map) and documents (an array of structs)."""
    rows = F.coalesce("rows", F.array().cast("array<map<string,string>>"))
    fields = dossier.select(F.explode("final_fields").alias("field", "v"))
    evidence = F.size("v.evidence") if "evidence" in [f.name for f in fields.schema["v"].dataType] else F.lit(0)
    return {
        "overview": documents.agg(F.count("*").alias("document_count")).select(F.lit(run).alias("run_dir"), "document_count"),
        "documents": documents,
        "layout_items": items,
        "raw_tables": raw.drop("raw_html", "raw_markdown"),
        "cleaned_tables": cleaned.select("table_id", "file_name", "page_no", "caption", F.size(rows).alias("row_count"), F.array_join("columns", ", ").alias("columns"), F.array_join("issues", "; ").alias("issues")),
        "cleaned_table_rows": cleaned.select("table_id", F.posexplode(rows).alias("_i", "row")).select("table_id", (F.col("_i") + 1).alias("row_number"), "row"),
        "visual_items": visuals,
        "image_summaries": summaries,
        "dossier_fields": fields.select("field", "v.value", "v.answer", evidence.alias("evidence_count")),
        "dossier_documents": dossier.select(F.inline("documents")),
    }
