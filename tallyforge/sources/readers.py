"""Readers: investor and signal exports, deals, templates, binary documents, sheets, a snapshot data source.

All readers are lazy and distributed. Spreadsheets come in as rows of text (workbook.py, clean_sheet).
Unknown keys are dropped by the schema; rows that do not parse are kept apart and do not end the file.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyforge.functions.fixed import DOCUMENT_NAMES
from tallyforge.functions.text import clean_text
from tallyforge.operators.candidates import from_raw, wire
from tallyforge.operators.tables import first_wins, identity_key, in_order
from tallyforge.sources.files import listing
from tallyforge.sources.workbook import read_workbooks

SIGNAL = T.StructType([T.StructField(n, T.StringType()) for n in ("source_type", "text", "source_url", "date")] + [T.StructField("confidence", T.DoubleType()), T.StructField("visibility", T.StringType())])
FUND = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("fund_id", "name", "lead_preference", "status", "thesis_text")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("stage_focus", "geography", "industry_focus", "sector_exclusions", "preferred_verticals")]
    + [T.StructField("check_size_min", T.LongType()), T.StructField("check_size_max", T.LongType()), T.StructField("recent_investment_count_12m", T.IntegerType()), T.StructField("aum_millions", T.DoubleType()), T.StructField("dry_powder_millions", T.DoubleType())]
)
INVESTOR = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("investor_id", "full_name", "firm", "title", "email", "phone", "linkedin_url", "twitter_handle", "website", "investment_thesis", "check_size_range", "last_verified_at", "investor_type", "pitchbook_id", "hq_location", "hq_state")]
    + [T.StructField("fund", FUND), T.StructField("portfolio_companies", T.ArrayType(T.StringType())), T.StructField("signals", T.ArrayType(SIGNAL)), T.StructField("source_tags", T.ArrayType(T.StringType())), T.StructField("warm_intro_paths", T.ArrayType(T.StringType())), T.StructField("data_quality_confidence", T.DoubleType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)


def read_investors(spark: SparkSession, glob: str) -> DataFrame:
    """Investors of all export files in file and row order, with defaults and running ids (id, id__dup2, ...)."""
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("investors", T.ArrayType(INVESTOR))])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(glob).withColumn("file", F.input_file_name())
    rows = raw.filter(F.col("investors").isNotNull()).select("file", "source", F.posexplode("investors").alias("pos", "i")).select("file", "source", "pos", "i.*")
    fund = F.struct(
        F.col("fund.fund_id").alias("fund_id"), F.coalesce("fund.name", "firm").alias("name"), F.coalesce("fund.stage_focus", F.array().cast("array<string>")).alias("stage_focus"),
        F.coalesce("fund.check_size_min", F.lit(100_000)).alias("check_size_min"), F.coalesce("fund.check_size_max", F.lit(2_000_000)).alias("check_size_max"),
        F.coalesce("fund.geography", F.array(F.lit("United States"))).alias("geography"), F.coalesce("fund.industry_focus", F.array().cast("array<string>")).alias("industry_focus"),
        F.coalesce("fund.sector_exclusions", F.array().cast("array<string>")).alias("sector_exclusions"), F.coalesce("fund.status", F.lit("active")).alias("status"),
        F.coalesce("fund.recent_investment_count_12m", F.lit(0)).alias("recent_investment_count_12m"), F.coalesce("fund.thesis_text", F.lit("")).alias("thesis_text"), F.coalesce("fund.preferred_verticals", F.array().cast("array<string>")).alias("preferred_verticals"),
    )
    blank = F.col("canonical_investor_id") == ""
    # rows without an id are not numbered, and so are not gathered in one task
    w = W.Window.partitionBy("canonical_investor_id", F.when(blank, F.xxhash64("file", "pos"))).orderBy("file", "pos")
    rows = rows.withColumn("canonical_investor_id", F.trim(F.coalesce("investor_id", F.lit("")))).withColumn("_n", F.row_number().over(w))
    return (
        rows.withColumn("investor_id", F.when(blank | (F.col("_n") == 1), F.col("canonical_investor_id")).otherwise(F.concat("canonical_investor_id", F.lit("__dup"), F.col("_n"))))
        .withColumn("fund", fund)
        .withColumn("data_quality_confidence", F.coalesce("data_quality_confidence", F.lit(0.5)))
        .withColumn("source_tags", F.coalesce("source_tags", F.array(F.coalesce("source", F.lit("")))))
        .withColumn("signals", F.coalesce("signals", F.array().cast(T.ArrayType(SIGNAL))))
        .drop("_n")
    )


def read_signals(spark: SparkSession, glob: str) -> DataFrame:
    """canonical_investor_id, signals of all signal files: objects with signals, or bare arrays named by their id."""
    text = spark.read.option("wholetext", True).text(glob).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    holder = T.StructType([T.StructField("investor_id", T.StringType()), T.StructField("signals", T.ArrayType(SIGNAL))])
    bare = F.trim("value").startswith("[")
    rows = text.select(F.when(bare, F.struct(F.col("file").alias("investor_id"), F.from_json("value", T.ArrayType(SIGNAL)).alias("signals"))).otherwise(F.from_json("value", holder)).alias("s"), "file")
    return rows.select(F.coalesce("s.investor_id", "file").alias("canonical_investor_id"), F.explode("s.signals").alias("signal")).groupBy("canonical_investor_id").agg(F.collect_list("signal").alias("external_signals"))


def attach_signals(investors: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of an id go to all its rows, running ids included."""
    joined = investors.join(signals, "canonical_investor_id", "left")
    return joined.withColumn("signals", F.concat("signals", F.coalesce("external_signals", F.array().cast(T.ArrayType(SIGNAL))))).drop("external_signals")


def read_sample(spark: SparkSession, path: str, tag: str = "mock_seed_dataset") -> DataFrame:
    """Candidates of a raw sample file ({"investors": [...]}), numbered from 1 in the order of the file."""
    text = ("full_name", "firm", "title", "email", "phone", "linkedin_url", "twitter_handle", "website", "check_size_range", "investment_thesis", "why_good_fit")
    row = T.StructType([T.StructField(n, T.StringType()) for n in text] + [T.StructField("portfolio_companies", T.ArrayType(T.StringType()))])
    raw = spark.read.schema(T.StructType([T.StructField("investors", T.ArrayType(row))])).option("multiLine", True).json(path)
    return from_raw(raw.select(F.posexplode("investors").alias("pos", "i")).select((F.col("pos") + 1).alias("idx"), "i.*"), tag)


def load_all(ingested: DataFrame, sample: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """The whole corpus without a deal: ingested investors, the sample after them where one is given, and of rows with one
    identity the first where asked for."""
    rows = in_order(ingested, *([sample] if sample is not None else []))
    return first_wins(rows, identity_key(F.col("email"), F.col("full_name"), F.col("firm")), "src_prio", "investor_id") if dedupe else rows


def read_templates(spark: SparkSession, glob: str) -> DataFrame:
    """template (file name without its end), fields (name, description) of template files, one row each."""
    field = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType())]))
    raw = spark.read.schema(T.StructType([T.StructField("template_name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("fields", field)])).option("multiLine", True).json(glob)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("template"), "description", "fields")


def template(templates: DataFrame, name: str) -> DataFrame:
    """The one template of that name; reading it raises where there is none."""
    found = templates.filter(F.col("template") == name)
    none = found.agg(F.count("*").alias("_n")).filter(F.assert_true(F.col("_n") > 0, F.lit(f"template not found: {name}")).isNull())
    return found.crossJoin(F.broadcast(none.select("_n"))).drop("_n")  # one row


DEAL_REQUIRED = ("deal_id", "company_name", "company_website", "industry", "raise_amount", "founder_name", "founder_email", "founder_linkedin")


WIRE = T.StructType([T.StructField(n, T.StringType()) for n in ("investor_name", "firm", "status", "client_confirmed_at", "investor_confirmed_at", "dock_walls_approved_at", "notes")] + [T.StructField("wire_amount", T.DoubleType())])
DEAL_STATUSES = ("missing", "draft", "approved", "distributed")


def read_deals(spark: SparkSession, glob: str) -> DataFrame:
    """Deals with defaults: documents missing, lists empty, wires pending. A missing required field, and a document status
    that is none, raise when the row is read."""
    text = ("deal_id", "company_name", "company_website", "industry", "founder_name", "founder_email", "founder_linkedin", "stage", "stage_label", "geography", "problem", "solution", "market_size", "team_bios", "traction_metrics", "competitors", "use_of_funds_breakdown", "created_at", "last_updated")
    lists = ("nda_signed_by", "errors", "skipped_steps")
    people = ("investors_contacted", "investors_responded", "investors_committed", "disqualified_investors")
    maps = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in text] + [T.StructField("raise_amount", T.DoubleType()), T.StructField("valuation", T.DoubleType()), T.StructField("documents", T.MapType(T.StringType(), T.StringType()))]
        + [T.StructField(n, T.ArrayType(T.StringType())) for n in lists] + [T.StructField(n, maps) for n in people] + [T.StructField("wire_verifications", T.ArrayType(WIRE)), T.StructField("outreach_week", T.IntegerType()), T.StructField("campaign_active", T.BooleanType())]
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    for name in DEAL_REQUIRED:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"missing required field {name}"))).otherwise(F.col(name)))

    def status(name: str) -> Column:
        own = F.coalesce(F.try_element_at("documents", F.lit(name)), F.lit("missing"))
        return F.when(own.isin(*DEAL_STATUSES), own).otherwise(F.raise_error(F.concat(F.lit("not a document status: "), own)))

    papers = F.create_map(*[x for n in DOCUMENT_NAMES for x in (F.lit(n), status(n))])
    full = {n: F.coalesce(n, F.array().cast("array<string>")) for n in lists} | {n: F.coalesce(n, F.array().cast(maps)) for n in people}
    wires = F.transform(F.coalesce("wire_verifications", F.array().cast(T.ArrayType(WIRE))), wire)
    return rows.withColumns(full | {"documents": papers, "wire_verifications": wires, "stage": F.coalesce("stage", F.lit("onboarded")), "outreach_week": F.coalesce("outreach_week", F.lit(0)), "campaign_active": F.coalesce("campaign_active", F.lit(False))})


def read_json(spark: SparkSession, path: str, schema: str, default: list | None = None) -> DataFrame:
    """JSON documents (an object or a list each) in these columns; where no file is, the default rows."""
    if not listing(spark, path):
        return spark.createDataFrame(default or [], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """Binary files with name and content, for parsers that run in pandas UDFs, and the content as base64, for models that take it so."""
    rows = spark.read.format("binaryFile").load(glob)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", "content", F.base64("content").alias("content_b64"))


def clean_sheet(rows: DataFrame, names: dict[str, str], name: str = "name", most: int | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A spreadsheet's rows (pos and text columns): renamed, cleaned, without blank names or required fields, first of each name,
    at most so many."""
    out = rows.select("pos", *[clean_text(F.col(f"`{h}`")).alias(k) for h, k in names.items()])
    for key in (name, *required):
        out = out.filter(F.length(F.trim(key)) > 0)
    w = W.Window.partitionBy(name).orderBy("pos")
    out = out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy("pos")
    return out.limit(most) if most is not None else out


def load_investors(spark: SparkSession, where: str, names: dict[str, str], name: str = "name", most: int | None = None, sheet: str | None = None, header: int = 6, required: tuple[str, ...] = ()) -> DataFrame:
    """Investors from a workbook: the columns of names (header -> key; empty where the sheet has none), cleaned, the first of
    each name, without rows that lack a required field, at most so many in their order."""
    rows = read_workbooks(spark, where, sheet, header)
    missing = {h: F.lit(None).cast("string") for h in names if h not in rows.columns}
    return clean_sheet(rows.withColumns(missing), names, name, most, required)


class SnapshotRange(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PeopleSnapshot(DataSource):
    """spark.read.format("people_snapshot").load(folder): saved people-search answers, one JSON file for each partition."""

    @classmethod
    def name(cls) -> str:
        return "people_snapshot"

    def schema(self) -> str:
        return "name string, firm string, website string, title string, email string, phone string, linkedin string, twitter string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PeopleReader(self.options["path"], schema.fieldNames())


class PeopleReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path)
        return [SnapshotRange(f.path) for f in sorted(where.get_file_info(fs.FileSelector(root)), key=lambda f: f.path) if f.path.endswith(".json")]

    def read(self, part: SnapshotRange) -> Iterator[tuple]:
        import json

        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(self.path)
        with where.open_input_file(part.path) as f:
            answer = json.loads(f.read())
        for row in answer.get("people", []) if isinstance(answer, dict) else answer:
            yield tuple("" if row.get(n) is None else str(row.get(n)) for n in self.names)
