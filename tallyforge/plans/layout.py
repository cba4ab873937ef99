"""Queries over layout scalars and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import layout as L
from tallyforge.plans.book import Book, quoted, table

book = Book()


@book.query(
    """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'table' ELSE 'picture' END AS kind, p_size * 400 AS area, (p_partkey % 101) / 100.0::DOUBLE AS white, p_partkey % 5 AS detail, p_partkey % 17 AS spread FROM part)
SELECT p_partkey, CASE WHEN kind = 'table' THEN CASE WHEN area < 8000 THEN 'needs_review' WHEN white > 0.98 AND detail < 2 THEN 'needs_review' ELSE 'likely_useful' END
  ELSE CASE WHEN area < 6000 THEN 'likely_decorative' WHEN white > 0.985 AND detail < 2 THEN 'likely_empty' WHEN spread < 8 AND detail < 3 THEN 'likely_decorative' ELSE 'likely_useful' END END AS label FROM x"""
)
def crop_skim(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", L.crop_label(F.when(k % 2 == 0, "table").otherwise("picture"), F.col("p_size") * 400, k % 101 / 100.0, k % 5, k % 17).alias("label"))


@book.query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS l, l_discount AS t, l_quantity / 60 AS r, l_tax + 0.3 AS b, l_linenumber % 2 = 0 AS flip FROM lineitem),
y AS (SELECT *, greatest(l, t, r, b) <= 1.5 AS share FROM x),
z AS (SELECT *, CASE WHEN share THEN l * 600.0 ELSE l END AS x0, CASE WHEN share THEN r * 600.0 ELSE r END AS x1, CASE WHEN share THEN t * 800.0 ELSE t END AS y0, CASE WHEN share THEN b * 800.0 ELSE b END AS y1 FROM y),
w AS (SELECT *, CASE WHEN flip THEN 800.0 - y0 ELSE y0 END AS a, CASE WHEN flip THEN 800.0 - y1 ELSE y1 END AS c FROM z)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(least(x0, x1), 600.0)), 4) AS x_left, round(greatest(0, least(least(a, c), 800.0)), 4) AS y_top, round(greatest(0, least(greatest(x0, x1), 600.0)), 4) AS x_right, round(greatest(0, least(greatest(a, c), 800.0)), 4) AS y_bottom FROM w"""
)
def box_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = L.page_box(F.col("l_quantity") / 100, F.col("l_discount"), F.col("l_quantity") / 60, F.col("l_tax") + 0.3, F.when(F.col("l_linenumber") % 2 == 0, "BOTTOMLEFT"), F.lit(600.0), F.lit(800.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(f"b.{n}", 4).alias(a) for n, a in (("left", "x_left"), ("top", "y_top"), ("right", "x_right"), ("bottom", "y_bottom"))])


LABELS = {"TableItem table": "table", "PictureItem": "picture", "FigureItem": "picture", "chart": "picture", "TextItem section": "section_header", "TextItem page_header": "section_header", "title": "section_header", "ListItem": "list_item", "TextItem paragraph": "text", "heading": "text", "": "text"}


@book.query(f"SELECT page_id, [{quoted(LABELS.values())}][(page_id % {len(LABELS)} + 1)::INT] AS item_type FROM pages")
def item_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("page_id") % len(LABELS)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", L.item_type(label).alias("item_type"))


@book.query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props END AS found FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of fenced, surrounded and bare answers; none where there is none."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(k == 2, F.col("props")).otherwise("no answer")
    return table(spark, sf_dir, "events").select("event_id", L.json_in_text(text).alias("found"))


@book.query(
    """WITH w AS (SELECT conv_id, greatest(6, max(length(role))) AS r, greatest(6, max(length(turn::VARCHAR))) AS t FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, turn, '| ' || rpad(role, r::INT, ' ') || ' | ' || lpad(turn::VARCHAR, t::INT, ' ') || ' |' AS line FROM conversations JOIN w USING (conv_id))
SELECT conv_id, '| ' || rpad('role', any_value(r)::INT, ' ') || ' | ' || lpad('turn', any_value(t)::INT, ' ') || ' |' || chr(10) || '|:' || repeat('-', any_value(r)::INT + 1) || '|' || repeat('-', any_value(t)::INT + 1) || ':|' || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS markdown
FROM l JOIN w USING (conv_id) GROUP BY conv_id"""
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared columns first, then those that rows have beside them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role").alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("rows"))
    maps = F.transform("rows", lambda x: F.create_map(F.lit("turn"), x.turn.cast("string"), F.lit("role"), x.role))
    return rows.select("conv_id", L.table_markdown(F.array(F.lit("role"), F.lit("absent")), maps).alias("markdown"))


ITEMS = {
    '{"label": "text", "text": "a  b", "prov": [{"page_no": 3, "bbox": {"l": 1, "t": 2, "r": 3, "b": 4, "coord_origin": "bottomleft"}}]}': ("text", "a b", 3, "1.0,2.0,3.0,4.0,BOTTOMLEFT"),
    '{"class": "PictureItem", "caption": " cap ", "page_index": 0, "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}}': ("PictureItem", "cap", 1, "1.0,2.0,3.0,4.0,TOPLEFT"),
    '{"label": "", "class": "TableItem", "markdown": "| x |", "page": "7", "bbox": [5, 6, 7, 8]}': ("TableItem", "| x |", 7, "5.0,6.0,7.0,8.0,TOPLEFT"),
    '{"label": "list", "text": "", "orig": "o", "prov": {"page": 2, "bbox": {"bbox": {"left": 1, "top": 2, "right": 3, "bottom": 4}}}}': ("list", "o", 2, "1.0,2.0,3.0,4.0,TOPLEFT"),
    '{"label": "title"}': ("title", "", None, None),
    "no json": ("", "", None, None),
}


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else quoted([v]) if isinstance(v, str) else str(v) for v in values) + "]"


@book.query(f"SELECT page_id, {', '.join(f'{_sql_list(v)}[(page_id % {len(ITEMS)} + 1)::INT] AS {n}' for v, n in zip(zip(*ITEMS.values(), strict=True), ('label', 'body', 'page_no', 'box'), strict=True))} FROM pages")
def item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, text, page and box of parsed items in all their shapes."""
    item = F.get(F.array(*map(F.lit, ITEMS)), (F.col("page_id") % len(ITEMS)).cast("int"))
    box = L.item_box(F.col("item"))
    sides = F.concat_ws(",", *[box[n].cast("string") for n in ("left", "top", "right", "bottom", "coord_origin")])
    return table(spark, sf_dir, "pages").select("page_id", L.parsed_item(item).alias("item")).select("page_id", L.item_label(F.col("item")).alias("label"), L.item_text(F.col("item")).alias("body"), L.item_page(F.col("item")).alias("page_no"), F.when(box.isNotNull(), sides).alias("box"))


@book.query("SELECT vec_id, n AS area, round(white, 6) AS white, round((across + down) / 2, 4) AS detail, round(sqrt(greatest(sq - mean * mean, 0)), 4) AS spread FROM (SELECT vec_id, len(g) AS n, len(list_filter(g, lambda x: x > 245)) / len(g)::DOUBLE AS white, list_sum(g) / len(g)::DOUBLE AS mean, list_sum(list_transform(g, lambda x: x * x)) / len(g)::DOUBLE AS sq, list_avg(list_transform(list_filter(range(64), lambda i: i % 8 < 7), lambda i: abs(g[i + 2] - g[i + 1]))) AS across, list_avg(list_transform(range(56), lambda i: abs(g[i + 9] - g[i + 1]))) AS down FROM (SELECT vec_id, list_transform(range(64), lambda i: ((vec_id * 31 + i * i * 7) % 256)::DOUBLE) AS g FROM embeddings))")
def crop_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of crops of 8 by 8 grey samples."""
    greys = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda i: ((F.col("vec_id") * 31 + i * i * 7) % 256).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", L.crop_statistics(greys, F.lit(8)).alias("c"))
    return rows.select("vec_id", F.col("c.area").cast("long").alias("area"), F.round("c.white", 6).alias("white"), F.round("c.detail", 4).alias("detail"), F.round("c.spread", 4).alias("spread"))


@book.query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(20, 6))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(20,6)")).cast("double"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")
