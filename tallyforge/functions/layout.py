"""Layout scalars: item types, boxes, crop labels, JSON in free text, tables as markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import has_any, safe_text, strings


def item_type(label: Column) -> Column:
    """The kind of a layout item, from its class and label."""
    t = F.lower(F.coalesce(label, F.lit("")))
    return F.when(has_any(t, ("table",)), "table").when(has_any(t, ("picture", "image", "figure", "chart")), "picture").when(has_any(t, ("section", "header", "title")), "section_header").when(has_any(t, ("list",)), "list_item").otherwise("text")


def origin_name(origin: Column) -> Column:
    """Where a box's coordinates begin, in capitals; TOPLEFT where nothing says it."""
    return F.upper(F.coalesce(origin, F.lit("TOPLEFT")))


def page_box(left: Column, top: Column, right: Column, bottom: Column, origin: Column, width: Column, height: Column) -> Column:
    """A box in page units from the top left, inside the page; null if nothing is left of it."""
    share = F.greatest(F.abs(left), F.abs(top), F.abs(right), F.abs(bottom)) <= 1.5
    x0, x1 = (F.when(share, v * width).otherwise(v) for v in (left, right))
    y0, y1 = (F.when(share, v * height).otherwise(v) for v in (top, bottom))
    name = origin_name(origin)
    flip = F.contains(name, F.lit("BOTTOM")) & F.contains(name, F.lit("LEFT"))
    a, b = F.when(flip, height - y0).otherwise(y0), F.when(flip, height - y1).otherwise(y1)

    def inside(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, most))

    box = F.struct(inside(F.least(x0, x1), width).alias("left"), inside(F.least(a, b), height).alias("top"), inside(F.greatest(x0, x1), width).alias("right"), inside(F.greatest(a, b), height).alias("bottom"))
    return F.when((box.right > box.left) & (box.bottom > box.top), box)


def crop_label(kind: Column, area: Column, white: Column, detail: Column, spread: Column) -> Column:
    """What a crop is good for, by its size, its share of white, its detail and the spread of its greys; null area: no crop."""
    table = F.when(area < 8000, "needs_review").when((white > 0.98) & (detail < 2), "needs_review").otherwise("likely_useful")
    picture = F.when(area < 6000, "likely_decorative").when((white > 0.985) & (detail < 2), "likely_empty").when((spread < 8) & (detail < 3), "likely_decorative").otherwise("likely_useful")
    return F.when(area.isNull(), "needs_review").when(kind == "table", table).otherwise(picture)


def crop_statistics(greys: Column, width: Column) -> Column:
    """area, white (share above 245), detail (mean of neighbours' differences, both ways) and spread (deviation) of a crop's
    grey samples, row by row; null where there are none."""
    n = F.size(greys)
    x = F.transform(greys, lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n

    def steps(apart: Column, there: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: there(i))
        total = F.aggregate(at, F.lit(0.0), lambda a, i: a + F.abs(F.get(x, i + apart) - F.get(x, i)))
        return F.coalesce(F.try_divide(total, F.size(at)), F.lit(0.0))

    across, down = steps(F.lit(1), lambda i: i % width < width - 1), steps(width, lambda i: i + width < n)
    white = F.size(F.filter(x, lambda v: v > 245)) / n
    return F.when(n > 0, F.struct(n.alias("area"), white.alias("white"), ((across + down) / 2).alias("detail"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("spread")))


# ---- fields of parsed items, given as JSON text ------------------------------------------
# An item is parsed once (`parsed_item`); its fields are read from that. Shapes are tried in a loop over a list of their paths, so
# the code of a row stays small.


def parsed_item(item: Column) -> Column:
    """The item as a variant, which the functions below take; null for text that is no JSON."""
    return F.try_parse_json(item)


def _field(item: Column, path: str) -> Column:
    return F.try_variant_get(item, path if path.startswith("$") else "$." + path, "string")


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values])


def item_label(item: Column) -> Column:
    return F.coalesce(_first(_field(item, "label"), _field(item, "class")), F.lit(""))


def item_text(item: Column) -> Column:
    """Text, original text, caption or markdown, whichever is there first."""
    return safe_text(_first(*[_field(item, n) for n in ("text", "orig", "caption", "markdown")]))


def _at(item: Column, paths: tuple[str, ...]) -> Column:
    """What the item has at each path."""
    return F.array(*[F.try_variant_get(item, p, "variant") for p in paths])


def _first_of(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def item_page(item: Column) -> Column:
    """Page number from where the item was found, else its own; an index counts from 0."""
    def page(v: Column) -> Column:
        number = lambda n: _field(v, n).try_cast("int")
        return F.coalesce(number("page_no"), number("page"), number("page_index") + 1)

    return _first_of(F.transform(_at(item, ("$.prov[0]", "$.prov", "$.provenance[0]", "$.provenance", "$")), page))


def item_box(item: Column) -> Column:
    """left, top, right, bottom, coord_origin of a box in any of its shapes: short or long names, corners, nested, a list."""
    names = (("l", "left", "x0"), ("t", "top", "y0"), ("r", "right", "x1"), ("b", "bottom", "y1"))

    def box(v: Column) -> Column:
        number = lambda p: _field(v, p).try_cast("double")

        def shape(sides: list[Column]) -> Column:
            whole = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull()
            return F.when(whole, F.struct(*[s.alias(n) for s, n in zip(sides, ("left", "top", "right", "bottom"), strict=True)], origin_name(_field(v, "coord_origin")).alias("coord_origin")))

        return F.coalesce(shape([number(n[0]) for n in names]), shape([F.coalesce(number(n[1]), number(n[2])) for n in names]), shape([number(f"$[{i}]") for i in range(4)]))

    return _first_of(F.transform(_at(item, ("$.prov[0].bbox", "$.prov[0].bbox.bbox", "$.prov.bbox", "$.prov.bbox.bbox", "$.provenance[0].bbox", "$.provenance.bbox", "$.bbox", "$.bbox.bbox")), box))


def json_in_text(text: Column) -> Column:
    """The JSON that a text holds: inside a code fence, else from the first brace or bracket to the last; null if none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1))
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def table_columns(columns: Column, rows: Column) -> Column:
    """The declared columns that rows (maps) have, then the others that they have."""
    there = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.map_keys(r))))
    declared = F.coalesce(columns, strings([]))
    return F.concat(F.array_distinct(F.filter(declared, lambda c: F.array_contains(there, c))), F.array_except(there, declared))


def table_markdown(columns: Column, rows: Column, none: str = "(No cleaned table rows available.)") -> Column:
    """A table of an array of maps in pipes, columns as wide as their longest cell, those of numbers to the right. Cells
    that a row lacks are "nan". (Decimal points are not aligned.)"""
    names = table_columns(columns, rows)

    def column(c: Column) -> Column:
        cells = F.transform(rows, lambda r: F.when(F.map_contains_key(r, c), F.coalesce(F.try_element_at(r, c), F.lit(""))).otherwise("nan"))
        width = F.greatest(F.length(c) + 2, F.array_max(F.transform(cells, lambda x: F.length(x))))
        number = F.forall(cells, lambda x: x.rlike(r"^[+-]?\d+(\.\d+)?$"))

        def padded(x: Column) -> Column:
            return F.when(number, F.lpad(x, width, F.lit(" "))).otherwise(F.rpad(x, width, F.lit(" ")))

        dashes = F.repeat(F.lit("-"), width + 1)
        rule = F.when(number, F.concat(dashes, F.lit(":"))).otherwise(F.concat(F.lit(":"), dashes))
        return F.struct(padded(c).alias("head"), rule.alias("rule"), F.transform(cells, padded).alias("cells"))

    made = F.transform(names, column)
    head = F.concat(F.lit("| "), F.array_join(F.transform(made, lambda m: m.head), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(made, lambda m: m.rule), "|"), F.lit("|"))
    body = F.transform(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.concat(F.lit("| "), F.array_join(F.transform(made, lambda m: F.get(m.cells, i)), " | "), F.lit(" |")))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, none).otherwise(F.array_join(F.concat(F.array(head, rule), body), "\n"))


def text_records(header: Column, rows: Column) -> Column:
    """Rows (arrays of texts) as maps by header; blank names become column_1, column_2, ..., missing cells are empty."""
    names = F.transform(header, lambda h, i: F.when(F.trim(F.coalesce(h, F.lit(""))) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(F.trim(h)))
    return F.transform(rows, lambda r: F.map_from_arrays(names, F.transform(names, lambda n, i: safe_text(F.get(r, i)))))
