"""Licence scan by diagonal voting, in DataFrame functions only.

Every rolling k-gram hash of a text's words is joined to the positions of the same k-gram in the licence
templates. A hit votes for the diagonal (word position less template position); votes are summed by diagonal,
diagonals of a long template that lie within SLACK words of each other are merged (insertions and deletions
shift the diagonal), and a span is verified: the k-grams of each hit are compared as words, not as hashes, and
enough of the template's k-grams must be there.

Short phrases use k = 2 and must be complete on one diagonal; bodies use k = 4 and COVERAGE of their k-grams.

The templates are a fixed list, so the template side of the join is broadcast with a proven bound. One row for
each text goes with the hits as a sentinel, so texts are read once and never shuffled. Rows are kept apart
by doc_id and two 64-bit hashes of the text; equal rows are counted and come back as often as they came.

Cases: null and empty texts have no words, no places and score 0; null doc_ids are a value like another; texts
of any length are scanned whole; repeated rows give repeated rows; an empty table gives an empty one; other
columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallyforge.llm.common import doc_text

#: Diagonals of one body this near to each other are one span.
SLACK = 6
#: The part of a body's k-grams that a span must have.
COVERAGE = 0.6

#: label, phrase, whether it is one of the three base phrases.
PHRASES = [
    ("mit", "mit license", True),
    ("apache", "apache license", True),
    ("gpl", "general public license", True),
    ("apache-2.0", "apache license version 2 0", False),
    ("gpl-2.0", "gnu general public license version 2", False),
    ("gpl-3.0", "gnu general public license version 3", False),
    ("lgpl", "lesser general public license", False),
    ("agpl", "affero general public license", False),
    ("mpl", "mozilla public license", False),
    ("epl", "eclipse public license", False),
    ("bsd", "bsd license", False),
    ("isc", "isc license", False),
    ("bsl", "boost software license", False),
    ("cc-by", "creative commons attribution", False),
]

#: label, licence wording as published (fixed values).
BODIES = [
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "apache-text",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "gpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mpl-text",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SENTINEL = -1


def words(text: str) -> list[str]:
    """The words of a text, as the scan takes them (for templates and tests)."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_rows() -> list[tuple[int, str, bool, int, int, int, str]]:
    """template, label, base, k, number of k-grams, position of the k-gram, its words."""
    rows = []
    for t, (label, text, base, k) in enumerate([(a, b, c, 2) for a, b, c in PHRASES] + [(a, b, False, 4) for a, b in BODIES]):
        w = words(text)
        n = len(w) - k + 1
        rows += [(t, label, base, k, n, i, " ".join(w[i : i + k])) for i in range(n)]
    return rows


def _gram_hash(w: list[Column], k: Column) -> Column:
    return F.when(k == 2, F.xxhash64(F.lit(2), w[0], w[1])).otherwise(F.xxhash64(F.lit(4), *w))


def templates(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("k", T.IntegerType()), T.StructField("grams", T.IntegerType()), T.StructField("tpos", T.IntegerType()), T.StructField("gram", T.StringType())]
    )
    rows = spark.createDataFrame(template_rows(), schema)
    part = F.split("gram", " ")
    w = [F.get(part, F.lit(i)) for i in range(4)]
    none = spark.createDataFrame([(_SENTINEL, None, False, 0, 1, 0, "")], schema).withColumn("hash", F.lit(0).cast("long"))
    return rows.withColumn("hash", _gram_hash(w, F.col("k"))).unionByName(none)


def _hits(docs: DataFrame) -> DataFrame:
    """One row for each k-gram of each text that a template has, and one sentinel for each row of docs."""
    part = F.split("text", BETWEEN, -1)
    first = F.when(F.get("part", F.lit(0)) == "", 1).otherwise(0)
    final = F.when(F.element_at("part", -1) == "", 1).otherwise(0)
    rows = (
        doc_text(docs)
        .select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), part.alias("part"))
        .select("doc_id", "h1", "h2", F.slice("part", first + 1, F.greatest(F.size("part") - first - final, F.lit(0))).alias("w"))
    )
    # even entries stand for k = 2, odd ones for k = 4, the last one is the sentinel
    each = rows.select("*", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(0), F.size("w") * 2)).alias("i"))
    at = (F.col("i") / 2).cast("int")
    pos = F.when(F.col("i") == F.col("n_words") * 2, F.lit(_SENTINEL)).otherwise(at)
    low = [F.lower(F.get("w", at + j)) for j in range(4)]
    k = F.when(F.col("i") % 2 == 0, 2).otherwise(4)
    fits = at + k <= F.col("n_words")
    each = each.select("doc_id", "h1", "h2", "w", "n_words", pos.alias("pos"), F.when(pos == _SENTINEL, F.lit(0).cast("long")).when(fits, _gram_hash(low, k)).alias("hash"))
    hit = each.join(F.broadcast(templates(docs.sparkSession)), "hash")
    same = F.translate(F.array_join(F.slice("w", F.col("pos") + 1, F.col("k")), " "), UPPER, LOWER) == F.col("gram")
    return hit.filter(F.when(F.col("template") == _SENTINEL, F.col("pos") == _SENTINEL).otherwise((F.col("pos") >= 0) & same))


def _spans(docs: DataFrame) -> DataFrame:
    key = ["doc_id", "h1", "h2"]
    votes = (
        _hits(docs)
        .withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy(*key, "n_words", "template", "label", "base", "k", "grams", "diagonal")
        .agg(F.collect_set("tpos").alias("tposs"), F.count("*").alias("copies"))
        .repartition(*key)
    )
    by_template = W.Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.when((F.col("k") == 4) & (F.col("diagonal") - F.lag("diagonal").over(by_template) <= SLACK), 0).otherwise(1)
    merged = (
        votes.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(by_template))
        .groupBy(*key, "n_words", "template", "label", "base", "k", "grams", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("tposs"))).alias("got"), F.min("diagonal").alias("d0"), F.max("diagonal").alias("d1"), F.max("copies").alias("copies"))
        .withColumn("coverage", F.size("got") / F.col("grams"))
    )
    return merged.withColumn("verified", (F.col("template") >= 0) & (F.col("coverage") >= F.when(F.col("k") == 4, COVERAGE).otherwise(1.0)))


def license_spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, label, first_word, last_word (of the span), coverage."""
    return _spans(docs).filter("verified").select("doc_id", "label", (F.col("d0") + F.array_min("got")).alias("first_word"), (F.col("d1") + F.array_max("got") + F.col("k") - 1).alias("last_word"), "coverage")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    base = F.col("verified") & F.col("base")

    def names(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    out = (
        _spans(docs)
        .groupBy("doc_id", "h1", "h2")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("d0"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("d0"))).cast("long").alias("last_word"),
            names(base).alias("base_labels"),
            names(F.col("verified")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("coverage"))), F.lit(0.0)).alias("score"),
            F.max(F.when(F.col("template") == _SENTINEL, F.col("copies"))).alias("copies"),
        )
    )
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_scan_sql() -> str:
    """The same result by plain word comparison, for DuckDB."""
    values = ",\n".join(f"({t}, '{label}', {str(base).lower()}, {k}, {n}, {i}, '{gram}')" for t, label, base, k, n, i, gram in template_rows())
    return f"""
WITH tpl(template, label, base, k, grams, tpos, gram) AS (VALUES {values}),
w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws
  FROM documents
),
p AS (SELECT rid, ws, unnest(range(len(ws))) AS pos FROM w),
g AS (
  SELECT rid, pos, 2 AS k, array_to_string(ws[pos + 1 : pos + 2], ' ') AS gram FROM p WHERE pos + 2 <= len(ws)
  UNION ALL
  SELECT rid, pos, 4, array_to_string(ws[pos + 1 : pos + 4], ' ') FROM p WHERE pos + 4 <= len(ws)
),
hit AS (SELECT rid, template, label, base, tpl.k, grams, tpos, pos - tpos AS diagonal FROM g JOIN tpl USING (k, gram)),
dist AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal, tpos) AS gap FROM hit),
isl AS (
  SELECT *, sum(CASE WHEN gap IS NOT NULL AND (gap = 0 OR k = 4 AND gap <= {SLACK}) THEN 0 ELSE 1 END) OVER (PARTITION BY rid, template ORDER BY diagonal, tpos) AS span
  FROM dist
),
s AS (
  SELECT rid, template, label, base, k, span, min(diagonal) AS d0, count(DISTINCT tpos) / any_value(grams)::DOUBLE AS coverage
  FROM isl GROUP BY rid, template, label, base, k, span
),
v AS (SELECT *, coverage >= (CASE WHEN k = 4 THEN {COVERAGE} ELSE 1.0 END) AS verified FROM s),
a AS (
  SELECT rid, count(*) FILTER (verified AND base) AS n_base, min(d0) FILTER (verified AND base) AS first_word,
    max(d0) FILTER (verified AND base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(coverage) AS score
  FROM v GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN a USING (rid)
"""
