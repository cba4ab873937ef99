"""Corpus pipeline: quality, toxicity, near-duplicates, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs; then what the stage worked with, and the docs before it, are deleted. All but the last return the columns
of documents; the last returns the sampled segmentations (doc_id, sample, n_pieces, log_prob, perturbed, inclusion, ids).
The classifiers' labels come from the labels table in sf_dir.

Cases: null and empty texts go through all stages, and come out of the last with one empty segmentation; texts of any length
are read whole; rows with null doc_ids are never duplicates of others and draw like one id in mixing; of repeated rows one stays;
ties go to the smallest doc_id and text hash; an empty table gives an empty one; other columns, of any names, stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import new_dir, remove_dir, scratch, table
from tallyforge.llm.mixing import mix
from tallyforge.llm.near_dup import keep_one
from tallyforge.llm.piece_sampling import sample_segmentations
from tallyforge.llm.quality import keep_quality
from tallyforge.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, table(spark, sf_dir, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Trained classifiers and sampling are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = new_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        if before is not None:
            remove_dir(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
