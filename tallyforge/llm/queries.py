"""The registered queries over this subpackage's operators: one thin query for each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.bit_slices import simhash_components
from tallyforge.llm.common import table
from tallyforge.llm.license_scan import license_scan
from tallyforge.llm.media import store_and_digest
from tallyforge.llm.mixing import mixing_rates
from tallyforge.llm.near_dup import near_duplicates
from tallyforge.llm.periodic_runs import find_runs
from tallyforge.llm.piece_sampling import sampling_digest
from tallyforge.llm.quality import score_quality
from tallyforge.llm.quote_threads import quote_digest
from tallyforge.llm.row_pattern import match_rows
from tallyforge.llm.token_counts import count_tokens
from tallyforge.llm.toxicity import score_toxicity
from tallyforge.llm.vector_search import top_k


def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_digest(table(spark, sf_dir, "conversations"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_digest(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op13_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rows(table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_piece_sampling, op2_mixing, op3_quote_threads, op4_media_columns, op5_license_scan, op6_token_counts, op7_quality, op8_toxicity, op9_minhash_near_dedup, op10_exact_top_k, op11_periodic_runs, op12_simhash_near_dedup, op13_row_pattern)}
