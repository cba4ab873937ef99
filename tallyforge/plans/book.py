"""A book of registered queries: each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scanned table, dealt over all cores where its files make fewer partitions than there are cores: for Python work on small
    files. Larger tables stay as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_any(text: str, words) -> str:
    """SQL: whether a text has any of the words."""
    return "(" + " OR ".join(f"contains({text}, {quoted([w])})" for w in words) + ")"


def sql_hits(text: str, words) -> str:
    """SQL: how many of the words a text has."""
    return "(" + " + ".join(f"contains({text}, {quoted([w])})::INT" for w in words) + ")"
