"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tallyforge", master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; shuffle partitions only where given (AQE joins small ones)."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in more.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
