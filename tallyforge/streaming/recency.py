"""Streaming forms: windowed signal counts with a watermark, a stateful last-seen tier, cache refresh by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.tables import staleness


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by type and window; state is dropped once the watermark is past a window."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def last_seen(events: DataFrame) -> DataFrame:
    """user_id, last_ts, n after each micro-batch; the state of a user is two numbers."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (0, 0)
        for part in batches:
            last = max(last, int(part.ts.max().timestamp() * 1_000_000))
            n += len(part)
        state.update((last, n))
        yield pd.DataFrame({"user_id": [key[0]], "last_ts": [pd.Timestamp(last, unit="us")], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(work, "user_id long, last_ts timestamp, n long", "last long, n long", "update", GroupStateTimeout.NoTimeout)


def refresh_cache(texts: DataFrame, cache: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], checkpoint: str):
    """Each micro-batch's texts whose hash is not the cached one go to `write`, with their new hash."""

    def batch(rows: DataFrame, _: int) -> None:
        write(staleness(rows, cache(), keys).filter("reason <> 'up_to_date'"))

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
