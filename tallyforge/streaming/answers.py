"""The answer that counts of each search, over saved answers: one result a search, by the same rule for batches and streams.

A search (run, entity, family) has variants by priority (0 first). It is open for `wait` after its earliest answer; later ones are
left out. Of each variant the earliest answer counts (of equal times the least by label, query, error and entries), and the first
variant with entries wins. Answers without an entity only tell the time.

The stream gives a search's result when the watermark passes its end, not before, so it is the batch's whatever the order of
arrival within `late`. The state of an open search is an answer a variant; of a closed one a mark, for `keep`. The state of many
searches is kept together, in buckets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyforge.sources.saved_answers import ENTRIES

KEYS = ("run", "entity", "family")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is compared between answers of one variant, in this order.
ORDER = ("at_us", "label", "query", "error", "entries")
KEPT = "struct<priority: int, at_us: bigint, label: string, query: string, error: string, entries: string>"
CLOSED = f"run string, entity string, family string, first_us long, answers array<{KEPT}>"


def _flat(answers: DataFrame) -> DataFrame:
    return answers.filter("unreadable IS NULL").select(*KEYS, "at", "priority", F.unix_micros("at").alias("at_us"), "label", "query", "error", F.to_json("entries").alias("entries"))


def results(closed: DataFrame) -> DataFrame:
    """Of searches with their answers (by priority): priority, label, query and entries of the one that wins (null, empty texts,
    none), the attempts up to it, warnings and, where none wins, the last error."""
    a = F.col("answers")
    won = F.get(F.filter(a, lambda x: x.entries != "[]"), F.lit(0))
    tried = F.filter(a, lambda x: won.isNull() | (x.priority <= won.priority))
    rows = closed.withColumns({"won": won, "tried": tried})
    w, t = F.col("won"), F.col("tried")
    failed = F.transform(F.filter(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: x.error != ""), lambda x: F.concat(x.label, F.lit(" query failed; trying fallback")))
    used = F.when(w.priority > 0, F.array(F.concat(F.lit("used "), w.label, F.lit(" query fallback")))).otherwise(F.array().cast("array<string>"))
    errors = F.transform(F.filter(t, lambda x: x.error != ""), lambda x: x.error)
    attempts = F.transform(t, lambda x: F.struct(x.label.alias("label"), x.query.alias("query"), F.size(F.from_json(x.entries, ENTRIES)).alias("result_count"), x.error.alias("error")))
    return rows.select(
        *KEYS, F.timestamp_micros("first_us").alias("first_at"), w.priority.alias("priority"), F.coalesce(w.label, F.lit("")).alias("label"), F.coalesce(w.query, F.lit("")).alias("query"),
        F.coalesce(F.from_json(w.entries, ENTRIES), F.array().cast(ENTRIES)).alias("entries"), attempts.alias("attempts"), F.concat(failed, used).alias("warnings"),
        F.when(w.isNull(), F.coalesce(F.get(errors, F.size(errors) - 1), F.lit(""))).otherwise("").alias("error"),
    )


def first_answers(answers: DataFrame, wait_s: int) -> DataFrame:
    """Results of a table of answers. Two aggregations with partial sums: by variant, then by search (few variants)."""
    rows = _flat(answers).filter("entity <> ''")
    by_variant = rows.groupBy(*KEYS, "priority").agg(F.min(F.struct(*ORDER)).alias("a"))
    kept = F.array_sort(F.collect_list(F.struct("priority", *[F.col(f"a.{n}").alias(n) for n in ORDER])))
    closed = by_variant.groupBy(*KEYS).agg(F.min("a.at_us").alias("first_us"), kept.alias("answers"))
    return results(closed.withColumn("answers", F.filter("answers", lambda x: x.at_us <= F.col("first_us") + wait_s * 1_000_000)))


class _Searches(StatefulProcessor):
    """The searches of a bucket. Its state is read and written once a batch, whatever the number of its searches, and it has one
    timer: the time at which the first of them ends, or the first mark goes."""

    def __init__(self, wait_s: int, keep_s: int):
        self.wait, self.keep = wait_s * 1000, keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the timer that is set (ms), open searches with an answer a variant, and closed ones with the time up to which (ms) they are marked
        self.bucket = handle.getValueState("bucket", "timer_ms long, open string, closed string")

    def _read(self) -> tuple[int | None, dict[tuple, dict[int, tuple]], dict[tuple, int]]:
        held = self.bucket.get()
        if held is None:
            return None, {}, {}
        open_ = {tuple(k): {p: tuple(m) for p, *m in kept} for k, kept in json.loads(held[1])}
        return held[0], open_, {tuple(k): until for k, until in json.loads(held[2])}

    def _write(self, timer: int | None, open_: dict[tuple, dict[int, tuple]], closed: dict[tuple, int]) -> None:
        """Keeps what is there; `timer` is one that is still set."""
        due = min([*map(self._end, open_.values()), *closed.values()], default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.bucket.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        shown = [[k, [[p, *m] for p, m in kept.items()]] for k, kept in open_.items()]
        self.bucket.update((due, json.dumps(shown, ensure_ascii=False), json.dumps(list(closed.items()), ensure_ascii=False)))

    def _end(self, kept: dict[int, tuple]) -> int:
        """The first millisecond at which no answer that counts can still come."""
        return min(m[0] for m in kept.values()) // 1000 + self.wait + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, open_, closed = self._read()
        for r in rows:
            search, priority, mine = tuple(r[n] for n in KEYS), r["priority"], tuple(r[n] for n in ORDER)
            if search[1] == "" or search in closed:
                continue
            kept = open_.setdefault(search, {})
            if priority not in kept or mine < kept[priority]:
                kept[priority] = mine
        self._write(timer, open_, closed)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, open_, closed = self._read()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        closed = {k: until for k, until in closed.items() if until > now}
        for search in [k for k, kept in open_.items() if self._end(kept) <= now]:
            kept = sorted((p, *m) for p, m in open_.pop(search).items())
            first = min(k[1] for k in kept)
            closed[search] = now + self.keep
            yield Row(run=search[0], entity=search[1], family=search[2], first_us=first, answers=[k for k in kept if k[1] <= first + self.wait * 1000])
        self._write(None, open_, closed)

    def close(self) -> None:
        pass


def first_answers_stream(answers: DataFrame, wait_s: int, late: str = "10 minutes", keep_s: int = 86_400, buckets: int = 1024) -> DataFrame:
    """Results of a stream of answers (`parsed`), each once. Start it within `rocks`. Searches are dealt over `buckets` by a hash:
    a call for each bucket and batch, not for each search. A started stream keeps its number of buckets."""
    rows = _flat(answers).withWatermark("at", late)
    rows = rows.select(F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket"), *KEYS, "priority", *ORDER, "at")
    closed = rows.groupBy("bucket").transformWithState(_Searches(wait_s, keep_s), CLOSED, "Append", "EventTime")
    return results(closed)


@contextmanager
def rocks(spark: SparkSession):
    """Queries started here keep their state in RocksDB, as keyed state with timers needs; the setting is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_available(results: DataFrame, out: str, checkpoint: str) -> None:
    """Appends the results of what is there to a Parquet table, and stops; the checkpoint says where the next call goes on.

    Searches that the last answers end are given by a batch without data, which a trigger of what is available makes for no source
    in Python; so the query runs until it has nothing to do.
    """
    with rocks(results.sparkSession):
        query = results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
