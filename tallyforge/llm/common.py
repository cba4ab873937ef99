"""Helpers shared by the corpus operators: input shaping, shared storage, hashing of words in numpy.

Cases: null texts count as empty; words of texts of any length are hashed whole; numbered columns clash with no names, whatever
these hold; joins that deal hot keys keep every row, also of keys that one side lacks (they drop out, as in any inner join);
tables without rows are written and read like others.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one Arrow batch; texts are long, and both the JVM and the worker hold whole batches.
ROWS_A_BATCH = 1000


def modest_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's rows of an Arrow batch to ROWS_A_BATCH where they are more."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS_A_BATCH:
        conf.set(key, str(ROWS_A_BATCH))
    return df


def doc_text(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), and nothing else that could clash with what an operator adds."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column, as schema strings name it."""
    return df.select(column).schema[0].dataType.simpleString()


# ---- columns that are passed on --------------------------------------------------------


def numbered(names: Iterable[str]) -> list[Column]:
    """Columns under the names c0, c1, ..., which clash with nothing, whatever they are called outside."""
    return [F.col("`" + n.replace("`", "``") + "`").alias(f"c{i}") for i, n in enumerate(names)]


def renamed(names: Iterable[str]) -> list[Column]:
    """Numbered columns under their own names again."""
    return [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]


# ---- storage that all executors share --------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary folder if Spark runs on this machine alone
    (tests); on a cluster an error, as executors would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} it must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", where)
        atexit.register(_remove, where)
    return where.rstrip("/")


def _remove(where: str) -> None:
    import shutil

    shutil.rmtree(where.removeprefix("file://"), ignore_errors=True)


#: Folders handed out by new_dir inside of `scratch`, by nesting; for each thread.
_open = threading.local()
_apps: set[str] = set()


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_dir(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one. What is left of an application's folders goes when its driver ends."""
    app = f"{shared_dir(spark)}/tallyforge-{spark.sparkContext.applicationId}"
    if app not in _apps:
        fs, path = _path(spark, app)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _apps.add(app)
    at = f"{app}/{label}-{uuid.uuid4().hex}"
    if getattr(_open, "made", None):
        _open.made[-1].append(at)
    return at


def remove_dir(spark: SparkSession, where: str) -> None:
    fs, path = _path(spark, where)
    fs.delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Deletes at its end the folders made inside, but for those of the materialised tables given to what it yields."""
    kept: set[str] = set()
    if not hasattr(_open, "made"):
        _open.made = []
    _open.made.append([])
    try:
        yield lambda *tables: kept.update(filter(None, map(_folder, tables)))
    finally:
        made = _open.made.pop()
        for where in made:
            if where not in kept:
                remove_dir(spark, where)
        if _open.made:
            _open.made[-1].extend(w for w in made if w in kept)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and outlives executors. What `counted` gives of it is noted
    while it is written, so that no other job has to read the table for it."""
    spark = df.sparkSession
    at, seen = new_dir(spark, label), Observation()
    df.observe(seen, *_numbers(df)).write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._tallyforge_folder, out._tallyforge_seen = at, seen
    return out


def _numbers(df: DataFrame) -> list[Column]:
    own = dict(df.dtypes).get("n") in ("int", "bigint", "double")
    return [F.count(F.lit(1)).alias("rows"), *([F.sum("n").alias("total"), F.max("n").alias("most")] if own else [])]


#: Seconds to wait for what was noted; Spark's listeners may lose it where events are too many.
NOTED_S = 20


def counted(df: DataFrame) -> tuple[int, int, int]:
    """The rows of df, and the sum and the largest value of its column n (0 if it has none, or no rows): as noted when df was
    materialised; a job counts them where df is no such table or nothing was noted."""
    seen, found = getattr(df, "_tallyforge_seen", None), {}
    if seen is not None:
        waiting = threading.Thread(target=lambda: found.update(seen.get), daemon=True)
        waiting.start()
        waiting.join(NOTED_S)
    got = dict(found) or df.agg(*_numbers(df)).first().asDict()
    return got["rows"], got.get("total") or 0, got.get("most") or 0


def _folder(df: DataFrame) -> str | None:
    return getattr(df, "_tallyforge_folder", None)


def discard(df: DataFrame) -> None:
    """Drop the files of a materialised table that nothing reads any more."""
    where = _folder(df)
    if where:
        remove_dir(df.sparkSession, where)


def broadcast_if_small(side: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint only where the counted rows keep to a stated bound; otherwise a shuffled join."""
    return F.broadcast(side) if rows <= most else side


#: Rows of one key up to which a join leaves them to one task, and keys that may have more (see join_dealt).
HOT_ROWS, HOT_KEYS = 256, 50_000


def join_dealt(rows: DataFrame, side: DataFrame, key: str, by: str, of: DataFrame | None = None) -> DataFrame:
    """rows joined with side (a materialised table of one row a key, whose column n counts the key's rows) on key.
    of: that table, where side is a selection from it with the same rows and n.

    The rows of a hot key are dealt over parts, by a hash of the column `by`, and the key's row of side goes to each
    part, so no task gets all of them. A key is hot beyond HOT_ROWS rows and the HOT_KEYS-th part of all rows: there
    are HOT_KEYS hot keys at most, which proves the bound of their broadcast.
    """
    _, total, most = counted(side if of is None else of)
    least = max(HOT_ROWS, total // HOT_KEYS)
    if most <= least:
        return rows.join(side.drop("n"), key)
    parts = F.ceil(F.col("n") / least).cast("int")
    hot = side.filter(F.col("n") > least).select(key, parts.alias("_parts"))
    own = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    spread = side.withColumn("_part", F.explode(F.when(F.col("n") > least, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))).drop("n")
    return own.join(spread, [key, "_part"]).drop("_part")


# ---- words as hashes, in numpy ---------------------------------------------------------

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that end a word where words are runs without ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes that end a word where words are runs of 0-9, a-z and all beyond ASCII (after LOWER).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, _PIECE + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits (multiply and shift, three rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a batch of texts: their hashes, in order; text i has words offsets[i]:offsets[i+1].

    prefixes: for each asked byte length, the hash of a word's first so many bytes.
    """

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, prefixes: list[np.ndarray]):
        self.hashes, self.offsets, self.prefixes = hashes, offsets, prefixes


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    if at is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def words_of(texts: pa.Array, ends_word: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Hash every word of every text, whole texts, in pieces of about a megabyte cut between words."""
    body, ends = text_buffers(texts)
    hashes, starts_all, heads = [], [], [[] for _ in prefixes]
    at = 0
    while at < len(body):
        to = min(at + _PIECE, len(body))
        if to < len(body):
            to = _cut(body, at, to, ends, ends_word)
        begin, h, pre = _piece(body[at:to], ends[np.searchsorted(ends, at) : np.searchsorted(ends, to)] - at, ends_word, prefixes)
        hashes.append(h)
        starts_all.append(begin + at)
        for keep, p in zip(heads, pre, strict=True):
            keep.append(p)
        at = to
    none = np.zeros(0, np.uint64)
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else none, np.searchsorted(starts, ends), [np.concatenate(k) if k else none for k in heads])


def _cut(body: np.ndarray, at: int, to: int, ends: np.ndarray, ends_word: np.ndarray) -> int:
    """A place up to `to`, or the first one after it, where no word is cut."""
    k = np.searchsorted(ends, to, "right") - 1
    back = 1 << 12
    while back <= to - at:
        found = np.flatnonzero(ends_word[LOWER[body[to - back : to]]])
        if len(found):
            return max(to - back + int(found[-1]) + 1, int(ends[k]) if ends[k] > at else 0)
        back <<= 2
    if ends[k] > at:
        return int(ends[k])
    while to < len(body) and to < ends[k + 1] and not ends_word[LOWER[body[to]]]:
        to += 1
    return to


def _piece(raw: np.ndarray, begins: np.ndarray, ends_word: np.ndarray, prefixes: tuple[int, ...]):
    low = LOWER[raw]
    gap = ends_word[low]
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    begins = begins[begins < len(raw)]
    first[begins] = ~gap[begins]
    inner = begins[begins > 0] - 1
    last[inner] = ~gap[inner]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    base, back = sums[starts], down[starts]
    out = mix((sums[stops] - base) * back)
    return starts, out, [mix((sums[np.minimum(starts + n, stops)] - base) * back + np.uint64(n)) for n in prefixes]


# ---- Arrow batches ---------------------------------------------------------------------


def arrow_map(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], most_bytes: int = 4 << 20, done: Callable[[], None] | None = None):
    """For mapInArrow: work gets batches of a bounded number of text bytes (one text at least).

    At the end of a task `done` is called and free memory goes back to the system: a worker outlives its tasks, and
    what it holds counts against the executor in the tasks of other operators.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in bounded(batch, most_bytes):
                    out = work(part)
                    if out is not None:
                        yield out
        finally:
            if done is not None:
                done()
            release_memory()

    return run


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def bounded(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with up to so many bytes of text each."""
    if not batch.num_rows:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
