"""Runs of words that repeat with a period, by comparing the word numbers with themselves at every lag.

A run is a maximal stretch of at least MIN_EXP periods and MIN_LENGTH words in which words one period apart are equal.
At lag q the numbers are compared with those q places on, as one vector; each stretch of equal places of at least
max(MIN_LENGTH - q, (MIN_EXP - 1) q) is a stretch with period q. Lags up to n / MIN_EXP are tried, many at once where a
text is short. A stretch found at several lags has the least of them as its period: with three periods at least, any
smaller period divides it and ends at the same places.

The work for n words grows with n squared, so texts of more than LAGS lags are dealt out as (text, range of lags): each
range goes to a task of its own, what it found meets again by text. Shorter texts are scanned where they are read.

Words are numbered for each text, so equal numbers are equal words. For comparison, a tenth of the texts, told by a
checksum of their id, first get their words from a place on replaced by repeats of the words there (`planted`).

Cases: null and empty texts, and those without words, have no runs, four nulls, and digests of nothing; texts of any
length are scanned whole; rows with null doc_id are scanned without repeats planted; repeated rows give a row each; of
runs with one exponent the first start, then the least period, is named; an empty table gives an empty one; other columns, of
any names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_map, doc_text, kind_of, materialise, modest_batches, scratch

MIN_LENGTH, MIN_EXP = 24, 3
#: Lags of one range; texts with more are dealt over tasks.
LAGS = 4096
#: Places compared at once (one byte each).
CELLS = 1 << 19

#: What parts words, in Java's writing; Python's bytes.split() parts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers from 1, the same for equal words only."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen) + 1) for w in words), np.int64, len(words))
    return ids.astype(np.uint8 if len(seen) < 256 else np.uint16 if len(seen) < 65536 else np.uint32)


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words, from a place on replaced by repeats where the checksum of the id says so."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


def least(q: np.ndarray | int) -> np.ndarray:
    """Equal places in a row that make a run at lag q."""
    return np.maximum(MIN_LENGTH - q, (MIN_EXP - 1) * q)


def _stretches(equal: np.ndarray, q: int) -> np.ndarray:
    """start, length, period of the long enough stretches of equal places at lag q."""
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, size = edges[::2], edges[1::2] - edges[::2]
    good = size >= least(q)
    return np.stack([start[good], size[good] + q, np.full(int(good.sum()), q)], 1)


def scan(ids: np.ndarray, first: int, last: int, cells: int = CELLS) -> np.ndarray:
    """start, length, period of all stretches at the lags from first to last."""
    n = len(ids)
    last = min(last, n // MIN_EXP)
    found = [np.zeros((0, 3), np.int64)]
    if n < MIN_LENGTH or first > last:
        return found[0]
    at_once = cells // n
    if at_once < 8:
        equal = np.empty(n, bool)
        for q in range(first, last + 1):
            now = np.equal(ids[q:], ids[: n - q], out=equal[: n - q])
            if np.count_nonzero(now) >= least(q):
                found.append(_stretches(now, q))
        return np.concatenate(found)
    # 0 is no word's number: places beyond the end are equal to none
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.zeros(last, ids.dtype)]), n)
    for q0 in range(first, last + 1, at_once):
        lags = np.arange(q0, min(q0 + at_once, last + 1))
        equal = shifted[q0 : q0 + len(lags)] == ids
        for k in np.flatnonzero(equal.sum(1, dtype=np.int32) >= least(lags)):
            found.append(_stretches(equal[k], int(lags[k])))
    return np.concatenate(found)


def runs_of(found: np.ndarray) -> np.ndarray:
    """Of stretches, the runs: one period, the least, for each start and length; by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    lines = b"".join(b"%d,%d,%d\n" % (s, m, q) for s, m, q in runs.tolist())
    best: tuple = (None, None, None, None)
    kept = words
    if len(runs):
        start, length, period = runs.T
        # division is rightly rounded, so fractions of fewer than 10**8 words compare as they are
        s, m, q = runs[np.lexsort((period, start, -(length / period)))[0]].tolist()
        best = (s, m, q, 1000 * m // q)
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, start + period, 1)
        np.add.at(inside, start + length, -1)
        kept = list(itertools.compress(words, (np.cumsum(inside[:-1]) == 0).tolist()))
    return len(runs), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2


def _result(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([ids, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]], ["doc_id", *FIELDS])


def _words(batch: pa.RecordBatch, plant: bool) -> list[list[bytes]]:
    texts = [t.split() for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
    ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
    return [planted(d, w) for d, w in zip(ids, texts, strict=True)] if plant else texts


def find_runs(docs: DataFrame, plant: bool = True, lags: int = LAGS, cells: int = CELLS) -> DataFrame:
    """doc_id and FIELDS for each row of docs; plant: with repeats planted in a tenth of the texts."""
    kind = f"doc_id {kind_of(docs, 'doc_id')}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    # a text has at most one word for every two bytes; the longer ones have theirs counted
    many = F.when(F.octet_length("text") > 2 * MIN_EXP * lags, F.regexp_count("text", F.lit(WORD))).otherwise(0)
    counted = doc_text(modest_batches(docs)).withColumn("ranges", F.ceil(F.floor(many / MIN_EXP) / lags).cast("int"))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _result(batch.column(0), [digest(w, runs_of(scan(word_ids(w), 1, len(w), cells))) for w in _words(batch, plant)])

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan(word_ids(w), 1 + k * lags, (k + 1) * lags, cells) for w, k in zip(_words(batch, plant), batch.column(3).to_pylist(), strict=True)]
        rows = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
        return pa.record_batch([pa.array(rows), *map(pa.array, np.concatenate(found).T)], ["row", "start", "length", "period"])

    def meet(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = [np.array([(r["start"], r["length"], r["period"]) for r in x or ()], np.int64).reshape(-1, 3) for x in batch.column(2).to_pylist()]
        return _result(batch.column(0), [digest(w, runs_of(r)) for w, r in zip(_words(batch, plant), runs, strict=True)])

    short = counted.filter("ranges <= 1").select("doc_id", "text").mapInArrow(arrow_map(whole, 4 << 20), kind)
    with scratch(docs.sparkSession) as keep:
        # a number of its own for each row, which the table makes lasting
        long = materialise(counted.filter("ranges > 1").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "ranges"), "long-texts")
        keep(long)
    ranges = long.select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range")).repartition("row", "range")
    found = ranges.mapInArrow(arrow_map(part, 1 << 20), "row long, start long, length long, period long")
    runs = found.groupBy("row", "start", "length").agg(F.min("period").alias("period")).groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    joined = long.select("row", "doc_id", "text").join(runs.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "runs")
    return short.unionAll(joined.mapInArrow(arrow_map(meet, 1 << 20), kind))
