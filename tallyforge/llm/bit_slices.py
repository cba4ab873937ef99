"""SimHash near-duplicates: fingerprints of 64 bits, linked at few differing bits by bit-sliced comparison.

Rows with one fingerprint form a class at once. Fingerprints that differ in up to `radius` bits agree in two of radius + 2
parts of their bits at least, so each class goes into a bucket for every pair of parts, and only buckets that hold several
classes are read on. A bucket of more than BUCKET classes is not compared: its classes go to finer buckets, in the same
way by the bits that are still free, until few bits are free, which bounds the bucket (radius 2: 64, 32, 16, then 8 free bits,
256 classes). So no bucket is cut off, and none grows with the data.

Whole buckets are dealt over tiles. A tile holds its fingerprints as bit planes, 64 fingerprints a word: bit b of all of
them stands in plane b. A query is compared with 64 at once: the planes that differ are added up in carry-save counters, one
word for each binary digit of the distance and one for what has run over. Every PLANES planes, words in which all 64
are beyond the radius are abandoned. Of the links in a tile only those from each fingerprint to the least one reached go on.

Cases: null and empty texts, and texts without words, have fingerprint zero and are linked like others; shorter texts are one
shingle; texts of any length are hashed whole; rows with null doc_id are not linked, with component_id null; repeated
rows and rows with equal doc_id are rows of their own; a component's smallest doc_id names it; an empty table gives an
empty one; other columns, of any names, are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyforge.llm.common import arrow_map, doc_text, join_dealt, kind_of, materialise, modest_batches, scratch
from tallyforge.llm.near_dup import components

BITS, SEED, SHINGLE = 64, 42, 3
#: Classes of a bucket that is compared as it is, and classes of a tile, on average.
BUCKET, TILE = 1024, 4096
#: Planes added up between two looks at what is still within the radius.
PLANES = 8
#: Free bits at which buckets get no finer.
FEW_BITS = 8
#: Shingles whose bits are counted at once.
HASHES = 1 << 14

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints ----------------------------------------------------------------------


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(line, SEED)] if words else [], np.uint64)
    at = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    return np.fromiter((xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(at, at[SHINGLE:], strict=False)), np.uint64, len(words) - SHINGLE + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHES):
        counts += _bits(hashes[at : at + HASHES]).sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _bits(x: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row of docs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return doc_text(modest_batches(docs)).mapInArrow(arrow_map(work, 4 << 20), f"doc_id {kind_of(docs, 'doc_id')}, fp long")


# ---- bit planes ------------------------------------------------------------------------


def planes_of(x: np.ndarray) -> np.ndarray:
    """64 planes of the fingerprints, 64 fingerprints a word."""
    bits = _bits(x)
    full = np.zeros((-(-len(x) // 64) * 64, BITS), np.uint8)
    full[: len(x)] = bits
    return np.packbits(np.ascontiguousarray(full.T), axis=1, bitorder="little").view(np.uint64)


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """The bits whose count is more than the radius."""
    more, same = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def near_pairs(x: np.ndarray, radius: int, queries: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all pairs that differ in up to radius bits."""
    n, planes = len(x), planes_of(x)
    words = planes.shape[1]
    pad = np.zeros(words, np.uint64)
    if n % 64:
        pad[-1] = _ALL << np.uint64(n % 64)
    fill = np.where(_bits(x), _ALL, np.uint64(0))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q0 in range(0, n, queries):
        # a query meets the words from its own on
        own = np.arange(q0, min(q0 + queries, n))
        q = np.repeat(own, words - own // 64)
        w = np.concatenate([np.arange(i // 64, words) for i in own.tolist()])
        counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = pad[w]
        for b0 in range(0, BITS, PLANES):
            for b in range(b0, b0 + PLANES):
                carry = planes[b, w] ^ fill[q, b]
                for c in counters:
                    held = c & carry
                    c ^= carry
                    carry = held
                over |= carry
            over = _beyond(counters, over, radius)
            alive = np.flatnonzero(over != _ALL)
            if len(alive) < len(q):
                q, w, over, counters = q[alive], w[alive], over[alive], [c[alive] for c in counters]
            if not len(q):
                break
        near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(near)
        i, j = q[row], w[row] * 64 + bit
        left.append(i[i < j])
        right.append(j[i < j])
    return np.concatenate(left), np.concatenate(right)


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places, the least that links (i, j) reach."""
    to = np.arange(n)
    while True:
        now = to.copy()
        low = np.minimum(to[i], to[j])
        for side in (i, j):
            np.minimum.at(now, side, low)
            np.minimum.at(now, to[side], low)
        now = now[now]
        if (now == to).all():
            return to
        to = now


# ---- buckets ---------------------------------------------------------------------------


def finer(mask: int, radius: int) -> list[int]:
    """The masks that take two more parts of the free bits; of them one at least hides no difference of up to radius bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    parts = [sum(1 << int(b) for b in p) for p in np.array_split(free, radius + 2)]
    return [mask | p | q for p, q in itertools.combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(classes: DataFrame, radius: int = 2, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints fp of classes that are near each other."""
    spark = classes.sparkSession
    masks, links = finer(0, radius), None
    rows = classes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        # buckets with one hash are compared together: more pairs, no fewer
        rows = rows.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
        shared = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        last = BITS - masks[0].bit_count() <= max(FEW_BITS, radius + 1)
        small = shared if last else shared.filter(F.col("n") <= bucket)
        total = small.agg(F.sum("n")).first()[0] or 0
        if total:
            found = _in_tiles(join_dealt(rows.select("bucket", "fp"), small, "bucket", "fp"), -(-total // tile), radius)
            found = materialise(found, "near")
            links = found if links is None else links.unionAll(found)
        if last:
            break
        hot = shared.filter(F.col("n") > bucket)
        if hot.isEmpty():
            break
        next_ = {m: finer(m, radius) for m in masks}
        by_mask = F.create_map(*itertools.chain.from_iterable((F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in own])) for m, own in next_.items()))
        rows = materialise(join_dealt(rows, hot, "bucket", "fp").select("fp", F.explode(by_mask[F.col("mask")]).alias("mask")), "finer")
        masks = sorted(set(itertools.chain.from_iterable(next_.values())))
    return spark.createDataFrame([], "a long, b long") if links is None else links


def _in_tiles(rows: DataFrame, tiles: int, radius: int) -> DataFrame:
    """Links of the rows (bucket, fp), whole buckets dealt over tiles."""

    def compare(part: pa.Table) -> pa.Table:
        x = np.unique(part.column("fp").to_numpy().view(np.uint64))
        to = least_reached(len(x), *near_pairs(x, radius))
        moved = np.flatnonzero(to != np.arange(len(x)))
        return pa.table({"a": x[to[moved]].view(np.int64), "b": x[moved].view(np.int64)})

    dealt = rows.select("fp", F.pmod(F.xxhash64("bucket", F.lit(7)), F.lit(tiles)).alias("tile"))
    return dealt.groupBy("tile").applyInArrow(compare, "a long, b long")


# ---- components ------------------------------------------------------------------------


def simhash_components(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    with scratch(docs.sparkSession) as keep:
        rows = materialise(fingerprints(docs), "fingerprints")
        classes = materialise(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
        comps = components(near_links(classes, radius))
        # components are named by fingerprints so far; their smallest doc_id names them from here
        first = classes.join(comps, F.col("fp") == F.col("node")).select("fp", "comp", "first_id")
        named = materialise(first.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "named")
        smallest = join_dealt(first, named, "comp", "fp").select("fp", "component_id")
        members = materialise(classes.join(smallest, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n"), "members")
        keep(rows, members)
    # the rows of a fingerprint with many are dealt by their place in the table
    placed = rows.filter("doc_id IS NOT NULL").withColumn("place", F.monotonically_increasing_id())
    found = join_dealt(placed, members, "fp", "place").select("doc_id", "fp", "component_id")
    alone = rows.filter("doc_id IS NULL").select("doc_id", "fp", F.col("doc_id").alias("component_id"))
    return found.unionAll(alone).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
