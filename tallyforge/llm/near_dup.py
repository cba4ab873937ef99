"""Near-duplicate components by HyperMinHash registers, banding, estimate and verification.

Texts are sets of distinct word shingles (64-bit hashes). Rows with the same set form one class at once. Each class
has REGISTERS registers; a register keeps the least hash of its bucket as leading-zero count (5 bits) and mantissa
(11 bits). The buckets have one hash each, not one hash shared out over all: with a shared hash short texts leave
most buckets empty, and links between them would be missed. Bands of ROWS registers, taken from two permutations so
that each register is in one band at least, are the buckets in which candidates meet: with 64 bands of 6, a pair at
similarity 0.8 is missed with a chance of about 1e-8.

No bucket is expanded into its pairs. In each round a bucket names a leader (the least salted hash), the others are
its candidates, and what is linked is contracted. The leader then leaves, all its pairs being looked at, and only
buckets that still hold more than one component go on to the next round. A first stage takes a few bands, so that large
groups are contracted before their other buckets are read. What the rounds left is compared in blocks of bounded
size, members of different components only, which pass on links alone. Every candidate pair has a collision-corrected
estimate first; a pair goes on unless its estimate is SIGMAS standard errors below the threshold, and is then verified on
full sets.

Components of verified links come from one task while they are few (a counted bound), beyond that from alternating
large-star and small-star steps on tables in the shared folder.

Cases: null and empty texts have no shingles and are their own component; texts with fewer words than a shingle have
one, the whole sequence; rows with null doc_id are not linked, with component_id null and kept true; rows with equal
doc_id are rows of their own; repeated rows are linked, and each that carries the smallest doc_id is kept; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACE, arrow_map, broadcast_if_small, counted, discard, doc_text, join_dealt, kind_of, materialise, mix, modest_batches, numbered, renamed, scratch, words_of

REGISTERS, BANDS, ROWS = 256, 64, 6
#: Bits of a register's mantissa; the leading-zero count has the other 5 of 16.
MANTISSA = 11
#: Bands and rounds with leaders of each stage: a few bands contract large groups before the others are looked at.
STAGES = ((range(0, 6), 2), (range(6, BANDS), 1))
#: Classes of one block, where what the rounds left is compared, and of a cluster of buckets that is one group.
BLOCK, CLUSTER = 512, 8192
#: Standard errors that an estimate may fall below the threshold.
SIGMAS = 6.0
#: Ids that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Links (16 bytes each) whose components one task finds; beyond it they are found by rounds of shuffles.
ONE_TASK_LINKS = 500_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MEMBERS = np.concatenate([_rng.permutation(REGISTERS), _rng.permutation(REGISTERS)])[: BANDS * ROWS].reshape(BANDS, ROWS)


# ---- sets and registers ----------------------------------------------------------------


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts, SPACE)
    w, at = words.hashes, words.offsets
    grams = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for j in range(size):
        grams += w[j : j + len(grams)] * (_STEP ** np.uint64(j + 1) if j else _STEP)
    grams = mix(grams)
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= size:
            out.append(np.unique(grams[s : e - size + 1]))
        elif e > s:
            one = np.array([e - s], np.uint64)
            for h in w[s:e]:
                one = mix(one * _STEP + h)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers of a set that is not empty: uint16 of leading zeros and mantissa."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _A + _B).min(0), out=least)
    return compress(least)


def compress(least: np.ndarray) -> np.ndarray:
    zeros = 32 - np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 31)
    tail = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (tail >> np.uint64(32 - MANTISSA))).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Rows of registers to rows of BANDS 64-bit bucket keys."""
    picked = regs[:, _MEMBERS].astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), picked.shape[:2])
    for j in range(ROWS):
        key = mix(key * _STEP + picked[:, :, j])
    return key


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that two disjoint sets of n and m agree in a register: leading zeros and mantissa by accident."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    return 0.169919 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA) * 2


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from counts of equal registers, with accidental agreement taken out."""
    c = collision_rate(n, m)
    return np.clip((agree / REGISTERS - c) / (1 - c), 0, 1)


def may_link(agree: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """False only where sizes rule a link out or the estimate is SIGMAS standard errors below the threshold."""
    t = percent / 100
    sized = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return sized & (estimate(agree, n, m) >= t - SIGMAS * (t * (1 - t) / REGISTERS) ** 0.5)


# ---- tables ----------------------------------------------------------------------------


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set, from two order-free sums."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ _STEP).sum(dtype=np.uint64)
        return int(mix(np.array([a * _STEP + mix(np.array([b + np.uint64(len(s))]))[0]]))[0].view(np.int64))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, node (a hash of the set; null if empty), regs (binary) for each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), size)
        full = [len(s) > 0 for s in sets]
        return pa.record_batch(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) if f else None for s, f in zip(sets, full, strict=True)], pa.int64()), pa.array([registers(s).tobytes() if f else None for s, f in zip(sets, full, strict=True)], pa.binary())],
            ["doc_id", "h", "n_shingles", "node", "regs"],
        )

    return doc_text(modest_batches(docs)).withColumn("h", F.xxhash64("text")).mapInArrow(arrow_map(work, 4 << 20), f"doc_id {kind_of(docs, 'doc_id')}, h long, n_shingles long, node long, regs binary")


def _full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, s (array of long): the sets of the asked classes (a materialised table), from the text of one row of each."""
    n = counted(nodes)[0]
    wanted = classes.select("node", "first_id").join(broadcast_if_small(nodes.select("node"), n, BROADCAST_IDS), "node", "left_semi")
    wanted = broadcast_if_small(wanted, n, BROADCAST_IDS)
    rows = doc_text(modest_batches(docs)).join(wanted, F.col("doc_id") == F.col("first_id")).select("node", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        kept = [(n, _signed(s)) for n, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True) if len(s) and _set_key(s) == n]
        if not kept:
            return None
        return pa.record_batch([pa.array([n for n, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.list_(pa.int64()))], ["node", "s"])

    # rows that share a doc_id and a set give the same set: one is enough
    return rows.mapInArrow(arrow_map(work, 4 << 20), "node long, s array<long>")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the estimate does not rule out, with set sizes."""
    side = materialise(_of_pairs(pairs).join(classes.select("node", "n_shingles", "regs"), "node"), "paired")
    with_a = join_dealt(pairs, side.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"), "n"), "a", "b", side)
    both = join_dealt(with_a, side.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"), "n"), "b", "a", side)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, na, ra, nb, rb = (batch.column(i) for i in (batch.schema.get_field_index(n) for n in ("a", "b", "na", "ra", "nb", "rb")))
        x, y = (np.frombuffer(b"".join(r.to_pylist()), np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
        n, m = na.to_numpy(), nb.to_numpy()
        good = pa.array(may_link((x == y).sum(1), n, m, percent))
        return pa.record_batch([a, b, na, nb], ["a", "b", "na", "nb"]).filter(good)

    return both.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(arrow_map(work, 8 << 20), "a long, b long, na long, nb long")


def _of_pairs(pairs: DataFrame) -> DataFrame:
    """node, n: the classes in the pairs (a, b), and in how many."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b, na, nb), those whose full sets are similar enough."""
    nodes = materialise(_of_pairs(pairs), "nodes")
    sets = materialise(_full_sets(docs, classes, nodes, size).dropDuplicates(["node"]).join(nodes, "node"), "sets")
    with_b = join_dealt(pairs, sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), "n"), "b", "a", sets)
    both = join_dealt(with_b, sets.select(F.col("node").alias("a"), F.col("s").alias("sa"), "n"), "a", "b", sets)
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = materialise(both.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "links")
    discard(sets)
    return links


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, and the smallest node reachable from each."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
    for x in range(len(up)):
        up[x] = up[up[x]]
    return nodes, nodes[np.array(up, np.int64)] if len(nodes) else nodes


def components(links: DataFrame, label: str = "components", one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """node, comp (the smallest node reachable) for each node of the links (a, b).

    Up to one_task links (counted, 16 bytes each) go through one task; more are contracted by alternating large-star
    and small-star steps, each a few shuffles with pre-aggregated minima.
    """
    spark = links.sparkSession
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    if counted(edges)[0] <= one_task:

        def find(batches):
            parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if parts:
                yield pa.record_batch(list(map(pa.array, union_find(*(np.concatenate(p) for p in zip(*parts, strict=True))))), ["node", "comp"])

        return materialise(edges.coalesce(1).mapInArrow(find, "node long, comp long"), label)
    digest = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), label)
        # large star: greater neighbours go to the least neighbour
        large = materialise(join_dealt(both, least, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), label)
        # small star: smaller neighbours, and the node itself, go to the least of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), label)
        small = join_dealt(large, low, "u", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = materialise(small, label)
        found = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first()
        for done in (edges, least, large, low):
            discard(done)
        edges = new
        if tuple(found) == digest or not found[0]:
            break
        digest = tuple(found)
    return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


# ---- rounds ----------------------------------------------------------------------------


def _buckets(classes: DataFrame, bands: range) -> DataFrame:
    """bucket, node: each class in each of these bands."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS))[:, bands.start : bands.stop]
        return pa.record_batch([pa.array(_signed(np.ascontiguousarray(keys).reshape(-1))), pa.array(np.repeat(batch.column(0).to_numpy(), len(bands)))], ["bucket", "node"])

    rows = classes.select("node", "regs").mapInArrow(arrow_map(work, 1 << 20), "bucket long, node long")
    # most buckets hold one class: only what shares its bucket goes on
    shared = materialise(rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("low <> high").select("bucket", "n"), "shared")
    return materialise(join_dealt(rows, shared, "bucket", "node"), "buckets")


def _with_comp(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))


def _open_buckets(members: DataFrame, turn: int) -> DataFrame:
    """Of the buckets that hold more than one component: the leader's node and component, and the number of members."""
    turned = F.xxhash64(F.lit(turn), "node")
    led = members.groupBy("bucket").agg(F.min_by("node", turned).alias("leader"), F.min_by("comp", turned).alias("leader_comp"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"))
    return materialise(led.filter("c0 <> c1").drop("c0", "c1"), "leaders")


def _groups(members: DataFrame) -> DataFrame | None:
    """bucket, node, comp of what the rounds left, in groups that are each compared as one; None if no bucket holds two components.

    Buckets that share members form a cluster; a cluster of up to CLUSTER classes is one group, so that a class is read
    once and not for each bucket. Buckets of larger clusters are groups of their own.
    """
    mixed = materialise(members.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).filter("c0 <> c1").select("bucket", "n"), "mixed")
    if not counted(mixed)[0]:
        return None
    members = materialise(join_dealt(members, mixed, "bucket", "node"), "rest-open")
    cluster = components(members.select(F.col("bucket").alias("a"), F.col("node").alias("b")), "clusters").select(F.col("node").alias("bucket"), F.col("comp").alias("cluster"))
    grouped = materialise(join_dealt(members, materialise(mixed.join(cluster, "bucket"), "placed-buckets"), "bucket", "node"), "grouped")
    sizes = grouped.groupBy("cluster", "node").agg(F.count("*").alias("n")).groupBy("cluster").agg((F.count("*") <= CLUSTER).alias("small"), F.sum("n").alias("n"))
    sized = join_dealt(grouped, materialise(sizes, "sizes"), "cluster", "node")
    return sized.select(F.when(F.col("small"), F.col("cluster")).otherwise(F.col("bucket")).alias("bucket"), "node", "comp").distinct()


def _in_blocks(docs: DataFrame, members: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links (a, b) that join the components in what the rounds left of the buckets; exact, on full sets. None if there is nothing to compare.

    A group's main component (that of one member drawn by hash) is compared with all others, and the others with each
    other, in blocks of bounded size; members of the main component are not compared among themselves. Blocks get
    registers first; full sets go to the blocks where an estimate lets a pair through, and for its classes only.
    """
    groups = _groups(members)
    if groups is None:
        return None
    members = materialise(groups, "groups")
    # one row a component first, so that its members are counted with the draw
    parts = members.groupBy("bucket", "comp").agg(F.min(F.xxhash64(F.lit(99), "node")).alias("turned"), F.count("*").alias("n"))
    drawn = parts.groupBy("bucket").agg(F.min_by("comp", "turned").alias("main_comp"), F.min_by("n", "turned").alias("own_n"), F.count("*").alias("comps"), F.sum("n").alias("n")).filter("comps > 1")
    drawn = materialise(drawn.select("bucket", "main_comp", F.ceil(F.col("own_n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("own_n")) / BLOCK).cast("int").alias("others"), "n"), "drawn")
    own = F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    placed = join_dealt(members, drawn, "bucket", "node").withColumn("main", F.col("comp") == F.col("main_comp")).withColumn("own", own)
    kind = "array<struct<kind:int,i:int,j:int>>"
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.lit(0).alias("kind"), F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))).cast(kind)
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: F.struct(F.lit(1).alias("kind"), F.col("own").alias("i"), m.alias("j"))).cast(kind)
    from_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("i"), F.col("own").alias("j"))).cast(kind)
    full = placed.join(classes.select("node", "n_shingles", "regs"), "node")
    spread = full.withColumn("at", F.explode(F.when(F.col("main"), from_main).otherwise(F.concat(with_others, with_mains)))).select("bucket", "at.*", "own", "main", "node", "comp", "n_shingles", "regs")

    def sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        kind, i, j = part.kind.iloc[0], part.i.iloc[0], part.j.iloc[0]
        main, own = part.main.to_numpy(), part.own.to_numpy()
        return np.flatnonzero(~main if kind else own == i), np.flatnonzero(main if kind else own == j)

    def likely(part: pd.DataFrame) -> pd.DataFrame:
        left, right = sides(part)
        mask = block_mask(part.comp.to_numpy(), part.n_shingles.to_numpy(), _registers(part.regs), left, right, percent)
        return part.iloc[np.union1d(left[mask.any(1)], right[mask.any(0)])]

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        left, right = sides(part)
        found = block_links(part.node.to_numpy(), part.comp.to_numpy(), part.n_shingles.to_numpy(), _registers(part.regs), part.s.to_list(), left, right, percent)
        return pd.DataFrame({"a": [min(x) for x in found], "b": [max(x) for x in found]}, dtype="int64")

    blocks = ["bucket", "kind", "i", "j"]
    left = materialise(spread.groupBy(*blocks).applyInPandas(likely, spread.schema), "likely-rows")
    nodes = materialise(left.groupBy("node").agg(F.count("*").alias("n")), "nodes")
    sets = materialise(_full_sets(docs, classes, nodes, size).dropDuplicates(["node"]).join(nodes, "node"), "sets")
    return join_dealt(left, sets, "node", "bucket").groupBy(*blocks).applyInPandas(compare, "a long, b long").distinct()


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def block_mask(comp: np.ndarray, n: np.ndarray, regs: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which rows left and right are of different components and may link by their estimate."""
    mask = np.zeros((len(left), len(right)), bool)
    for k, x in enumerate(left):
        y = np.flatnonzero(comp[right] != comp[x])
        if len(y):
            mask[k, y] = may_link((regs[right[y]] == regs[x]).sum(1), n[x], n[right[y]], percent)
    return mask


def block_links(node: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray, sets: list, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows left and right that join components, no more than needed to join them."""
    mask = block_mask(comp, n, regs, left, right, percent)
    if not mask.any():
        return []
    left, right, mask = left[mask.any(1)], right[mask.any(0)], mask[mask.any(1)][:, mask.any(0)]
    # numbers for the shingles that more than one row has; equal rows of a 0/1 matrix by these give all common counts
    rows = np.concatenate([left, right])
    flat, owner = np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = many > 1
    number = np.cumsum(shared) - 1
    good = shared[at]
    column, owner = number[at[good]], owner[good]
    common = np.zeros(mask.shape, np.float32)
    for c in range(0, int(shared.sum()), 4096):
        part = (column >= c) & (column < c + 4096)
        m = np.zeros((len(rows), 4096), np.float32)
        m[owner[part], column[part] - c] = 1
        common += m[: len(left)] @ m[len(left) :].T
    linked = mask & (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common))
    x, y = np.nonzero(linked)
    if not len(x):
        return []
    _, first = np.unique(np.stack([comp[left[x]], comp[right[y]]], 1), axis=0, return_index=True)
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    for k in first:
        a, b = root(int(comp[left[x[k]]])), root(int(comp[right[y[k]]]))
        if a != b:
            up[a] = b
            out.append((int(node[left[x[k]]]), int(node[right[y[k]]])))
    return out


def linked_components(docs: DataFrame, size: int = 4, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n_shingles, node) of docs, and node, component_id, n (rows) of their classes, as tables in the shared folder."""
    with scratch(docs.sparkSession) as keep:
        rows = materialise(sketches(docs, size), "sketches")
        classes = materialise(rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.max("regs").alias("regs"), F.count("*").alias("n")), "classes")
        comps = _linked(docs, classes, size, percent)
        if comps is None:
            members = classes.select("node", F.col("first_id").alias("component_id"), "n")
            keep(rows, classes)
        else:
            # components are named by nodes so far; their smallest doc_id names them from here
            first = classes.select("node", "first_id").join(comps, "node")
            named = materialise(first.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "named")
            smallest = join_dealt(first, named, "comp", "node").select("node", "component_id")
            members = materialise(classes.select("node", "first_id", "n").join(smallest, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"), "n"), "members")
            keep(rows, members)
    return rows.select("doc_id", "h", "n_shingles", "node"), members


def _linked(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame | None:
    """node, comp of the classes that are linked with others; None if none is."""
    links = comps = tried = rest = None
    for bands, turns in STAGES:
        members = _with_comp(_buckets(classes, bands), comps)
        for turn in range(turns):
            leaders = _open_buckets(members, turn)
            active = materialise(join_dealt(members, leaders, "bucket", "node"), "active")
            pairs = active.filter("comp <> leader_comp").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = materialise(pairs, "pairs")
            if counted(pairs)[0]:
                likely = materialise(_estimated(pairs, classes, percent), "likely")
                tried = pairs if tried is None else tried.unionAll(pairs)
                if counted(likely)[0]:
                    links = _more(links, _verified(docs, classes, likely, size, percent))
                    comps = components(links)
            # all pairs of the leader have been looked at: it leaves its bucket
            after = active.filter("node <> leader").select("bucket", "node")
            members = _with_comp(after, comps)
        rest = _more(rest, after)
    blocks = _in_blocks(docs, _with_comp(rest, comps), classes, size, percent)
    left = None if blocks is None else materialise(blocks, "left")
    if left is not None and counted(left)[0]:
        links = _more(links, left)
        comps = components(links)
    return comps


def _more(all_: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if all_ is None else all_.unionAll(new)


def _of_classes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows with what members has of their class. All exact copies of a text are one class: they are dealt by their place."""
    return join_dealt(rows.withColumn("place", F.monotonically_increasing_id()), members, "node", "place")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    rows, members = linked_components(docs, size, percent)
    takes_part = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    found = _of_classes(rows.filter(takes_part), members).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter(~takes_part).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, less all but one of each component: the one with the smallest doc_id, of
    rows with that id the one with the smallest text hash, and one of rows that repeat it. Rows with null doc_id and
    rows without shingles all stay. Only ids are shuffled, unless more go than BROADCAST_IDS. Shingles are of five
    words, as stages on word shingles take them; near_duplicates takes four, as its contract says."""
    names = docs.columns
    with scratch(docs.sparkSession) as keep:
        rows, members = linked_components(docs, size, percent)
        placed = materialise(_of_classes(rows.filter("node IS NOT NULL AND doc_id IS NOT NULL"), members).select("component_id", "doc_id", "h"), "placed")
        first = materialise(placed.groupBy("component_id").agg(F.min(F.when(F.expr("doc_id = component_id"), F.col("h"))).alias("first_h"), F.count("*").alias("n")), "first")
        led = join_dealt(placed, first, "component_id", "doc_id")
        ids = [F.col("doc_id").alias("at_id"), F.col("h").alias("at_h")]
        out = materialise(led.filter("doc_id <> component_id OR h <> first_h").select(*ids).distinct(), "dropped")
        twice = materialise(led.filter("doc_id = component_id AND h = first_h").groupBy(*ids).agg(F.count("*").alias("n")).filter("n > 1").select("at_id", "at_h"), "repeated")
        keep(out, twice)
    own = docs.select(*numbered(names), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_h"))
    same = (F.col("own_id") == F.col("at_id")) & (F.col("own_h") == F.col("at_h"))
    left = own.join(broadcast_if_small(out, counted(out)[0], BROADCAST_IDS), same, "left_anti")
    repeated = counted(twice)[0]
    if not repeated:
        return left.select(*renamed(names))
    twice = broadcast_if_small(twice, repeated, BROADCAST_IDS)
    once = left.join(twice, same).groupBy("at_id", "at_h").agg(F.first(F.struct(*[f"c{i}" for i in range(len(names))])).alias("row")).select("row.*")
    return left.join(twice, same, "left_anti").select(*renamed(names)).unionAll(once.select(*renamed(names)))
