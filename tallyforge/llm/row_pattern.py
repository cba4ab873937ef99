"""The row pattern A (D|U)* P D* over each client's rows in order of time, by offline union-find.

Rows are dealt over slices by ranges of (client, time, row id), so that a client with a third of all rows lies in many
slices. A segment is a stretch of rows that can each follow the row before in a match; no match leaves its segment, and
the search always comes to a segment's first row, so segments are searched apart. In a segment, a run is a stretch of D
and U rows behind its first row. The last P that a start can reach is the last row, in its run or just behind it, that
is a view and whose cents are no fewer than the start's: starts are visited by increasing cents, rows that have become
too low are deleted from a union-find over the views, and the nearest view left of the run's end is what backtracking
finds.

Segments inside of a slice are searched as the slice streams by. The first and the last of each slice may go on in
the next one; these pieces, two for a slice, meet by client. Match numbers add the counts of the client's earlier slices, one number
for each. Nothing else is gathered: a task holds one batch and one segment. A segment ends at any gap of more than 15
minutes, error, null, or equal cents without a view; it is the unit because the letters of a match are digested in order.

Cases: rows with null client_id or ts are left out; repeated rows (in all columns, also those of other names) count
once; different rows with one ts and click_id are ordered by cents (none first), then kind, and so do not depend on
where they lay; null and NaN values, and those whose cents are beyond 64 bits, fit no letter; a null kind fits A only;
a null click_id comes before others and is returned; sums beyond 64 bits wrap round; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import kind_of, materialise, release_memory, scratch

#: Microseconds that a row may come after the row before.
REACH = 15 * 60 * 1_000_000
#: Rows that are searched at once, if segments end by then.
ROWS_AT_ONCE = 50_000
#: What a row may be: nothing but A, also D or U, also P.
PLAIN, STEP, VIEW = 0, 1, 2


def _rest(df: DataFrame, used: set[str]) -> list[Column]:
    """128 bits of all other columns, which tell repeated rows from different ones."""
    rest = []
    for f in df.schema:
        if f.name.lower() not in used:
            c = F.col("`" + f.name.replace("`", "``") + "`")
            rest += [c.isNull(), F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c]
    return [F.xxhash64(F.lit(salt), *rest).alias(f"rest{salt}") for salt in (1, 2)]


def ordered_rows(clicks: DataFrame) -> DataFrame:
    """client_id, ts, click_id, cents, step of the distinct rows, in slices by range, each sorted."""
    taken = clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL")
    rows = taken.select("client_id", "ts", "click_id", "kind", F.col("value").cast("double").alias("value"), *_rest(clicks, {"client_id", "ts", "click_id", "kind", "value"})).distinct()
    raw = F.col("value") * 100 + 0.5
    cents = F.when(~F.isnan("value") & (F.abs(raw) < 2.0**63), F.floor(raw))
    step = F.when(F.col("kind") == "view", VIEW).when(F.col("kind") != "error", STEP).otherwise(PLAIN)
    by = ["client_id", "ts", "click_id", "cents", "step"]
    return rows.select("client_id", "ts", "click_id", cents.alias("cents"), step.alias("step")).repartitionByRange(*by).sortWithinPartitions(*by)


# ---- search ----------------------------------------------------------------------------


def follows(us: np.ndarray, cents: np.ndarray, has: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Which rows can follow the row before in a match (the first row of all: none)."""
    out = np.zeros(len(us), bool)
    out[1:] = (us[1:] - us[:-1] <= REACH) & has[1:] & has[:-1] & (step[1:] != PLAIN) & ((cents[1:] != cents[:-1]) | (step[1:] == VIEW))
    return out


def _ends(goes_on: np.ndarray) -> np.ndarray:
    """For each row the last of the rows behind it that all go on."""
    heads = np.flatnonzero(~goes_on)
    return np.append(heads[1:] - 1, len(goes_on) - 1)[np.cumsum(~goes_on) - 1]


def last_goals(cents: np.ndarray, has: np.ndarray, goal: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts that reach a goal, in order, and for each the last goal up to `end` whose cents are no fewer than its own.

    Starts come by increasing cents. Goals below the start's cents are deleted from a union-find in which a goal points
    to itself and a deleted one to the goal before (0: none; rows count from 1 here).
    """
    n = len(cents)
    before = np.zeros(n + 1, np.int64)
    before[1:] = np.maximum.accumulate(np.where(goal, np.arange(1, n + 1), 0)) if n else 0
    from_ = before[end + 1]
    starts = np.flatnonzero(has & (from_ > np.arange(1, n + 1)))
    goals = np.flatnonzero(goal)
    starts, goals = starts[np.argsort(cents[starts], kind="stable")], goals[np.argsort(cents[goals], kind="stable")]
    dead = np.searchsorted(cents[goals], cents[starts], "left").tolist()
    queue, left = (goals + 1).tolist(), before[goals].tolist()
    up = list(range(n + 1))
    reached, at = [0] * n, 0
    for s, x, gone in zip(starts.tolist(), from_[starts].tolist(), dead, strict=True):
        while at < gone:
            up[queue[at]] = left[at]
            at += 1
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        if x > s + 1:
            reached[s] = x
    found = np.array(reached, np.int64)
    some = np.flatnonzero(found)
    return some.tolist(), (found[some] - 1).tolist()


def search(cents: np.ndarray, has: np.ndarray, step: np.ndarray, linked: np.ndarray) -> tuple[list[tuple[int, int, int]], bytes]:
    """(first row, row of P, last row) of each match, and each row's letter as D or U, of whole segments."""
    n = len(cents)
    turns = linked.copy()
    turns[1:] &= cents[1:] != cents[:-1]
    down = turns.copy()
    down[1:] &= cents[1:] < cents[:-1]
    goal = linked & (step == VIEW)
    end = _ends(turns)
    behind = np.minimum(end + 1, n - 1)
    end = end + ((end + 1 < n) & goal[behind])
    falls = _ends(down)
    out, free = [], 0
    for s, g in zip(*last_goals(cents, has, goal, end), strict=True):
        if s >= free:
            free = int(falls[g])
            out.append((s, g, free))
    return out, np.where(down, ord("D"), ord("U")).astype(np.uint8).tobytes()


def _values(rows: pa.Table) -> tuple[np.ndarray, ...]:
    us = rows.column("ts").cast(pa.int64()).to_numpy()
    cents = rows.column("cents")
    return us, pc.fill_null(cents, 0).to_numpy(), pc.is_valid(cents).to_numpy(), rows.column("step").to_numpy()


MATCH = ["first_id", "last_id", "n_rows", "sum_cents", "labels_sha256"]


def _matches(rows: pa.Table, linked: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The first row of each match in whole segments, and the columns of MATCH."""
    _, cents, has, step = _values(rows)
    found, letters = search(cents, has, step, linked)
    first, last = (np.array([m[i] for m in found], np.int64) for i in (0, 2))
    sums = np.zeros(len(cents) + 1, np.int64)
    np.cumsum(np.where(has, cents, 0), out=sums[1:])
    digests = [hashlib.sha256(b"A" + letters[s + 1 : g] + b"P" + b"D" * (t - g)).hexdigest() for s, g, t in found]
    ids = rows.column("click_id")
    return first, [ids.take(pa.array(first)).combine_chunks(), ids.take(pa.array(last)).combine_chunks(), pa.array(last - first + 1), pa.array(sums[last + 1] - sums[first]), pa.array(digests, pa.string())]


# ---- slices ----------------------------------------------------------------------------


class _Slice:
    """One slice as it streams by: whole segments are searched, the first and the last one put out as pieces."""

    def __init__(self, schema: pa.Schema, number: int, at_once: int):
        self.at_once = at_once
        self.schema, self.number, self.first, self.client, self.seen = schema, number, True, None, 0
        self.held: list[pa.RecordBatch] = []

    def out(self, pos: int, ends: bool, clients: pa.Array, idx: list | None, match: list[pa.Array] | None, rows: pa.Table | None) -> pa.RecordBatch:
        n, kinds = len(clients), {f.name: f.type for f in self.schema}
        columns = {"slice": pa.array([self.number] * n, pa.int32()), "pos": pa.array([pos] * n, pa.int32()), "ends": pa.array([ends] * n, pa.bool_()), "client_id": clients}
        columns |= {"idx": pa.array(idx, pa.int64())} if idx is not None else {}
        columns |= dict(zip(MATCH, match, strict=True)) if match is not None else {}
        if rows is not None:
            columns |= {f"of_{c}": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks().cast(kinds[f"of_{c}"].value_type)) for c in ("click_id", "ts", "cents", "step")}
        return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in self.schema], schema=self.schema)

    def piece(self, rows: pa.Table, ends: bool) -> pa.RecordBatch:
        pos, self.first = 0 if self.first else 2, False
        return self.out(pos, ends, rows.column("client_id").combine_chunks().slice(0, 1), None, None, rows)

    def whole(self, rows: pa.Table, linked: np.ndarray) -> pa.RecordBatch | None:
        """Matches of whole segments, numbered within this slice for each client."""
        first, match = _matches(rows, linked)
        if not len(first):
            return None
        clients = rows.column("client_id").take(pa.array(first)).combine_chunks()
        idx = []
        for c in clients.to_pylist():
            self.client, self.seen = c, self.seen + 1 if c == self.client else 0
            idx.append(self.seen)
        return self.out(1, False, clients, idx, match, None)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # a break before a row of this batch ends what is held
            joint = pa.Table.from_batches([*([last] if last is not None else []), batch])
            breaks = bool((~_linked(joint)[len(joint) - batch.num_rows :]).any())
            self.held.append(batch)
            last = batch.slice(batch.num_rows - 1)
            if breaks and sum(b.num_rows for b in self.held) >= self.at_once:
                yield from self.flush(False)
        if self.held:
            yield from self.flush(True)
        release_memory()

    def flush(self, over: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(self.held).combine_chunks()
        linked = _linked(rows)
        heads = np.flatnonzero(~linked)
        begin, last = 0, int(heads[-1])
        if self.first and len(heads) > 1:
            begin = int(heads[1])
            yield self.piece(rows.slice(0, begin), False)
        if begin < last and not self.first:
            found = self.whole(rows.slice(begin, last - begin), linked[begin:last])
            if found is not None:
                yield found
        left = rows.slice(last)
        if over:
            yield self.piece(left, True)
        self.held = [] if over else left.to_batches()


def _linked(rows: pa.Table) -> np.ndarray:
    """follows, within one client."""
    out = follows(*_values(rows))
    if len(out) > 1:
        clients = rows.column("client_id").combine_chunks()
        out[1:] &= pc.equal(clients.slice(1), clients.slice(0, len(clients) - 1)).to_numpy(zero_copy_only=False)
    return out


def _in_slices(clicks: DataFrame, at_once: int) -> tuple[DataFrame, str, str]:
    client, click = kind_of(clicks, "client_id"), kind_of(clicks, "click_id")
    rows = ordered_rows(clicks)
    time = rows.schema["ts"].dataType.simpleString()
    kind = f"slice int, pos int, ends boolean, client_id {client}, idx long, first_id {click}, last_id {click}, n_rows long, sum_cents long, labels_sha256 string, of_click_id array<{click}>, of_ts array<{time}>, of_cents array<long>, of_step array<int>"
    schema = _arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _Slice(schema, TaskContext.get().partitionId(), at_once).run(batches)

    return rows.mapInArrow(run, kind), client, click


def _arrow_schema(kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(kind))


def _chains(pieces: DataFrame) -> DataFrame:
    """The pieces with `chain`: those of one segment have one number within their client."""
    at = lambda c, i: F.element_at(F.col(c), i)
    meta = pieces.select("client_id", "slice", "pos", "ends", *[at(f"of_{c}", i).alias(f"{n}_{c}") for c in ("ts", "cents", "step") for n, i in (("first", 1), ("last", -1))])
    order = Window.partitionBy("client_id").orderBy("slice", "pos")
    before = lambda c: F.lag(c).over(order)
    us = F.timestamp_diff("MICROSECOND", before("last_ts"), F.col("first_ts"))
    joined = (F.col("pos") == 0) & before("ends") & (before("slice") < F.col("slice")) & (us <= REACH) & (F.col("first_step") != PLAIN) & ((F.col("first_cents") != before("last_cents")) | ((F.col("first_step") == VIEW) & (F.col("first_cents") == before("last_cents"))))
    flagged = meta.select("client_id", "slice", "pos", F.when(joined, 0).otherwise(1).alias("opens"))
    return pieces.join(flagged.select("slice", "pos", F.sum("opens").over(order).alias("chain")).hint("shuffle_hash"), ["slice", "pos"])


def match_rows(clicks: DataFrame, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """client_id, match_no, first_id, last_id, n_rows, sum_cents, labels_sha256 for each match."""
    with scratch(clicks.sparkSession) as keep:
        made, client, click = _in_slices(clicks, at_once)
        made = materialise(made, "slices")
        keep(made)
    own = made.filter("of_ts IS NULL").select("client_id", "slice", "pos", "idx", *MATCH)
    kind = f"client_id {client}, slice int, pos int, idx long, first_id {click}, last_id {click}, n_rows long, sum_cents long, labels_sha256 string"
    schema = _arrow_schema(kind)

    def meet(part: pa.Table) -> pa.Table:
        part = part.sort_by([("slice", "ascending"), ("pos", "ascending")])
        rows = pa.table({c: pa.chunked_array([x for chunk in part.column(f"of_{c}").chunks for x in [chunk.flatten()]]) for c in ("click_id", "ts", "cents", "step")})
        rows = rows.append_column("client_id", pa.chunked_array([pa.repeat(part.column("client_id")[0], len(rows))]))
        first, match = _matches(rows, _linked(rows))
        n = len(first)
        columns = [pa.repeat(part.column(c)[0], n) for c in ("client_id", "slice", "pos")] + [pa.array(np.arange(n))] + match
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    crossing = _chains(made.filter("of_ts IS NOT NULL")).groupBy("client_id", "chain").applyInArrow(meet, kind)
    every = own.unionAll(crossing.select(*own.columns))
    order = Window.partitionBy("client_id").orderBy("slice", "pos").rowsBetween(Window.unboundedPreceding, -1)
    counted = every.groupBy("client_id", "slice", "pos").agg(F.count("*").alias("n"))
    offsets = counted.select("client_id", "slice", "pos", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    # the counts may be as many as the clients: they are not broadcast
    numbered = every.join(offsets.hint("shuffle_merge"), ["client_id", "slice", "pos"])
    return numbered.select("client_id", (F.col("offset") + F.col("idx") + 1).alias("match_no"), *MATCH)


def match_rows_sql() -> str:
    """The same in SQL: the last P of each start by a join within its run, the search by recursion within segments."""
    return """
WITH RECURSIVE d AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT client_id, click_id, ts, kind, CAST(floor(100 * value + 0.5) AS BIGINT) AS cents FROM d),
o AS (SELECT *, row_number() OVER w AS i, lag(cents) OVER w AS pc, lag(ts) OVER w AS pt FROM c WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)),
f AS (SELECT *, coalesce(ts - pt <= INTERVAL 15 MINUTE AND cents IS NOT NULL AND pc IS NOT NULL AND kind <> 'error', false) AS near FROM o),
k AS (SELECT *, near AND cents <> pc AS du, near AND cents < pc AS dn, near AND kind = 'view' AS goal FROM f),
r AS (SELECT *, sum(CASE WHEN du THEN 0 ELSE 1 END) OVER w AS run, sum(CASE WHEN du OR goal THEN 0 ELSE 1 END) OVER w AS seg, sum(CASE WHEN dn THEN 0 ELSE 1 END) OVER w AS fall FROM k WINDOW w AS (PARTITION BY client_id ORDER BY i)),
x AS (SELECT *, max(i) OVER (PARTITION BY client_id, fall) AS down_to FROM r),
goals AS (SELECT client_id, run, i, cents, down_to FROM x WHERE goal UNION ALL SELECT client_id, run - 1, i, cents, down_to FROM x WHERE goal AND NOT du),
m AS (SELECT s.client_id, s.seg, s.i AS s, max(g.i) AS g, max_by(g.down_to, g.i) AS t FROM x AS s JOIN goals AS g ON g.client_id = s.client_id AND g.run = s.run AND g.i > s.i AND g.cents >= s.cents GROUP BY ALL),
n AS (SELECT a.client_id, a.seg, a.s, a.g, a.t, min(b.s) AS next FROM m AS a LEFT JOIN m AS b ON b.client_id = a.client_id AND b.seg = a.seg AND b.s >= a.t GROUP BY ALL),
p AS (SELECT n.* FROM n JOIN (SELECT client_id, seg, min(s) AS s FROM n GROUP BY ALL) USING (client_id, seg, s) UNION ALL SELECT n.* FROM p JOIN n ON n.client_id = p.client_id AND n.s = p.next),
l AS (SELECT p.client_id, p.s, count(*) AS n_rows, sum(x.cents) AS sum_cents, string_agg(CASE WHEN x.i = p.s THEN 'A' WHEN x.i = p.g THEN 'P' WHEN x.dn THEN 'D' ELSE 'U' END, '' ORDER BY x.i) AS labels, min_by(x.click_id, x.i) AS first_id, max_by(x.click_id, x.i) AS last_id FROM p JOIN x ON x.client_id = p.client_id AND x.i BETWEEN p.s AND p.t GROUP BY ALL)
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY s) AS match_no, first_id, last_id, n_rows, CAST(sum_cents AS BIGINT) AS sum_cents, sha256(labels) AS labels_sha256 FROM l
"""
