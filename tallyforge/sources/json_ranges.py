"""A huge JSON document, or several, read by byte ranges: the members of one object as rows.

A range may begin anywhere, also within a string or behind a backslash, so it cannot be read by itself. Three steps:
1. each range is summed up by a task: how many quotes end or begin strings in it (modulo 2), and how far brackets open and
   close, once as if it began outside of a string and once inside; whether its first byte is escaped stands in the
   bytes before it. The driver chains these sums, six numbers a range, into the state in which each range begins;
2. the ranges that the root object's own members touch tell where the asked members lie;
3. a data source has a partition for each range, with its state. A member belongs to the range of the comma or brace before
   it, and is read on beyond the range's end until it is whole.

No task holds more than PIECE bytes and one member. Bytes are classed as vectors, not one by one. Where a name comes twice
the last one counts, as in any JSON reader. A text that is no JSON object, or is cut off, gives ValueError.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyforge.sources.files import listing, open_file

#: Bytes of a range, and of what a task reads at once.
RANGE, PIECE = 64 << 20, 4 << 20
#: Bytes read at once behind a range, for its last member.
BEYOND = 64 << 10
_QUOTE, _ESCAPE, _COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


# ---- bytes -----------------------------------------------------------------------------


def quotes(block: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are quotes that no backslash escapes, and whether the byte after the block is escaped."""
    found = block == _QUOTE
    back = block == _ESCAPE
    if not back.any():
        if escaped and len(found):
            found[0] = False
        return found, escaped and not len(block)
    place = np.arange(len(block))
    # backslashes in a row before each byte; an escaped first byte is none that escapes
    if escaped:
        back[0] = found[0] = False
    last_other = np.maximum.accumulate(np.where(back, -1, place))
    run = place - last_other
    odd = np.zeros(len(block) + 1, bool)
    odd[1:] = run % 2 == 1
    return found & ~odd[:-1], bool(odd[-1])


@dataclass
class _State:
    """Where a reader stands: within a string, behind an odd backslash, within so many brackets."""

    inside: bool
    escaped: bool
    depth: int

    def step(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Over the block: which bytes are outside of strings, and the depth behind each."""
        marks, escaped = quotes(block, self.escaped)
        inside = (np.cumsum(marks) + self.inside) % 2 == 1
        depth = self.depth + np.cumsum(np.where(inside, 0, _STEP[block]), dtype=np.int64)
        outside = ~(inside | marks)
        if len(block):
            self.inside, self.escaped, self.depth = bool(inside[-1]), escaped, int(depth[-1])
        return outside, depth


def _escaped_at(file, at: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    n = 0
    while at > 0:
        size = min(at, 64)
        block = file.read_at(size, at - size)
        kept = block.rstrip(b"\\")
        n += len(block) - len(kept)
        if kept:
            break
        at -= size
    return n % 2 == 1


def _pieces(file, at: int, end: int, most: int = PIECE) -> Iterator[tuple[int, bytes]]:
    while at < end:
        block = file.read_at(min(most, end - at), at)
        if not block:
            return
        yield at, block
        at += len(block)


# ---- the three steps -------------------------------------------------------------------


def summary(file, start: int, end: int) -> tuple[bool, int, int, int, int]:
    """Whether the quotes of a range are odd in number, and for a beginning outside and inside of a string how far the depth
    goes, and the least of it."""
    escaped = _escaped_at(file, start)
    out, states = [0, 0, 0, 0], [_State(False, escaped, 0), _State(True, escaped, 0)]
    for _, block in _pieces(file, start, end):
        data = np.frombuffer(block, np.uint8)
        for k, state in enumerate(states):
            depth = state.step(data)[1]
            out[2 * k + 1] = min(out[2 * k + 1], int(depth.min()))
    out[0], out[2] = states[0].depth, states[1].depth
    return (states[0].inside, *out)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    inside: bool
    depth: int
    low: int
    first: int = 0
    last: int = 0
    size: int = 0


def chain(sums: list[tuple]) -> list[Range]:
    """The ranges of one file with the state in which each begins; low: the least depth in it. sums: by start."""
    out, inside, depth = [], False, 0
    for path, start, end, odd, out_0, low_0, out_1, low_1 in sums:
        out.append(Range(path, start, end, inside, depth, depth + (low_1 if inside else low_0), size=sums[-1][2]))
        depth += out_1 if inside else out_0
        inside ^= odd
    if inside or depth or not out:
        raise ValueError(f"{sums[0][0] if sums else 'the file'} is cut off, or no JSON")
    return out


def root_members(file, part: Range, names: list[str]) -> list[tuple[int, str | None]]:
    """Places of the commas and the brace before members of the root object, for the first such of the range, and for those of
    the asked names and what comes behind them; with the name where it is asked for."""
    out: list[tuple[int, str | None]] = []
    after = True
    for at, name in _separators(file, part, 1):
        named = _name(file, at + 1, part.size)
        if named in names or after:
            out.append((at, named if named in names else None))
        after = named in names
    return out


def _separators(file, part: Range, depth: int) -> Iterator[tuple[int, None]]:
    """Places in the range behind which a member of an object at a depth begins."""
    state = _State(part.inside, _escaped_at(file, part.start), part.depth)
    for at, block in _pieces(file, part.start, part.end):
        data = np.frombuffer(block, np.uint8)
        outside, behind = state.step(data)
        marks = outside & (behind == depth) & ((data == _COMMA) | (_STEP[data] == 1))
        for i in np.flatnonzero(marks).tolist():
            yield at + i, None


def _name(file, at: int, end: int) -> str | None:
    """The member's name that begins at a place; None if there is none, as in an empty object."""
    body = b""
    while at < end:
        body += (more := file.read_at(min(4096, end - at), at))
        at += len(more)
        text = body.lstrip()
        if text and text[:1] != b'"':
            return None
        marks = np.flatnonzero(quotes(np.frombuffer(text, np.uint8), False)[0])
        if len(marks) > 1:
            return json.loads(text[: marks[1] + 1])
    return None


def members(file, part: Range) -> Iterator[tuple[str, str]]:
    """name and value (as JSON text) of the object's members that begin in the range, at depth 2 from part.first to part.last."""
    state = _State(part.inside, _escaped_at(file, part.start), part.depth)
    held: list[bytes] | None = None
    beyond = _pieces(file, part.end, min(part.size, part.last), BEYOND)
    for at, block in itertools.chain(_pieces(file, part.start, part.end), beyond):
        data = np.frombuffer(block, np.uint8)
        outside, depth = state.step(data)
        # within the asked object: its brace, the commas in it, and the brace that closes it
        marks = outside & (((depth == 2) & ((data == _COMMA) | (_STEP[data] == 1))) | ((depth == 1) & (_STEP[data] == -1)))
        from_ = 0
        for i in np.flatnonzero(marks).tolist():
            if at + i < part.first:
                continue
            if held is not None:
                held.append(block[from_:i])
                yield from _member(b"".join(held))
            held, from_ = None, i + 1
            if depth[i] == 1 or at + i >= part.end:
                return
            held = []
        if held is not None:
            held.append(block[from_:])
        elif at + len(block) >= part.end:
            return


def _member(body: bytes) -> Iterator[tuple[str, str]]:
    body = body.strip()
    if body:
        marks = np.flatnonzero(quotes(np.frombuffer(body, np.uint8), False)[0])
        yield json.loads(body[: marks[1] + 1]), body[marks[1] + 1 :].lstrip()[1:].strip().decode()


# ---- Spark -----------------------------------------------------------------------------


class JsonMembers(DataSource):
    """Rows (path, name, value): the members of an object, from ranges planned by `plan`."""

    @classmethod
    def name(cls) -> str:
        return "json_members"

    def schema(self) -> str:
        return "path string, name string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([Range(**r) for r in json.loads(self.options["ranges"])])


class _Reader(DataSourceReader):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges

    def partitions(self) -> list[Range]:
        return self.ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as file:
            rows, size = [], 0
            for name, value in members(file, partition):
                rows.append((name, value))
                size += len(value)
                if size >= PIECE:
                    yield _batch(partition.path, rows)
                    rows, size = [], 0
            if rows:
                yield _batch(partition.path, rows)


def _batch(path: str, rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([path] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["path", "name", "value"])


def plan(spark: SparkSession, where: str, names: list[str], range_bytes: int = RANGE) -> dict[str, tuple[list[Range], dict[str, tuple[int, int]]]]:
    """For each file its ranges, and of the root's members with the asked names where they begin and the next one does."""
    cuts = [(p, at, min(at + range_bytes, size)) for p, size in listing(spark, where) for at in range(0, size, range_bytes)]
    if not cuts:
        return {}

    def sum_up(batches):
        for b in batches:
            rows = []
            for path, start, end in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                with open_file(path) as file:
                    rows.append((path, start, end, *summary(file, start, end)))
            yield pa.record_batch([pa.array([r[i] for r in rows]) for i in range(8)], ["path", "start", "end", "odd", "out_0", "low_0", "out_1", "low_1"])

    table = spark.createDataFrame(cuts, "path string, start long, end long").repartition(len(cuts))
    sums = sorted(tuple(r) for r in table.mapInArrow(sum_up, "path string, start long, end long, odd boolean, out_0 long, low_0 long, out_1 long, low_1 long").collect())
    files: dict[str, list[tuple]] = {}
    for row in sums:
        files.setdefault(row[0], []).append(row)
    ranges = {path: chain(own) for path, own in files.items()}
    near = [r for own in ranges.values() for r in own if r.low <= 1]

    def look(batches):
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                part = Range(**json.loads(text))
                with open_file(part.path) as file:
                    rows += [(part.path, at, name) for at, name in root_members(file, part, names)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["path", "at", "name"])

    found = spark.createDataFrame([(json.dumps(vars(r)),) for r in near], "part string").repartition(len(near)).mapInArrow(look, "path string, at long, name string")
    at_root: dict[str, list[tuple]] = {}
    for path, at, name in sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2]):
        at_root.setdefault(path, []).append((at, name))
    out = {}
    for path, own in ranges.items():
        marks = at_root.get(path, [])
        if not marks:
            raise ValueError(f"{path} is no JSON object")
        ends = [at for at, _ in marks[1:]] + [own[-1].end]
        out[path] = own, {name: (at, end) for (at, name), end in zip(marks, ends, strict=True) if name is not None}
    return out


def member_rows(spark: SparkSession, where: str, name: str, range_bytes: int = RANGE) -> DataFrame:
    """path, name, value: the members of the object that the root has under a name, in each file of a path."""
    return rows_of(spark, plan(spark, where, [name], range_bytes), name)


def rows_of(spark: SparkSession, planned: dict, name: str) -> DataFrame:
    spark.dataSource.register(JsonMembers)
    parts = []
    for ranges, marks in planned.values():
        if name in marks:
            first, last = marks[name]
            # the object's own brace, not the comma before its name, is the first place to look from
            parts += [vars(r) | {"first": first + 1, "last": last} for r in ranges if r.end > first and r.start < last]
    if not parts:
        return spark.createDataFrame([], JsonMembers({}).schema())
    return spark.read.format("json_members").option("ranges", json.dumps(parts)).load()


def root_value(planned: dict, path: str, name: str, most: int = 1 << 20):
    """A short member of the root, parsed on the driver; None if it is not there."""
    marks = planned[path][1]
    if name not in marks:
        return None
    first, last = marks[name]
    if last - first > most:
        raise ValueError(f"{name} in {path} has more than {most} bytes")
    with open_file(path) as file:
        body = file.read_at(last - first - 1, first + 1).decode().strip()
    decoder = json.JSONDecoder()
    _, at = decoder.raw_decode(body)
    return decoder.raw_decode(body[at:].lstrip()[1:].lstrip())[0]
