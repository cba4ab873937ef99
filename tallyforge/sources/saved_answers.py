"""Search answers saved by collectors, as lines of JSON in numbered segments: a source for streams and for batches.

A folder holds `answers-00000000.jsonl`, `answers-00000001.jsonl` and so on without gaps. The last segment may still grow; one
counts as closed, and must not change any more, as soon as the next is there. An offset is a segment and a byte in it, so a stream
follows a growing segment to its last whole line and never lists what it has read. A batch of any size is cut into byte ranges;
each line is read by the range that it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallyforge.sources.files import hadoop, new_dir, qualified

LINES = "segment int, byte long, line string"
RANGE = 64 << 20
BLOCK = 1 << 20
ROWS = 1000
#: Names of segments that are asked for at once when the newest one is looked for.
PROBED = 64

ENTRIES = "array<struct<href: string, title: string, body: string>>"
ANSWER = f"run string, entity string, family string, priority int, label string, query string, at timestamp, entries {ENTRIES}, error string"
COLUMNS = ("run", "entity", "family", "priority", "label", "query", "at", "entries", "error")


def segment_name(n: int) -> str:
    return f"answers-{n:08d}.jsonl"


@dataclass
class Lines(InputPartition):
    """The lines of a segment that begin at a byte in [start, end); the segment is read from `base` (a line's begin) to `stop`."""

    segment: int
    base: int
    start: int
    end: int
    stop: int


class _Folder:
    """What the driver asks about segments, and what a task reads of one. Pickled without its file system."""

    def __init__(self, where: str, range_bytes: int):
        self.where, self.range_bytes = where.rstrip("/"), range_bytes

    def _at(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.where)

    def sizes(self, first: int, n: int) -> list[int]:
        """Bytes of the segments from `first` on, at most n, up to the first that isn't there."""
        fs, root = self._at()
        out = []
        for info in fs.get_file_info([f"{root}/{segment_name(first + i)}" for i in range(n)]):
            if info.type != pafs.FileType.File:
                break
            out.append(info.size)
        return out

    def newest(self, known: int) -> dict[str, int]:
        """The end of the last whole line of the newest segment; looked for from a segment that is known (or is the first)."""
        at, size = known, 0
        while found := self.sizes(at, PROBED):
            at, size = at + len(found) - 1, found[-1]
            if len(found) < PROBED:
                break
        return {"segment": at, "byte": self._whole(at, size) if size else 0}

    def _whole(self, segment: int, size: int) -> int:
        fs, root = self._at()
        with fs.open_input_file(f"{root}/{segment_name(segment)}") as file:
            end = size
            while end > 0:
                start = max(0, end - BLOCK)
                cut = file.read_at(end - start, start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Lines]:
        first, last = start["segment"], end["segment"]
        sizes: list[int] = []
        while len(sizes) < last - first:
            found = self.sizes(first + len(sizes), min(PROBED, last - first - len(sizes)))
            if not found:
                raise FileNotFoundError(f"{self.where}/{segment_name(first + len(sizes))} is gone")
            sizes += found
        out = []
        for i, stop in enumerate([*sizes, end["byte"]]):
            base = start["byte"] if i == 0 else 0
            out += [Lines(first + i, base, at, min(at + self.range_bytes, stop), stop) for at in range(base, stop, self.range_bytes)]
        return out

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        fs, root = self._at()
        with fs.open_input_file(f"{root}/{segment_name(part.segment)}") as file:
            rows: list[tuple[int, str]] = []
            held = 0
            for at, line in _lines(file, part):
                if line.strip():
                    rows.append((at, line.decode("utf-8", "replace")))
                    held += len(line)
                if len(rows) >= ROWS or held >= 8 * BLOCK:
                    yield _batch(part.segment, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(part.segment, rows)


def _lines(file, part: Lines) -> Iterator[tuple[int, bytes]]:
    """Begin and bytes of each line of a range. A range looks one byte back: a line begins at its start if a line ends there."""
    at = part.start if part.start == part.base else part.start - 1
    skip = at != part.start
    left: list[bytes] = []
    begin = at
    while at < part.stop and (begin < part.end or skip):
        block = file.read_at(min(BLOCK, part.stop - at), at)
        if not block:
            break
        *whole, rest = block.split(b"\n")
        for piece in whole:
            line = b"".join([*left, piece])
            left = []
            if skip:
                skip = False
            elif begin < part.end:
                yield begin, line
            else:
                return
            begin += len(line) + 1
        left.append(rest)
        at += len(block)
        if skip:
            # of a line that is another range's only the length counts
            begin, left = begin + len(rest), []
    if left and any(left) and not skip and begin < part.end:
        yield begin, b"".join(left)


def _batch(segment: int, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["segment", "byte", "line"])


class SavedAnswers(DataSource):
    """Options: path, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "saved_answers"

    def schema(self) -> str:
        return LINES

    def _folder(self) -> _Folder:
        return _Folder(self.options["path"], int(self.options.get("range_bytes", RANGE)))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._folder())


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Lines]:
        return self.folder.ranges({"segment": 0, "byte": 0}, self.folder.newest(0))

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder, self.known = folder, 0

    def initialOffset(self) -> dict[str, int]:
        return {"segment": 0, "byte": 0}

    def latestOffset(self) -> dict[str, int]:
        out = self.folder.newest(self.known)
        self.known = out["segment"]
        return out

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Lines]:
        self.known = max(self.known, start["segment"])
        return self.folder.ranges(start, end)

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


def _uri(spark: SparkSession, where: str) -> str:
    fs, path = hadoop(spark, where)
    return qualified(fs.makeQualified(path).toUri().toString())


def read_lines(spark: SparkSession, where: str, stream: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """segment, byte, line of a folder's answers."""
    spark.dataSource.register(SavedAnswers)
    source = spark.readStream if stream else spark.read
    return source.format("saved_answers").option("path", _uri(spark, where)).option("range_bytes", range_bytes).load()


def parsed(lines: DataFrame) -> DataFrame:
    """The answers of lines, with `unreadable`: the line where it is no answer (no JSON object, no time or no priority), else null.

    Names and texts that are missing are empty. An answer without an entity tells the time only.
    """
    a = F.from_json("line", ANSWER)
    texts = [F.coalesce(a[n], F.lit("")).alias(n) for n in ("run", "entity", "family", "label", "query", "error")]
    good = a["at"].isNotNull() & a["priority"].isNotNull()
    entries = F.filter(F.coalesce(a["entries"], F.array().cast(ENTRIES)), lambda e: e.isNotNull())
    return lines.select("segment", "byte", *texts, a["priority"].alias("priority"), a["at"].alias("at"), entries.alias("entries"), F.when(good, F.lit(None)).otherwise(F.col("line")).alias("unreadable"))


def append(answers: DataFrame, where: str, first: int) -> int:
    """Adds answers (columns of ANSWER) as segments from number `first` on, a partition a segment, in order; gives the next number.

    Parts are written aside and then renamed, so no reader sees a part of one; a number that is taken raises. One writer a folder.
    """
    spark = answers.sparkSession
    aside = new_dir(spark, "answers")
    answers.select(F.to_json(F.struct(*COLUMNS), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value")).write.mode("overwrite").text(aside)
    fs, path = hadoop(spark, aside)
    to, root = hadoop(spark, where)
    to.mkdirs(root)
    parts = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
    Path = spark._jvm.org.apache.hadoop.fs.Path
    for i, name in enumerate(parts):
        target = Path(root, segment_name(first + i))
        if to.exists(target) or not to.rename(Path(path, name), target):
            raise FileExistsError(str(target))
    return first + len(parts)
