"""Media columns: payloads as lossless 8-bit images in archives, and a data source that reads them in byte ranges.

Writing: each attempt of a task writes ZIP archives of PNG members (grey, 8 bits, 64 samples a row) to the shared
folder under names of its own, and the job commits a table of them; what a lost attempt left is not in it.

Reading: ``ArchiveMedia`` is a Spark data source over a folder of archives. The driver only reads that table (one row
an archive; without it, it lists the files) and plans byte ranges; each task reads the archive's directory, takes the members
whose header lies in its range, and streams them as Arrow batches of bounded size, through one handle. A member is read
by its offset, checked against the directory's CRC, and retried alone, on a new handle; one that stays unreadable comes as
a row with an error, not as a failed job.

Cases: null and empty texts give one row of 64 zero samples; texts of any length are stored whole; null doc_ids
come back null; repeated rows are members of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyforge.llm.common import doc_text, kind_of, modest_batches, new_dir

WIDTH = 64
#: Bytes of an archive before a task begins the next one; bytes of a read partition; bytes of an Arrow batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 128 << 20, 4 << 20
#: The table of the archives that a write job has committed, in their folder.
LISTED = "archives"
RETRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---- the stored form -------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes) -> bytes:
    """The data and zero bytes up to a positive multiple of WIDTH."""
    return data + bytes((-len(data)) % WIDTH or (0 if data else WIDTH))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """Samples as a grey 8-bit image; the unpadded length in a private chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"nbYt", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length of an image that encode_png made. Raises ValueError on damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, n_bytes, rows, packed = 8, None, 0, []
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            rows = struct.unpack(">II", body[:8])[1]
        elif kind == b"nbYt":
            (n_bytes,) = struct.unpack(">Q", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a row filter that encode_png does not use")
    payload = lines[:, 1:].tobytes()
    return payload, len(payload) if n_bytes is None else n_bytes


def sample_feature(payload: bytes) -> str:
    """Rows, mean, deviation, share of zeros and of samples above 127, and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    v = np.arange(256)
    mean = float((n * v).sum() / len(x))
    sd = float(max((n * v * v).sum() / len(x) - mean * mean, 0.0) ** 0.5)
    p = n[n > 0] / len(x)
    entropy = abs(float(-(p * np.log2(p)).sum()))
    return f"rows={len(x) // WIDTH};mean={mean:.4f};sd={sd:.4f};zero={n[0] / len(x):.4f};high={n[128:].sum() / len(x):.4f};entropy={entropy:.4f}"


# ---- writing archives ------------------------------------------------------------------


def qualified(spark: SparkSession, where: str) -> str:
    """The folder with its file system named, as Spark resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _open(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where)


class _Archives:
    """The archives that one attempt of a task writes, under names of its own."""

    def __init__(self, where: str, part: int, most: int):
        self.fs, self.root = _open(where)
        self.part, self.attempt, self.most, self.zip = part, uuid.uuid4().hex, most, None
        self.done: list[tuple[str, int, int]] = []

    def add(self, name: str, media: bytes) -> None:
        if self.zip is None:
            self.name, self.size, self.members = f"part-{self.part:06d}-{len(self.done):04d}-{self.attempt}.zip", 0, 0
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.name}")
            self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.zip.writestr(zipfile.ZipInfo(name), media)
        self.size += len(media)
        self.members += 1
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.zip is None:
            return
        self.zip.close()
        self.stream.close()
        self.done.append((self.name, self.fs.get_file_info(f"{self.root}/{self.name}").size, self.members))
        self.zip = None


def member_name(k: int, doc_id) -> str:
    """A member's name: its place in the task, and its row's id, quoted (nothing after the place: null)."""
    return f"{k:09d}.png" if doc_id is None else f"{k:09d}_{urllib.parse.quote(str(doc_id), safe='')}.png"


def member_id(name: str) -> str | None:
    return urllib.parse.unquote(name[10:-4]) if name[9] == "_" else None


def write_archives(docs: DataFrame, where: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Store the padded text of every row as a member of an archive in that folder (an action).

    What attempts of tasks have written counts only by the list in LISTED, which Spark commits with the job.
    """
    fs, root = _open(where)
    fs.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, k = _Archives(where, TaskContext.get().partitionId(), archive_bytes), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                out.add(member_name(k, doc_id), encode_png(pad(data), len(data)))
                k += 1
        out.close()
        names, sizes, members = zip(*out.done, strict=True) if out.done else ((), (), ())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.int64())], ["archive", "bytes", "members"])

    doc_text(modest_batches(docs)).mapInArrow(write, "archive string, bytes long, members long").write.mode("overwrite").parquet(f"{where}/{LISTED}")


# ---- the data source -------------------------------------------------------------------


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveMedia(DataSource):
    """spark.read.format("archive_media").option("path", folder): members of the ZIP archives in a folder.

    Options: range_bytes (bytes of archive for one partition), retries (for each member).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, attempts int, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def archives(self) -> list[tuple[str, int]]:
        """Paths and sizes: as listed by the job that wrote them, or, in a folder of other origin, of all ZIP files."""
        fs, root = _open(self.where)
        if fs.get_file_info(f"{root}/{LISTED}").type == pafs.FileType.Directory:
            rows = pq.read_table(f"{root}/{LISTED}", filesystem=fs, columns=["archive", "bytes"])
            return [(f"{root}/{a}", n) for a, n in zip(rows["archive"].to_pylist(), rows["bytes"].to_pylist(), strict=True)]
        return [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.path.endswith(".zip")]

    def partitions(self) -> list[InputPartition]:
        return [Range(path, at, min(at + self.range_bytes, size)) for path, size in sorted(self.archives()) for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, _ = _open(self.where)
        archive = Archive(lambda: fs.open_input_file(part.archive))
        with archive.file() as f, zipfile.ZipFile(f) as directory:
            members = sorted((m for m in directory.infolist() if part.start <= m.header_offset < part.end), key=lambda m: m.header_offset)
        rows: list[tuple] = []
        size = 0
        for m in members:
            media, attempts, error = archive.member(m.header_offset, m.compress_size, m.CRC, self.retries)
            rows.append((part.archive, m.header_offset, m.filename, media, attempts, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield _rows(rows)
                rows, size = [], 0
        archive.close()
        if rows:
            yield _rows(rows)


class Archive:
    """An archive that is read by offset through one handle, opened anew after an error only."""

    def __init__(self, open_file: Callable):
        self.file, self.handle = open_file, None

    def member(self, offset: int, size: int, crc: int, retries: int = RETRIES) -> tuple[bytes | None, int, str | None]:
        """A stored member's bytes by its header's offset; how many attempts it took; the last error if none succeeded."""
        error = None
        for attempt in range(1, retries + 2):
            try:
                if self.handle is None:
                    self.handle = self.file()
                f = self.handle
                f.seek(offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member header at the offset")
                f.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                media = f.read(size)
                if len(media) != size or zlib.crc32(media) != crc:
                    raise ValueError("the member's bytes do not match the directory")
                return media, attempt, None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"[:300]
                self.close()
        return None, retries + 1, error

    def close(self) -> None:
        if self.handle is not None:
            with contextlib.suppress(OSError):
                self.handle.close()
            self.handle = None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string()]
    names = ["archive", "offset", "member", "media", "attempts", "error"]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, where: str, range_bytes: int = RANGE_BYTES, retries: int = RETRIES) -> DataFrame:
    spark.dataSource.register(ArchiveMedia)
    return spark.read.format("archive_media").option("path", where).option("range_bytes", range_bytes).option("retries", retries).load()


def media_digest(media: DataFrame, kind: str = "bigint") -> DataFrame:
    """Of each member read: doc_id (of the given type), lengths, hashes and the feature of its samples; error where it
    could not be read."""
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for member, media, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                doc_id = member_id(member)
                if error is None:
                    raw = media.as_buffer().to_pybytes()
                    payload, n = decode_png(raw)
                    out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), sample_feature(payload), None))
                else:
                    out.append((doc_id, None, None, None, None, None, None, None, error))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return media.select("member", "media", "error").mapInArrow(work, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def store_and_digest(docs: DataFrame) -> DataFrame:
    """Store every row's text as media, read the archives back through the data source, and digest what was read."""
    spark = docs.sparkSession
    where = qualified(spark, new_dir(spark, "media"))
    write_archives(docs, where)
    return media_digest(read_archives(spark, where), kind_of(docs, "doc_id"))
