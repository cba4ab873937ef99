"""Workbooks (.xlsx) as a source and a sink, without a spreadsheet library: a zip of sheets in XML.

Source `workbook`: one partition for each file, as a sheet is one compressed stream, of 2^20 rows at most by its format.
Rows are read as the XML streams by, under the names of a header row, as texts: numbers without a needless fraction,
dates and times as yyyy-MM-dd HH:mm:ss, true and false, null for empty cells and errors. Of a folder all workbooks are read;
their columns are those of the first.

Sink `workbook_sheet`: each task writes the rows of a sheet as compressed parts under names of its own. The commit puts down one
list of the parts, by partition, which makes the sheet count; what a failed or aborted task wrote is deleted and in no
list. `write_workbook` writes its sheets so, and then has one task copy the parts into a zip as they are; a sheet of more
rows than the format takes goes on in further sheets.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tallyforge.sources.files import hadoop, listing, open_file, qualified

#: Rows of a sheet and letters of a cell that the format allows (fixed values of the format), and rows of one part.
SHEET_ROWS, CELL_LETTERS, PART_ROWS = 1 << 20, 32_767, 50_000
#: Numbers of built-in formats for dates and times (fixed values of the format).
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)])
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS_A_BATCH = 2_000


# ---- reading ---------------------------------------------------------------------------


def _xml(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def sheet_member(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The zip member of a sheet, by name; of the first one if none is named."""
    root = _xml(book, "xl/workbook.xml")
    ids = {s.get("name"): s.get(_REL) for s in root.iter(f"{_MAIN}sheet")}
    if not ids or (sheet is not None and sheet not in ids):
        raise ValueError(f"no sheet {sheet!r}: there are {list(ids)}")
    wanted = ids[sheet] if sheet is not None else next(iter(ids.values()))
    for r in _xml(book, "xl/_rels/workbook.xml.rels"):
        if r.get("Id") == wanted:
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"sheet {sheet!r} has no part")


def _shared(book: zipfile.ZipFile) -> list[str]:
    """The strings that cells name by number."""
    out: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_MAIN}si":
                    out.append(_text(e))
                    e.clear()
    return out


def _text(e: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic ones; _x000A_ and the like stand for what XML cannot hold."""
    skip = {id(t) for p in e.iter(f"{_MAIN}rPh") for t in p.iter()}
    text = "".join(t.text or "" for t in e.iter(f"{_MAIN}t") if id(t) not in skip)
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Which cell styles show a number as a date or time."""
    root = _xml(book, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
    dated = {k for k, code in own.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower()))} | DATE_FORMATS
    xfs = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId") or 0) in dated}


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _number(text: str) -> str:
    x = float(text)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def sheet_rows(book: zipfile.ZipFile, sheet: str | None) -> Iterator[tuple[int, dict[int, str]]]:
    """Row number from 0 and its cells by column, for rows that hold any."""
    shared, dates = _shared(book), _date_styles(book)
    props = _xml(book, "xl/workbook.xml").find(f"{_MAIN}workbookPr")
    day_0 = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
    at = -1
    with book.open(sheet_member(book, sheet)) as f:
        data = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                data = e if e.tag == f"{_MAIN}sheetData" else data
                continue
            if e.tag != f"{_MAIN}row":
                continue
            at = int(e.get("r")) - 1 if e.get("r") else at + 1
            cells, place = {}, -1
            for c in e.iter(f"{_MAIN}c"):
                place = _column(c.get("r")) if c.get("r") else place + 1
                kind, v = c.get("t") or "n", c.find(f"{_MAIN}v")
                value = v.text if v is not None else None
                if kind == "inlineStr":
                    inner = c.find(f"{_MAIN}is")
                    value = _text(inner) if inner is not None else None
                elif value is None or kind == "e":
                    value = None
                elif kind == "s":
                    value = shared[int(value)]
                elif kind == "b":
                    value = "true" if value.strip() == "1" else "false"
                elif kind == "n":
                    dated = int(c.get("s") or 0) in dates
                    value = (day_0 + timedelta(seconds=round(float(value) * 86400))).strftime("%Y-%m-%d %H:%M:%S") if dated else _number(value)
                if value is not None:
                    cells[place] = value
            if cells:
                yield at, cells
            data.clear()


def header_names(cells: dict[int, str]) -> list[str]:
    """Names of all columns up to the last: blank ones by place, repeated ones with a number."""
    out: list[str] = []
    for i in range(max(cells, default=-1) + 1):
        name = cells.get(i, "").strip() or f"Unnamed: {i}"
        same, k = name, 0
        while same.lower() in {x.lower() for x in out} | {"pos", "path"}:
            k += 1
            same = f"{name}.{k}"
        out.append(same)
    return out


def _header(book: zipfile.ZipFile, sheet: str | None, row: int) -> list[str]:
    for at, cells in sheet_rows(book, sheet):
        if at >= row:
            return header_names(cells) if at == row else []
    return []


@dataclass
class BookFile(InputPartition):
    path: str


class Workbook(DataSource):
    """path, pos (row from 0) and a text column for each name in the header row. Options: files (JSON list), sheet (its name;
    the first), header (its row from 0; 6)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _of(self) -> tuple[list[str], str | None, int]:
        return json.loads(self.options["files"]), self.options.get("sheet"), int(self.options.get("header", 6))

    def schema(self) -> str:
        files, sheet, row = self._of()
        with open_file(files[0]) as f, zipfile.ZipFile(f) as book:
            names = _header(book, sheet, row)
        quoted = ["`" + n.replace("`", "``") + "` string" for n in names]
        return ", ".join(["path string", "pos long", *quoted])

    def reader(self, schema) -> DataSourceReader:
        return _BookReader(*self._of(), schema.fieldNames()[2:])


class _BookReader(DataSourceReader):
    def __init__(self, files: list[str], sheet: str | None, row: int, names: list[str]):
        self.files, self.sheet, self.row, self.names = files, sheet, row, names

    def partitions(self) -> list[BookFile]:
        return [BookFile(f) for f in self.files]

    def read(self, partition: BookFile) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f, zipfile.ZipFile(f) as book:
            own: dict[str, int] | None = None
            rows: list[tuple[int, dict[int, str]]] = []
            for at, cells in sheet_rows(book, self.sheet):
                if at < self.row:
                    continue
                if own is None:
                    own = {n: i for i, n in enumerate(header_names(cells))} if at == self.row else {}
                    if at == self.row:
                        continue
                rows.append((at, cells))
                if len(rows) == _ROWS_A_BATCH:
                    yield self._batch(partition.path, rows, own)
                    rows = []
            if rows:
                yield self._batch(partition.path, rows, own or {})

    def _batch(self, path: str, rows: list, own: dict[str, int]) -> pa.RecordBatch:
        columns = [pa.array([c.get(own.get(n, -1)) for _, c in rows], pa.string()) for n in self.names]
        return pa.record_batch([pa.array([path] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), *columns], ["path", "pos", *self.names])


def read_workbooks(spark: SparkSession, where: str, sheet: str | None = None, header: int = 6) -> DataFrame:
    """The rows of a sheet below its header row, of a workbook or all workbooks of a folder."""
    files = [p for p, _ in listing(spark, where) if p.lower().endswith((".xlsx", ".xlsm"))]
    if not files:
        raise FileNotFoundError(f"no workbook at {where}")
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook").option("files", json.dumps(files)).option("header", str(header))
    return (reader if sheet is None else reader.option("sheet", sheet)).load()


# ---- writing ---------------------------------------------------------------------------

_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\r]|_x(?=[0-9A-Fa-f]{4}_)")


def cell(value: object) -> str:
    """A cell's XML. Texts are cut at the letters that the format allows."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = _BAD.sub(lambda m: "_x005F_x" if m[0] == "_x" else f"_x{ord(m[0]):04X}_", str(value)[:CELL_LETTERS])
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


@dataclass
class PartsWritten(WriterCommitMessage):
    partition: int
    #: File, rows, bytes as they are in XML, and checksum of each part.
    parts: list


class WorkbookSheet(DataSource):
    """The sink for one sheet's rows. Options: staging (a shared folder), sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook_sheet"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _SheetWriter(self.options["staging"], self.options["sheet"], schema.fieldNames(), int(self.options.get("part_rows", PART_ROWS)))


class _SheetWriter(DataSourceArrowWriter):
    def __init__(self, staging: str, sheet: str, names: list[str], part_rows: int):
        self.staging, self.sheet, self.names, self.part_rows = staging, sheet, names, part_rows
        self.job = uuid.uuid4().hex  # made on the driver, and so the same in all tasks

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartsWritten:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(self.staging)
        number, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        parts: list[list] = []
        stream = packed = None
        try:
            for batch in iterator:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if stream is None:
                        name = f"{self.sheet}-{self.job}-{number:06d}-{len(parts):04d}-{attempt}.part"
                        parts.append([name, 0, 0, 0])
                        stream, packed = fs.open_output_stream(f"{root}/{name}"), zlib.compressobj(6, zlib.DEFLATED, -15)
                    text = f"<row>{''.join(map(cell, row))}</row>".encode()
                    parts[-1][1:] = [parts[-1][1] + 1, parts[-1][2] + len(text), zlib.crc32(text, parts[-1][3])]
                    stream.write(packed.compress(text))
                    if parts[-1][1] == self.part_rows:
                        self._close(stream, packed)
                        stream = None
            if stream is not None:
                self._close(stream, packed)
                stream = None
        except BaseException:
            if stream is not None:
                stream.close()
            for p in parts:
                fs.delete_file(f"{root}/{p[0]}")
            raise
        return PartsWritten(number, parts)

    @staticmethod
    def _close(stream, packed) -> None:
        stream.write(packed.flush(zlib.Z_FINISH))
        stream.close()

    def commit(self, messages: list) -> None:
        """One list makes the sheet count: its names, and the parts by partition."""
        fs, root = pafs.FileSystem.from_uri(self.staging)
        parts = [p for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for p in m.parts]
        with fs.open_output_stream(f"{root}/{self.sheet}.json") as f:
            f.write(json.dumps({"names": self.names, "parts": parts}).encode())

    def abort(self, messages: list) -> None:
        """What all tasks of this write have left, also those that were killed and gave no message."""
        fs, root = pafs.FileSystem.from_uri(self.staging)
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.base_name.startswith(f"{self.sheet}-{self.job}-"):
                fs.delete_file(f.path)


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet_plan(name: str, listed: dict, most: int = SHEET_ROWS) -> list[tuple[str, list[str], list]]:
    """Sheets of a list of parts: name, column names, parts. More rows than a sheet takes go on in `name (2)` and so on."""
    out, rows = [(name[:31], listed["names"], [])], 1
    for p in listed["parts"]:
        if rows + p[1] > most and out[-1][2]:
            tail = f" ({len(out) + 1})"
            out.append((name[: 31 - len(tail)] + tail, listed["names"], []))
            rows = 1
        out[-1][2].append(p)
        rows += p[1]
    return out


def assemble(staging: str, target: str, order: list[str], most: int = SHEET_ROWS) -> int:
    """One workbook out of the parts that were committed, unpacked and packed again as they stream by; under its name once it
    is whole. Returns the number of sheets."""
    fs, root = pafs.FileSystem.from_uri(staging)
    where, at = pafs.FileSystem.from_uri(target)
    sheets = []
    for name in order:
        with fs.open_input_file(f"{root}/{name}.json") as f:
            sheets += sheet_plan(name, json.loads(f.read()), most)
    half = f"{at}.{uuid.uuid4().hex}"
    with where.open_output_stream(half) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", _HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + kinds + "</Types>")
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships {package}><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_NS} xmlns:r="{relation}"><sheets>' + "".join(f'<sheet name="{escape(s[0], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f"{_HEAD}<Relationships {package}>" + "".join(f'<Relationship Id="rId{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, names, parts) in enumerate(sheets, 1):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f"{_HEAD}<worksheet {_NS}><sheetData><row>{''.join(map(cell, names))}</row>".encode())
                for name, _, size, crc in parts:
                    _copy(fs, f"{root}/{name}", sheet, size, crc)
                sheet.write(b"</sheetData></worksheet>")
    if where.get_file_info(at).type == pafs.FileType.File:
        where.delete_file(at)
    where.move(half, at)
    return len(sheets)


def _copy(fs, path: str, sheet, size: int, crc: int) -> None:
    unpacked, seen, sums = zlib.decompressobj(-15), 0, 0
    with fs.open_input_file(path) as f:
        while block := f.read(1 << 20):
            text = unpacked.decompress(block)
            seen, sums = seen + len(text), zlib.crc32(text, sums)
            sheet.write(text)
    if (seen, sums) != (size, crc):
        raise ValueError(f"{path} is damaged")


def write_workbook(sheets: dict[str, DataFrame], path: str, staging: str, most: int = SHEET_ROWS, part_rows: int = PART_ROWS) -> None:
    """The sheets as one workbook; nested columns as JSON text, dates and decimals as text. staging: a shared folder of its own."""
    spark = next(iter(sheets.values())).sparkSession
    spark.dataSource.register(WorkbookSheet)
    fs, folder = hadoop(spark, staging)
    fs.mkdirs(folder)
    staging = qualified(fs.makeQualified(folder).toUri().toString())
    target_fs, target = hadoop(spark, path)
    target_fs.mkdirs(target.getParent())
    path = qualified(target_fs.makeQualified(target).toUri().toString())
    for name, df in sheets.items():
        flat = [F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") if t in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes]
        df.select(*flat).write.format("workbook_sheet").option("staging", staging).option("sheet", name).option("part_rows", str(part_rows)).mode("append").save()
    order = list(sheets)

    def one(batches):
        n = 0
        for b in batches:
            if b.num_rows:
                n += assemble(staging, path, order, most)
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    # one workbook is one file, of rows that its format bounds
    spark.range(1).coalesce(1).mapInArrow(one, "n long").collect()
    fs.delete(folder, True)
