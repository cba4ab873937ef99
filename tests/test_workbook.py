"""Workbooks read without a library, and written by tasks that commit."""

from __future__ import annotations

import os
import zipfile

import pyarrow as pa
import pytest

from tallyforge.sources import readers, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheets, shared=(), styles="", props=""):
    """A workbook out of the sheets' XML."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}">{props}<sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="x{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="x{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        for i, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{xml}</sheetData></worksheet>")


SHARED = ["<t>Investors</t>", "<t>Note</t>", "<r><t>Ac</t></r><r><t xml:space='preserve'>me </t></r><rPh><t>no</t></rPh>", "<t>a_x000A_b &amp; c</t>", "<t>acme</t>"]
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="[Red]0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
ROWS = """<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row>
<row r="7"><c r="B7" t="s"><v>0</v></c><c r="C7" t="s"><v>1</v></c><c r="E7" t="s"><v>1</v></c></row>
<row r="9"><c r="B9" t="s"><v>2</v></c><c r="C9" t="s"><v>3</v></c><c r="D9"><v>5</v></c><c r="E9" s="1"><v>45292.5</v></c></row>
<row r="10"><c r="A10"/></row>
<row><c r="B11" t="s"><v>4</v></c><c><v>1.50</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c></row>
<row r="12"><c r="B12" t="s"><v>2</v></c><c r="C12" s="3"><v>2</v></c><c r="D12" t="str"><f>x</f><v>said</v></c><c r="E12" s="2"><v>1</v></c></row>"""


def test_rows_under_a_header(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"other": "<row><c><v>1</v></c></row>", "data": ROWS}, SHARED, STYLES)
    df = workbook.read_workbooks(spark, f"{tmp_path}/a.xlsx", "data")
    assert df.columns == ["path", "pos", "Unnamed: 0", "Investors", "Note", "Unnamed: 3", "Note.1"]
    assert [tuple(r)[1:] for r in df.collect()] == [(8, None, "Acme ", "a\nb & c", "5", "2024-01-01 12:00:00"), (10, None, "acme", "1.5", "true", None), (11, None, "Acme ", "2", "said", "1899-12-31 00:00:00")]
    got = readers.load_investors(spark, f"{tmp_path}/a.xlsx", {"Investors": "name", "Note": "note", "No such": "gone"}, sheet="data")
    # the same name in other letters is another investor
    assert [(r.name, r.note, r.gone) for r in got.orderBy("pos").collect()] == [("Acme", "a\nb & c", ""), ("acme", "1.5", "")]
    assert workbook.read_workbooks(spark, f"{tmp_path}/a.xlsx", None, 0).columns == ["path", "pos", "1"]
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_workbooks(spark, f"{tmp_path}/a.xlsx", "none")


def test_dates_of_1904(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"s": '<row><c t="str"><v>d</v></c></row><row><c s="1"><v>1</v></c></row>'}, styles=STYLES, props='<workbookPr date1904="1"/>')
    assert [r.d for r in workbook.read_workbooks(spark, f"{tmp_path}/a.xlsx", header=0).collect()] == ["1904-01-02 00:00:00"]


def test_what_is_written_is_read(spark, tmp_path):
    texts = ["plain", " two  blanks ", "<&>\"'", "line\nbreak\r\n\ttab", "bell \x07 and _x0007_ and _x", "漢字 😀", "", None, "x" * 40_000]
    rows = [(i, t, i / 3, i % 2 == 0, [i], {"a": t or ""}) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, x double, b boolean, l array<int>, `m.n` map<string,string>").coalesce(1)
    many = spark.range(250).repartitionByRange(7, "id").selectExpr("id", "CAST(id AS DECIMAL(10,2)) d", "DATE'2024-01-01' day")
    at = f"{tmp_path}/out/b.xlsx"
    workbook.write_workbook({"odd": df, "many": many, "none": many.limit(0)}, at, f"{tmp_path}/staging", most=100, part_rows=20)
    assert not os.path.exists(f"{tmp_path}/staging") and os.listdir(f"{tmp_path}/out") == ["b.xlsx"]
    got = workbook.read_workbooks(spark, at, "odd", 0).collect()
    assert [r.text for r in got] == [None if t is None else t[:32_767] for t in texts]
    assert [(int(r.id), float(r.x), r.b, r.l) for r in got] == [(i, i / 3, str(i % 2 == 0).lower(), f"[{i}]") for i in range(len(texts))]
    # a sheet of more rows than fit goes on in further ones, in order
    parts = [workbook.read_workbooks(spark, at, n, 0).collect() for n in ("many", "many (2)", "many (3)")]
    ids = [int(r.id) for p in parts for r in p]
    assert ids == list(range(250)) and all(len(p) <= 99 for p in parts) and parts[0][0].d == "0.00" and parts[0][0].day == "2024-01-01"
    assert workbook.read_workbooks(spark, at, "none", 0).columns == ["path", "pos", "id", "d", "day"] and workbook.read_workbooks(spark, at, "none", 0).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    staging = tmp_path / "staging"
    staging.mkdir()
    spark.dataSource.register(workbook.WorkbookSheet)
    bad = spark.range(100).repartitionByRange(4, "id").selectExpr("id", "IF(id = 97, raise_error('lost'), 'x') AS t")
    with pytest.raises(Exception, match="lost"):
        bad.write.format("workbook_sheet").option("staging", f"file://{staging}").option("sheet", "s").option("part_rows", "10").mode("append").save()
    # no list, so the sheet is not there; written again, it has its rows once, whatever the lost tasks may have left
    assert not os.path.exists(staging / "s.json")
    with pytest.raises(FileNotFoundError):
        workbook.assemble(f"file://{staging}", f"file://{tmp_path}/b.xlsx", ["s"])
    spark.range(100).repartitionByRange(4, "id").write.format("workbook_sheet").option("staging", f"file://{staging}").option("sheet", "s").option("part_rows", "10").mode("append").save()
    workbook.assemble(f"file://{staging}", f"file://{tmp_path}/b.xlsx", ["s"])
    assert [int(r.id) for r in workbook.read_workbooks(spark, f"{tmp_path}/b.xlsx", "s", 0).collect()] == list(range(100))


def test_a_broken_off_write_deletes_its_parts(tmp_path, monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    writer = workbook._SheetWriter(f"file://{tmp_path}", "s", ["a"], 2)
    (tmp_path / "s-other-000000.part").write_text("of another write")

    def rows(fail):
        yield pa.record_batch([pa.array([1, 2, 3])], ["a"])
        if fail:
            raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        writer.write(rows(True))
    assert len(os.listdir(tmp_path)) == 1
    done = writer.write(rows(False))
    assert done.partition == 3 and [p[1] for p in done.parts] == [2, 1] and len(os.listdir(tmp_path)) == 3
    # what tasks left that could not say so goes too, and nothing else
    writer.abort([None])
    assert os.listdir(tmp_path) == ["s-other-000000.part"]


def test_damage_is_found(spark, tmp_path):
    df = spark.range(10)
    spark.dataSource.register(workbook.WorkbookSheet)
    (tmp_path / "p").mkdir()
    df.coalesce(1).write.format("workbook_sheet").option("staging", f"file://{tmp_path}/p").option("sheet", "s").mode("append").save()
    part = next(f for f in os.listdir(tmp_path / "p") if f.endswith(".part"))
    data = (tmp_path / "p" / part).read_bytes()
    (tmp_path / "p" / part).write_bytes(data[: len(data) // 2])
    with pytest.raises(ValueError, match="damaged"):
        workbook.assemble(f"file://{tmp_path}/p", f"file://{tmp_path}/b.xlsx", ["s"])
    assert not os.path.exists(tmp_path / "b.xlsx")
