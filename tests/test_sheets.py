"""Spreadsheets made here, by hand and by the library's own sink."""

import datetime
import zipfile

import pytest

from sparkscope.sources import sheets as X
from sparkscope.sources import tables as S

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def made(path, rows, shared=(), styles="", date1904=False, more=None):
    """A file with a sheet of these rows of XML, and further sheets."""
    sheets = {"First": rows} | (more or {})
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr{" date1904=\"1\"" if date1904 else ""}/><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i == 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
        for i, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
    return f"file://{path}"


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/><numFmt numFmtId="166" formatCode="[Red]0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs>'


def test_shared_texts_dates_types_and_gaps(spark, tmp_path):
    shared = ["<t>id</t>", "<t>na</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>", "<t></t>"]
    rows = """<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>day</t></is></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="s"><v>1</v></c><c r="F2" t="str"><v>flag</v></c><c r="G2" t="str"><v>mixed</v></c></row>
<row r="4"><c r="A4"><v>1</v></c><c r="B4" s="1"><v>45000.5</v></c><c r="C4" t="s"><v>2</v></c><c r="D4" s="3"><v>1.5</v></c><c r="F4" t="b"><v>1</v></c><c r="G4"><v>7</v></c></row>
<row r="5"><c r="A5"><v>9007199254740993</v></c><c r="B5" s="2"><v>59</v></c><c r="C5" t="s"><v>3</v></c><c r="D5" s="4"><v>2</v></c><c r="F5" t="b"><v>0</v></c><c r="G5" t="str"><v>x</v></c></row>
<row r="6"/><row r="7"><c r="A7" t="e"><v>#N/A</v></c><c r="G7" s="1"><v>61</v></c></row>"""
    df = X.read_sheet(spark, made(tmp_path / "a.xlsx", rows, shared, STYLES))
    assert df.dtypes == [("id", "bigint"), ("day", "timestamp_ntz"), ("na", "string"), ("na_1", "double"), ("Unnamed_4", "string"), ("flag", "boolean"), ("mixed", "string")]
    d = datetime.datetime
    assert [tuple(r) for r in df.collect()] == [
        (1, d(2023, 3, 15, 12), "rich text", 1.5, None, True, "7"), (9007199254740993, d(1900, 2, 28), None, 2.0, None, False, "x"), (None, None, None, None, None, None, "1900-03-01 00:00:00.000"),
    ]


def test_the_fullest_sheet_is_read_and_each_is_a_partition(spark, tmp_path):
    row = lambda n, v: f'<row r="{n}"><c r="A{n}"><v>{v}</v></c><c r="AB{n}"><v>{v}</v></c></row>'
    path = made(tmp_path / "b.xlsx", row(1, 0) + row(2, 1), more={"Big": "".join(row(i, i) for i in range(1, 50)), "Also big": "".join(row(i, -i) for i in range(1, 50)), "None": ""})
    raw = X.raw_rows(spark, [path, path])
    assert raw.rdd.getNumPartitions() == 8 and raw.count() == 200
    assert [(r["sheet"], r["rows"]) for r in X.fullest_sheets(raw).collect()] == [("Big", 98)]
    assert len(X.read_sheet(spark, path).columns) == 28 and X.read_sheet(spark, path, "First").count() == 1
    with pytest.raises(ValueError):
        X.read_sheet(spark, path, "None")


def test_moments_columns_and_other_files(spark, tmp_path):
    assert (X.moment(1), X.moment(60.25), X.moment(0, True)) == ("1900-01-01 00:00:00.000", "1900-02-28 06:00:00.000", "1904-01-01 00:00:00.000")
    assert [X.column_of(f"{X.letters(i)}1") for i in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    with pytest.raises(ValueError):
        X.sheets_of(f"file://{tmp_path}/c.xlsx")
    path = made(tmp_path / "d.xlsx", '<row><c><v>1</v></c><c s="1"><v>2</v></c></row><row><c><v>3</v></c><c s="1"><v>2</v></c></row>', styles=STYLES, date1904=True)
    assert X.read_sheet(spark, path).first()[1] == datetime.datetime(1904, 1, 3)


def test_written_sheets_come_back(spark, tmp_path):
    d = datetime.datetime
    rows = [(1, 'a & "b" <c>', 1.5, True, d(2024, 2, 29, 13, 30), datetime.date(2020, 1, 2), 1 << 62), (2, None, None, False, None, None, 5), (-3, " x\x00 ", 1e-7, None, d(1999, 12, 31, 23, 59, 59), None, None)]
    df = spark.createDataFrame(rows, "id long, text string, v double, flag boolean, at timestamp_ntz, day date, big long")
    path = f"file://{tmp_path}/out/r.xlsx"
    X.write_sheets({"Report": df, "Sizes & more": df.groupBy("flag").count()}, path)
    back = S.read_excel(spark, path)
    assert back.dtypes == [("id", "bigint"), ("text", "string"), ("v", "double"), ("flag", "boolean"), ("at", "timestamp_ntz"), ("day", "timestamp_ntz"), ("big", "string")]
    assert [tuple(r) for r in back.collect()] == [(1, 'a & "b" <c>', 1.5, True, rows[0][4], d(2020, 1, 2), str(1 << 62)), (2, None, None, False, None, None, "5"), (-3, " x ", 1e-7, None, rows[2][4], None, None)]
    assert X.read_sheet(spark, path, "Sizes & more").columns == ["flag", "count"]
    assert [*S.load_tables(spark, [path])] == [path]
