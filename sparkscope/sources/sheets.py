"""Spreadsheets (.xlsx, .xlsm) as a data source of their own, with a partition for each sheet, and as a sink for reports.

The source gives raw rows; headers, types and the choice of a sheet are operations on its rows. A sheet's XML is read
as a stream; only the file's table of shared texts is held.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import unique_names

RAW = "path string, sheet string, place int, row int, cells array<struct<kind: string, text: string>>"
#: Rows of a sheet that the format allows, with the header.
MOST_ROWS = 1_048_576
# Numbers of the built-in formats that are dates or times, and the parts of a written format that make it one.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DATE_PARTS = re.compile(r"[dmyhs]", re.I)
_QUOTED = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)


def _opened(path: str) -> zipfile.ZipFile:
    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else f"/{path}")
    return zipfile.ZipFile(store.open_input_file(inner))


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _root(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _children(e, name: str) -> list:
    return [x for x in e if _plain(x.tag) == name] if e is not None else []


def _inner_text(e) -> str:
    """The text of an item: its runs, without phonetic hints."""
    return "".join(x.text or "" for part in [e, *_children(e, "r")] for x in _children(part, "t"))


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    place: int
    member: str


def sheets_of(path: str) -> list[Sheet]:
    """The sheets of a file in order. A ValueError says that it is none."""
    try:
        with _opened(path) as z:
            book, links = _root(z, "xl/workbook.xml"), _root(z, "xl/_rels/workbook.xml.rels")
            target = {x.get("Id"): x.get("Target") for x in links} if links is not None else {}
            found = [x for s in _children(book, "sheets") for x in s]
            member = lambda s: target.get(next((v for k, v in s.attrib.items() if _plain(k) == "id" and k != "id"), None), "")
            place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
            made = [Sheet(path, s.get("name"), i, place(member(s))) for i, s in enumerate(found)]
            return [s for s in made if s.member in z.namelist() and "worksheets/" in s.member]
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise ValueError(f"{path} is no spreadsheet of this format") from e


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    root = _root(z, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for x in _children(root, "numFmts") for f in x}
    is_date = lambda n: bool(DATE_PARTS.search(_QUOTED.sub("", own[n]))) if n in own else n in DATE_FORMATS
    return {i for x in _children(root, "cellXfs") for i, f in enumerate(x) if is_date(int(f.get("numFmtId") or 0))}


def moment(serial: float, since_1904: bool = False) -> str:
    """The date and time of a serial number, to the millisecond. The 1900 system counts a 29 February 1900 that never was."""
    base = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30 if serial >= 60 else 31)
    return (base + datetime.timedelta(milliseconds=round(serial * 86_400_000))).isoformat(sep=" ", timespec="milliseconds")


def column_of(reference: str) -> int:
    """The place, from 0, of a cell's column: A, B, ..., Z, AA."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(c, texts: list[str], dates: set[int], since_1904: bool) -> tuple[str, str] | None:
    kind, v = c.get("t", "n"), next((x.text for x in c if _plain(x.tag) == "v"), None)
    if kind == "inlineStr":
        found = "".join(_inner_text(x) for x in _children(c, "is"))
        return ("text", found) if found else None
    if not v or kind == "e":
        return None
    if kind == "s":
        return ("text", texts[int(v)]) if texts[int(v)] else None
    if kind == "b":
        return "flag", "true" if v.strip() in ("1", "true") else "false"
    if kind == "d":
        return "date", v.replace("T", " ").rstrip("Z")
    if kind != "n":
        return "text", v
    return ("date", moment(float(v), since_1904)) if int(c.get("s") or 0) in dates else ("number", v)


def rows_of(sheet: Sheet) -> Iterator[tuple]:
    """(path, sheet, place, row, cells) of each row that has a cell with a value."""
    with _opened(sheet.path) as z:
        texts = [_inner_text(si) for si in _children(_root(z, "xl/sharedStrings.xml"), "si")]
        book, dates, at = _root(z, "xl/workbook.xml"), _date_styles(z), 0
        since_1904 = any(x.get("date1904") in ("1", "true") for x in _children(book, "workbookPr"))
        with z.open(sheet.member) as f:
            for _, e in ElementTree.iterparse(f):
                if _plain(e.tag) != "row":
                    continue
                at, cells = int(e.get("r") or at + 1), []
                for c in _children(e, "c"):
                    place = column_of(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (place - len(cells))
                    cells.append(_cell(c, texts, dates, since_1904))
                e.clear()
                while cells and cells[-1] is None:
                    cells.pop()
                if cells:
                    yield sheet.path, sheet.name, sheet.place, at, cells


class SheetSource(DataSource):
    """spark.read.format("sheets").option("paths", ...): the raw rows of all sheets of some files, separated by line feeds."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SheetReader(self.options["paths"].split("\n"))


class SheetReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Sheet]:
        return [s for p in self.paths for s in sheets_of(p)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        return rows_of(partition)


def raw_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sheet, place, row, cells) of all rows of all sheets."""
    spark.dataSource.register(SheetSource)
    return spark.read.format("sheets").option("paths", "\n".join(paths)).load()


def fullest_sheets(raw: DataFrame) -> DataFrame:
    """(path, sheet, place, rows): the sheet with most rows of each file, the first of equals."""
    sizes = raw.groupBy("path", "sheet", "place").agg(F.count("*").alias("rows"))
    return sizes.groupBy("path").agg(F.max_by(F.struct("sheet", "place", "rows"), F.struct("rows", -F.col("place"))).alias("s")).select("path", "s.*")


def table_of(raw: DataFrame) -> DataFrame:
    """The rows of one sheet as a table: the first row names the columns, a column's type is what all its cells are.

    Numbers are bigint if all are whole, else double; dates are timestamp_ntz, flags boolean; cells of several kinds make a text column, in which numbers
    and dates are written as they stand in the file. A column without a value is text. A sheet without rows has no columns: a ValueError.
    """
    head = raw.orderBy("row").first()
    if head is None:
        raise ValueError("the sheet is empty")
    body = raw.where(F.col("row") > head["row"])
    width = max(len(head["cells"]), body.agg(F.max(F.size("cells"))).first()[0] or 0)
    at = lambda i: F.get("cells", F.lit(i))
    kinds = ("number", "date", "flag", "text")
    whole = lambda i: F.bool_and((at(i)["kind"] != "number") | ~at(i)["text"].rlike("[.eE]") & at(i)["text"].try_cast("long").isNotNull())
    stats = body.agg(*[F.struct(*[F.count_if(at(i)["kind"] == k).alias(k) for k in kinds], whole(i).alias("whole")).alias(f"c{i}") for i in range(width)]).first()

    def column(i: int) -> Column:
        s, text = stats[f"c{i}"], at(i)["text"]
        only = [k for k in kinds if s[k]]
        if len(only) != 1 or only == ["text"]:
            return text
        return text.cast({"number": "long" if s["whole"] else "double", "date": "timestamp_ntz", "flag": "boolean"}[only[0]])

    names = unique_names([(c["text"] if c else "") for c in head["cells"]] + [""] * (width - len(head["cells"])))
    return body.select(*[column(i).alias(n) for i, n in enumerate(names)])


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a file as a table, by default the one with most rows."""
    raw = raw_rows(spark, [path])
    if sheet is None:
        best = fullest_sheets(raw).first()
        if best is None:
            raise ValueError(f"{path} has no rows")
        sheet = best["sheet"]
    return table_of(raw.where(F.col("sheet") == sheet))


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN, _LINKS, _PACKAGE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"


def letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _written(reference: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{reference}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, datetime.date):
        full = v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day)
        days = (full.replace(tzinfo=None) - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
        if days >= 60:
            return f'<c r="{reference}" s="1"><v>{days!r}</v></c>'
        v = full.isoformat(sep=" ")
    # Numbers that the format would round are texts.
    if isinstance(v, (int, float)) and abs(v) < 1e15 and v == v:
        return f'<c r="{reference}"><v>{v!r}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A spreadsheet with a sheet for each frame, for reports: what a person reads. A ValueError says that a frame has more rows than a sheet can hold."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, df in enumerate(sheets.values(), 1):
            rows = df.limit(MOST_ROWS).collect()
            if len(rows) == MOST_ROWS:
                raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for n, row in enumerate([df.columns, *rows], 1):
                    f.write(f'<row r="{n}">{"".join(_written(f"{letters(k)}{n}", v) for k, v in enumerate(row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
        numbers = range(1, len(sheets) + 1)
        names = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(numbers, sheets))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{names}</sheets></workbook>')
        parts = "".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{parts}<Relationship Id="rId0" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>{types}</Types>')
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner, compression=None) as f:
        f.write(out.getvalue())
