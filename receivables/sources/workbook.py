"""SRC-7: spreadsheets (.xlsx) as a Spark data source, ``spark.read.format("workbook")``.

A path names one workbook or a folder of them. Every workbook is cut into ranges of rows by its sheet's stated dimension; each
range is a partition that streams the sheet and keeps its own rows, so no task holds more than a batch of rows, besides the
workbook's table of shared texts. The driver reads one header row.

Columns are the texts of the first row that holds any; all values are texts, as in a CSV: whole numbers without a fraction,
other numbers in their shortest form, dates (by the cell's number format) as ``yyyy-MM-dd HH:mm:ss``, truth values as ``true`` and
``false``. Blank cells, error cells and empty texts are NULL, rows without a value are left out. Blank headings become
``column_<n>``, repeated ones get their number. A dimension that is missing or too small only makes the last range longer.
All workbooks of a folder must have the same header.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import cached_property
from itertools import islice
from urllib.parse import urlparse
from xml.etree.ElementTree import Element, iterparse
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from receivables.functions.stored import workers_find_package

ROWS_PER_PARTITION = 200_000
BATCH = 10_000
# Number formats of dates and times that every workbook has.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
FIRST_DAY, FIRST_DAY_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    parts = urlparse(path)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def workbooks(path: str) -> list[str]:
    """The workbook at ``path`` or those in it, as paths of its file system."""
    system, place = opened(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [place]
    names = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith((".xlsx", ".xlsm"))]
    return sorted(n for n in names if not posixpath.basename(n).startswith((".", "_", "~")))


def _tag(element: Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _attribute(element: Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _text(element: Element) -> str:
    """The text of a cell or shared text: its runs, without reading aids."""
    return "".join((child.text or "") if _tag(child) == "t" else _text(child) if _tag(child) == "r" else "" for child in element)


def _elements(book: zipfile.ZipFile, part: str, *tags: str) -> Iterator[Element]:
    """The elements of a part with these tags, each whole, and dropped when the next one is asked for."""
    if part not in book.namelist():
        return
    with book.open(part) as f:
        parents: list[Element] = []
        for event, element in iterparse(f, events=("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if _tag(element) in tags:
                yield element
                if parents:
                    parents[-1].remove(element)


class Book:
    """An open workbook: where its sheet is, its shared texts and which cell styles are dates."""

    def __init__(self, system: fs.FileSystem, path: str, sheet: str | None):
        self.zip = zipfile.ZipFile(system.open_input_file(path))
        sheets = [(s.get("name"), _attribute(s, "id")) for s in _elements(self.zip, "xl/workbook.xml", "sheet")]
        wanted = next((i for name, i in sheets if sheet is None or name == sheet), None)
        if wanted is None:
            raise ValueError(f"{path} has no sheet {sheet!r}")
        targets = {r.get("Id"): r.get("Target") for r in _elements(self.zip, "xl/_rels/workbook.xml.rels", "Relationship")}
        self.part = posixpath.normpath(posixpath.join("/xl", targets[wanted])).lstrip("/")
        self.first_day = FIRST_DAY
        for properties in _elements(self.zip, "xl/workbook.xml", "workbookPr"):
            if properties.get("date1904") in ("1", "true"):
                self.first_day = FIRST_DAY_1904

    def last_row(self) -> int | None:
        """The last row of the stated dimension."""
        for element in _elements(self.zip, self.part, "dimension", "row"):
            end = re.search(r"(\d+)$", element.get("ref", "")) if _tag(element) == "dimension" else None
            return int(end.group(1)) if end else None
        return None

    def rows(self) -> Iterator[tuple[int, dict[int, str]]]:
        """(number, column -> text) of every row that holds a text. A sheet has most of a workbook's elements: it is read by the
        parser's events, without objects for its elements."""
        if self.part not in self.zip.namelist():
            return
        found: list[tuple[int, dict[int, str]]] = []
        number, column, cells, path, attributes, texts, seen = 0, -1, None, [], {}, [], set()

        def start(name: str, given: dict[str, str]) -> None:
            nonlocal number, column, cells, attributes
            name = name.rpartition(":")[2]
            if cells is None:
                if name == "row":
                    number, column, cells = int(given.get("r", number + 1)), -1, {}
                return
            path.append(name)
            if len(path) == 1:
                column, attributes = _column(given["r"]) if given.get("r") else column + 1, given
                texts.clear()
                seen.clear()
            elif (len(path) == 2 and name == ("is" if attributes.get("t") == "inlineStr" else "v") and name not in seen) or (
                len(path) > 2 and name == "t" and "is" in seen and path[1] == "is" and all(p == "r" for p in path[2:-1])
            ):
                seen.add(name)
                if name != "is":
                    parser.CharacterDataHandler = texts.append

        def end(name: str) -> None:
            nonlocal cells
            if cells is None:
                return
            parser.CharacterDataHandler = None
            if path:
                path.pop()
                if not path and texts:
                    text = self._value(attributes.get("t", "n"), attributes.get("s", 0), "".join(texts))
                    if text:
                        cells[column] = text
                return
            if cells:
                found.append((number, cells))
            cells = None

        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler = start, end
        with self.zip.open(self.part) as f:
            while chunk := f.read(1 << 18):
                parser.Parse(chunk, False)
                yield from found
                found.clear()
            parser.Parse(b"", True)
            yield from found

    @cached_property
    def shared(self) -> list[str]:
        return [_text(e) for e in _elements(self.zip, "xl/sharedStrings.xml", "si")]

    @cached_property
    def dated(self) -> set[int]:
        """The cell styles that show dates or times."""
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _elements(self.zip, "xl/styles.xml", "numFmt")}
        # Letters of dates outside quoted texts, escaped characters and bracketed colours or locales (elapsed hours count).
        plain = {k: re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower()) for k, code in own.items()}
        dates = DATE_FORMATS - set(own) | {k for k, code in plain.items() if re.search("[ymdhs]", code.replace("general", ""))}
        for formats in _elements(self.zip, "xl/styles.xml", "cellXfs"):
            return {k for k, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in dates}
        return set()

    def _value(self, kind: str, style: str | int, value: str) -> str | None:
        if kind == "inlineStr":
            return value
        if kind == "e":
            return None
        if kind == "s":
            return self.shared[int(value)]
        if kind == "b":
            return "true" if value.strip() == "1" else "false"
        if kind != "n":
            return value
        x = float(value)
        if int(style) in self.dated:
            try:
                return self._date(x)
            except OverflowError:
                pass  # beyond the calendar: stays a number
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)

    def _date(self, serial: float) -> str:
        if self.first_day == FIRST_DAY and 1 <= serial < 60:
            serial += 1  # the format counts a 29 February 1900, which never was
        at = self.first_day + dt.timedelta(seconds=round(serial * 86_400))
        return at.strftime("%H:%M:%S") if 0 <= serial < 1 else at.isoformat(sep=" ")


def _column(reference: str) -> int:
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _header(book: Book) -> tuple[int, list[str]]:
    """The number of the header row, and the names of its columns."""
    number, cells = next(book.rows(), (0, {}))
    names: list[str] = []
    for k in range(max(cells, default=-1) + 1):
        name = cells.get(k, "").strip() or f"column_{k + 1}"
        names.append(name if name not in names else f"{name}_{k + 1}")
    return number, names


class Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int | None):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class WorkbookReader(DataSourceReader):
    def __init__(self, names: list[str], options: dict[str, str]):
        self.names = names
        self.path, self.sheet = options["path"], options.get("sheet")
        self.step = int(options.get("rowsperpartition", ROWS_PER_PARTITION))  # Spark hands over option names in lower case

    def partitions(self) -> list[Rows]:
        system, out = opened(self.path)[0], []
        for path in workbooks(self.path):
            last = Book(system, path, self.sheet).last_row() or 1
            starts = list(range(1, last + 1, self.step))
            out += [Rows(path, a, b - 1) for a, b in zip(starts, starts[1:])] + [Rows(path, starts[-1], None)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        book = Book(opened(self.path)[0], partition.path, self.sheet)
        above, names = _header(book)
        if names != self.names:
            raise ValueError(f"{partition.path} has the columns {names}, not {self.names}")
        kept: list[dict[int, str]] = []
        for number, cells in book.rows():
            if partition.last is not None and number > partition.last:
                break
            if number >= partition.first and number > above:
                kept.append(cells)
                if len(kept) == BATCH:
                    yield self._batch(kept)
                    kept = []
        if kept:
            yield self._batch(kept)

    def _batch(self, rows: list[dict[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], pa.string()) for k in range(len(self.names))], self.names)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        found = workbooks(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no workbook in {self.options['path']}")
        names = _header(Book(opened(self.options["path"])[0], found[0], self.options.get("sheet")))[1]
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema.names, dict(self.options))


def read(spark: SparkSession, path: str, sheet: str | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The rows of a workbook's first (or named) sheet, or of all workbooks in a folder."""
    workers_find_package(spark)
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("rowsPerPartition", rows_per_partition)
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
SHEET_ROWS = 1_000_000  # of a written workbook, with the header below the format's 1,048,576
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
MARKUP = re.compile("[&<>\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _inline(value) -> str:
    text = str(value)
    if MARKUP.search(text):
        text = escape(NOT_XML.sub("", text))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _day(value: dt.date) -> str:
    at = value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
    return f'<c s="1"><v>{(at - FIRST_DAY) / dt.timedelta(days=1)!r}</v></c>'


def _cells(column: pa.Array) -> list[str]:
    """The cells of a column's values."""
    t = column.type
    if pa.types.is_boolean(t):
        cell = lambda v: f'<c t="b"><v>{int(v)}</v></c>'
    elif pa.types.is_integer(t) or pa.types.is_floating(t):
        cell = lambda v: f"<c><v>{v!r}</v></c>"
    else:
        cell = _day if pa.types.is_date(t) or pa.types.is_timestamp(t) else _inline
    return ["<c/>" if v is None else cell(v) for v in column.to_pylist()]


def save(df: DataFrame, folder: str) -> None:
    """Each partition as workbooks of at most ``SHEET_ROWS`` rows in ``folder``. A task that runs twice writes the same names;
    a workbook gets its name when it is whole. Characters that XML does not know are left out."""
    workers_find_package(df.sparkSession)
    system, place = opened(folder)
    system.create_dir(place, recursive=True)
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt, (system, place) = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), opened(folder)
        rows = ("<row>" + "".join(cells) + "</row>" for batch in batches for cells in zip(*map(_cells, batch.columns), strict=True))
        part, row = 0, next(rows, None)
        while row is not None:
            name = f"part-{task:06}-{part:04}.xlsx"
            # The quick level: the texts are repetitive, and the files are read once or a few times.
            with system.open_output_stream(f"{place}/_{name}-{attempt}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
                for path, text in PARTS.items():
                    book.writestr(path, text)
                with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                    sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    sheet.write(("<row>" + "".join(map(_inline, names)) + "</row>").encode())
                    left, lines = SHEET_ROWS, [row]
                    while lines:
                        sheet.write("".join(lines).encode())
                        left -= len(lines)
                        lines = list(islice(rows, min(left, 1000)))
                    sheet.write(b"</sheetData></worksheet>")
            row = next(rows, None)
            system.move(f"{place}/_{name}-{attempt}", f"{place}/{name}")
            part += 1
        yield pa.RecordBatch.from_arrays([pa.array([part])], ["workbooks"])

    df.mapInArrow(write, "workbooks long").agg({"workbooks": "sum"}).collect()
