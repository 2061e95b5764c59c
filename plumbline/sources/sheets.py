"""Spreadsheets (.xlsx) as a data source of Spark: ``spark.read.format("sheet").option(...).load(path)``.

A workbook is a zip of XML parts, read with the standard library.  Every cell reads as text, as it is stored: numbers
without a trailing .0, dates as ISO where the cell's format is one, booleans as true and false, errors as null.  A sheet
is dealt to tasks by ranges of its rows; a task streams the sheet's XML and keeps its own range, so no task holds a sheet.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

ROWS = 50_000  # rows of a task
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATES = {*range(14, 23), 45, 46, 47}  # fixed values: built-in number formats of dates and times
_LAST = 1_048_576


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def parse_range(text: str) -> tuple[int, int, int, int | None]:
    """(first row, first column, last row, last column or None) of B3:F, B3:F20, B3, B:F, 3:20 or nothing."""
    t = (text or "").strip().replace("$", "")
    if not t:
        return 1, 1, _LAST, None
    m = re.fullmatch(r"([A-Za-z]{0,3})(\d*)(?::([A-Za-z]{0,3})(\d*))?", t)
    if not m or not any(m.groups()):
        raise ValueError(f"{text!r} is no range; write it as B3, B3:F or B3:F20")
    first = int(m[2] or 1), column_number(m[1]) if m[1] else 1
    last = int(m[4]) if m[4] else _LAST, column_number(m[3]) if m[3] else None
    if last[0] < first[0] or last[1] is not None and last[1] < first[1] or 0 in first:
        raise ValueError(f"{text!r} ends before it begins")
    return first[0], first[1], last[0], last[1]


class Workbook:
    def __init__(self, content):
        self.zip = zipfile.ZipFile(content)
        names = set(self.zip.namelist())
        if "xl/workbook.xml" not in names:
            raise ValueError("this is no .xlsx workbook; save it as one")
        targets = {e.get("Id"): e.get("Target") for _, e in iterparse(self.zip.open("xl/_rels/workbook.xml.rels")) if e.tag.endswith("Relationship")}
        self.sheets, self.hidden, self.from_1904 = {}, set(), False
        for _, e in iterparse(self.zip.open("xl/workbook.xml")):
            if e.tag == f"{_MAIN}sheet":
                target = targets[e.get(_REL)]
                self.sheets[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if e.get("state", "visible") != "visible":
                    self.hidden.add(e.get("name"))
            elif e.tag == f"{_MAIN}workbookPr":
                self.from_1904 = e.get("date1904") in ("1", "true")
        self.shared = self._shared() if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _shared(self) -> list[str]:
        out = []
        for _, e in iterparse(self.zip.open("xl/sharedStrings.xml")):
            if e.tag == f"{_MAIN}si":
                out.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                e.clear()
        return out

    def _date_styles(self) -> set[int]:
        own, styles, within = {}, set(), False
        for event, e in iterparse(self.zip.open("xl/styles.xml"), ("start", "end")):
            if e.tag == f"{_MAIN}cellXfs":
                within = event == "start"
                if event == "end":
                    styles = {i for i, x in enumerate(e) if int(x.get("numFmtId", 0)) in _DATES or self._is_date(own.get(int(x.get("numFmtId", 0)), ""))}
            elif e.tag == f"{_MAIN}numFmt" and event == "start" and not within:
                own[int(e.get("numFmtId"))] = e.get("formatCode", "")
        return styles

    @staticmethod
    def _is_date(code: str) -> bool:
        bare = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", code, flags=re.I)
        return bool(re.search("[dmyhs]", bare, re.I)) and "general" not in bare.lower()

    def sheet(self, name: str = "") -> str:
        """The sheet's own name: as given, whatever its case, or the first visible one."""
        visible = [s for s in self.sheets if s not in self.hidden]
        if not name:
            if not visible:
                raise ValueError("the workbook has no visible sheet")
            return visible[0]
        for s in self.sheets:
            if s.lower() == name.strip().lower():
                return s
        raise ValueError(f"there is no sheet {name!r}; there are {', '.join(visible)}")

    def _text(self, cell) -> str | None:
        kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or value.text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(value.text)]
        if kind == "b":
            return "true" if value.text == "1" else "false"
        if kind in ("str", "d"):
            return value.text
        number = float(value.text)
        if int(cell.get("s", 0)) in self.dates:
            return self._date(number)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def _date(self, days: float) -> str:
        if self.from_1904:
            days += 1462
        if days < 1:  # a time of day alone
            return (datetime(1900, 1, 1) + timedelta(seconds=round(days * 86400))).strftime("%H:%M:%S")
        # the format counts a 29 February 1900 that never was
        at = datetime(1899, 12, 30) + timedelta(days=days + (days < 60))
        at = (at + timedelta(microseconds=500)).replace(microsecond=0) if abs(days * 86400 - round(days * 86400)) < 1e-3 else at
        return at.strftime("%Y-%m-%d") if (at.hour, at.minute, at.second, at.microsecond) == (0, 0, 0, 0) else at.strftime("%Y-%m-%d %H:%M:%S")

    def rows(self, sheet: str, first: int, last: int) -> Iterator[tuple[int, dict[int, str]]]:
        """(row number, column number: text) of the rows that have a value, in the sheet's order."""
        at = 0
        with self.zip.open(self.sheets[sheet]) as part:
            for event, e in iterparse(part, ("start", "end")):
                if event == "start":
                    if e.tag == f"{_MAIN}row":
                        at = int(e.get("r", at + 1))
                        if at > last:
                            return
                elif e.tag == f"{_MAIN}row":
                    if at >= first:
                        cells, column = {}, 0
                        for c in e.iter(f"{_MAIN}c"):
                            ref = re.match("[A-Za-z]+", c.get("r", ""))
                            column = column_number(ref[0]) if ref else column + 1
                            text = self._text(c)
                            if text is not None and text != "":
                                cells[column] = text
                        if cells:
                            yield at, cells
                    e.clear()

    def used(self, sheet: str) -> int:
        """The last row that the sheet says it has; where it doesn't say, the last that it has."""
        last = 0
        with self.zip.open(self.sheets[sheet]) as part:
            for event, e in iterparse(part, ("start", "end")):
                if e.tag == f"{_MAIN}dimension" and event == "start" and (end := re.search(r":[A-Za-z]+(\d+)$", e.get("ref", ""))):
                    return int(end[1])
                if e.tag == f"{_MAIN}row":
                    if event == "start":
                        last = int(e.get("r", last + 1))
                    else:
                        e.clear()
        return last


def header_names(head: dict[int, str] | None, first: int, last: int) -> list[str]:
    """Names of the columns: the header's texts, numbers where it has none or repeats one."""
    from .load import short_header

    return short_header([(head or {}).get(c, "") for c in range(first, last + 1)])


class Piece(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.top, self.left, self.bottom, self.right = parse_range(options.get("range", ""))

    def _book(self) -> Workbook:
        return Workbook(_open(self.options["path"]))

    def partitions(self) -> list[Piece]:
        book = self._book()
        sheet = book.sheet(self.options.get("sheet", ""))
        begin = self.top
        if self.options.get("header", "true").lower() == "true":
            begin = next((n for n, cells in book.rows(sheet, self.top, self.bottom)), self.top - 1) + 1
        end, step = min(self.bottom, book.used(sheet)), int(self.options.get("rows", ROWS))
        if self.options.get("stopatblank", "false").lower() == "true":
            at = begin
            for n, _ in book.rows(sheet, begin, end):
                if n != at:
                    break
                at += 1
            end = at - 1
        return [Piece(a, min(a + step - 1, end)) for a in range(begin, end + 1, step)] or [Piece(1, 0)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        book, n = self._book(), len(self.schema.fields)
        for _, cells in book.rows(book.sheet(self.options.get("sheet", "")), piece.first, piece.last):
            row = tuple(cells.get(self.left + i) for i in range(n))
            if any(x is not None for x in row):
                yield row


def _open(path: str):
    """The bytes of a workbook in any store that pyarrow reads; a workbook is small next to what its cells become."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]+:", path, re.I):
        store, inside = fs.FileSystem.from_uri(path)
        return io.BytesIO(store.open_input_file(inside).readall())
    return open(path, "rb")


class SheetSource(DataSource):
    """Options: sheet, range, header (true), stopatblank (false): end at the first blank row, rows (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        top, left, bottom, right = parse_range(self.options.get("range", ""))
        book = Workbook(_open(self.options["path"]))
        sheet = book.sheet(self.options.get("sheet", ""))
        head, widest = None, 0
        for _, cells in book.rows(sheet, top, bottom):
            head = head or cells
            widest = max(widest, *cells)
            if right is not None:
                break
        last = right or widest
        if last < left:
            raise ValueError(f"{sheet} has no cells there")
        header = self.options.get("header", "true").lower() == "true"
        return StructType([StructField(n, StringType()) for n in header_names(head if header else None, left, last)])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))


def read_sheet(spark: SparkSession, path: str, **options) -> DataFrame:
    """A sheet's table, every column text.  ``.xls`` files are refused: save them as .xlsx."""
    if path.lower().endswith(".xls"):
        raise ValueError(f"{path}: the old .xls format is not read; save the file as .xlsx")
    spark.dataSource.register(SheetSource)
    reader = spark.read.format("sheet")
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load(path)
