"""Spreadsheets (Office Open XML) as a data source: zipped XML read as a stream, one partition a sheet.

``spark.dataSource.register(Spreadsheet)``, then ``spark.read.format("spreadsheet").load(path)``
or, without registering by hand, ``read_spreadsheet``.  Files are opened by the tasks by path,
so they lie where all executors see them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from glob import glob
from typing import NamedTuple
from xml.etree.ElementTree import Element, iterparse
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType, TimestampNTZType

#: Rows that types are found from.
LOOKED_AT = 200
#: Numbers of the built-in formats of dates and times (fixed values).
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


class Sheet(NamedTuple):
    file: str
    name: str
    part: str


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(book: ZipFile, part: str, wanted: str) -> Iterator[Element]:
    """Elements of one name of a part of the file, each dropped once it was used."""
    if part not in book.namelist():
        return
    with book.open(part) as raw:
        for _, e in iterparse(raw):
            if _local(e.tag) == wanted:
                yield e
                e.clear()


def sheets(path: str) -> list[Sheet]:
    """All sheets of the files of a path or pattern, in order."""
    out = []
    for file in sorted(glob(path)) or [path]:
        with ZipFile(file) as book:
            targets = {e.get("Id"): e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
            for e in _elements(book, "xl/workbook.xml", "sheet"):
                target = targets[next(v for k, v in e.attrib.items() if _local(k) == "id" and k != "sheetId")]
                out.append(Sheet(file, e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _column(reference: str) -> int:
    """Place of a cell from 0: A1 is 0, AA7 is 26."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(e: Element) -> str:
    """Text of a string item without its phonetic parts."""
    return "".join(t.text or "" for child in e.iter() if _local(child.tag) in ("si", "is", "r") for t in child if _local(t.tag) == "t")


class Workbook:
    """What cells refer to: shared strings, formats that are dates, and the first day."""

    def __init__(self, book: ZipFile):
        self.book = book
        self.strings = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")]
        own = {e.get("numFmtId"): e.get("formatCode", "") for e in _elements(book, "xl/styles.xml", "numFmt")}
        self.dates = set()
        for table in _elements(book, "xl/styles.xml", "cellXfs"):
            for k, x in enumerate(x for x in table if _local(x.tag) == "xf"):
                number = x.get("numFmtId", "0")
                code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own.get(number, ""))
                if int(number) in DATE_FORMATS or re.search(r"[ydhs]", code, re.IGNORECASE):
                    self.dates.add(k)
        late = any(e.get("date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", "workbookPr"))
        self.first_day = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)

    def value(self, cell: Element) -> object:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return next((_text(e) for e in cell if _local(e.tag) == "is"), "")
        said = next((e.text for e in cell if _local(e.tag) == "v"), None)
        if said is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(said)]
        if kind == "b":
            return said == "1"
        if kind in ("str", "d"):
            return said
        number = float(said)
        if int(cell.get("s", 0)) in self.dates:
            return self.first_day + timedelta(seconds=round(number * 86_400, 3))
        return number

    def rows(self, part: str) -> Iterator[list[object]]:
        """Rows that have cells, as lists with None for gaps."""
        for row in _elements(self.book, part, "row"):
            out: list[object] = []
            for cell in (c for c in row if _local(c.tag) == "c"):
                at = _column(cell.get("r")) if cell.get("r") else len(out)
                out += [None] * (at + 1 - len(out))
                out[at] = self.value(cell)
            if any(v is not None for v in out):
                yield out


def _headed(rows: Iterator[list[object]]) -> tuple[list[str], Iterator[list[object]]]:
    head = next(rows, [])
    return [str(h) if h not in (None, "") else f"_c{k}" for k, h in enumerate(head)], rows


def _kind(values: list[object]):
    """Type that holds all values: text where they differ."""
    seen = {type(v) for v in values if v is not None}
    return {float: DoubleType(), bool: BooleanType(), datetime: TimestampNTZType()}[seen.pop()] if len(seen) == 1 and seen <= {float, bool, datetime} else StringType()


def _cast(value: object, kind) -> object:
    if value is None:
        return None
    if isinstance(kind, StringType):
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    own = {DoubleType: float, BooleanType: bool, TimestampNTZType: datetime}[type(kind)]
    return value if type(value) is own else None


class _Part(InputPartition):
    def __init__(self, sheet: Sheet):
        super().__init__(tuple(sheet))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, wanted: list[Sheet]):
        self.schema, self.wanted = schema, wanted

    def partitions(self) -> list[InputPartition]:
        return [_Part(s) for s in self.wanted]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        sheet = Sheet(*partition.value)
        with ZipFile(sheet.file) as zipped:
            names, rows = _headed(Workbook(zipped).rows(sheet.part))
            at = [(names.index(f.name) if f.name in names else -1, f) for f in self.schema]
            for row in rows:
                yield tuple(sheet.name if f.name == "_sheet" and k < 0 else _cast(row[k], f.dataType) if 0 <= k < len(row) else None for k, f in at)


class Spreadsheet(DataSource):
    """Options: path (a file or pattern), sheet (one name; all by default).

    The first row of a sheet names its columns; sheets give their values by name.  Without a
    schema, columns are those of all sheets, their types from the first rows (text where values
    differ), and ``_sheet`` tells the sheet.  A value that is not of a column's type is NULL.
    """

    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def _wanted(self) -> list[Sheet]:
        found = sheets(self.options["path"])
        return [s for s in found if self.options.get("sheet") in (None, s.name)]

    def schema(self) -> StructType:
        seen: dict[str, list[object]] = {}
        for sheet in self._wanted():
            with ZipFile(sheet.file) as zipped:
                names, rows = _headed(Workbook(zipped).rows(sheet.part))
                for n in names:
                    seen.setdefault(n, [])
                for _, row in zip(range(LOOKED_AT), rows):
                    for n, v in zip(names, row):
                        seen[n].append(v)
        return StructType([*(StructField(n, _kind(v)) for n, v in seen.items()), StructField("_sheet", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self._wanted())


def read_spreadsheet(spark: SparkSession, path: str, sheet: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Rows of the sheets of one or more files; see ``Spreadsheet``."""
    spark.dataSource.register(Spreadsheet)
    reader = spark.read.format("spreadsheet")
    reader = reader if schema is None else reader.schema(schema)
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)
