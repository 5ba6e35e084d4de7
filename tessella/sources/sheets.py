"""The first sheet of an XLSX file as strings, with the standard library alone."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from tessella.sources import shared

#: Names the file format prescribes (fixed values).
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _column(reference: str) -> int:
    """Zero-based column of a cell reference such as AB12."""
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(node: ET.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_rows(path: str) -> Iterator[list[str]]:
    """The rows of the first sheet; absent cells are '' and booleans TRUE or FALSE."""
    with shared.seekable(path) as file, zipfile.ZipFile(file) as book:
        names = set(book.namelist())
        words = []
        if "xl/sharedStrings.xml" in names:
            words = [_text(item) for item in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        first = next(ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_PACKAGE)}
        target = links[first.get(_REL)].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
            for _, row in ET.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for place, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else place
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    raw = "" if value is None else value.text or ""
                    if kind == "s":
                        raw = words[int(raw)] if raw else ""
                    elif kind == "inlineStr":
                        raw = _text(cell.find(f"{_MAIN}is"))
                    elif kind == "b":
                        raw = "TRUE" if raw == "1" else "FALSE"
                    cells[at] = raw
                yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                row.clear()


class SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def read(self, partition) -> Iterator[tuple]:
        rows = sheet_rows(self.path)
        next(rows, None)
        for row in rows:
            if any(row):
                yield tuple((row + [""] * self.width)[: self.width])


class Sheet(DataSource):
    """format('xlsx'): every column a string, the first row being the names."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _names(self) -> list[str]:
        head = next(sheet_rows(self.options["path"]), [])
        return [name or f"column_{i}" for i, name in enumerate(head)]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self._names()])

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options["path"], len(schema.fields))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Sheet)
