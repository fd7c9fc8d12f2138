"""Workbook files (.xlsx) as a Spark data source: row, cells."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import importable

# Names in the format's XML.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_LINK = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def opened(path: str) -> zipfile.ZipFile:
    """The workbook at a path or URI of a file system that pyarrow reaches."""
    from pyarrow import fs

    if re.match(r"[a-z0-9+.-]+:", path):
        store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    else:
        store, at = fs.LocalFileSystem(), path
    return zipfile.ZipFile(store.open_input_file(at))


def sheet_members(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> member of the archive, in the workbook's order."""
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_LINK)}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    target = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {e.get("name"): target(links[e.get(f"{_REL}id")]) for e in sheets}


def _said(node: ElementTree.Element) -> str:
    """The text of a string item: of its runs, but not of what says how it is read aloud."""
    if (t := node.find(f"{_MAIN}t")) is not None:
        return t.text or ""
    return "".join(r.findtext(f"{_MAIN}t") or "" for r in node.findall(f"{_MAIN}r"))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == f"{_MAIN}si":
                out.append(_said(node))
                node.clear()
    return out


def column(ref: str) -> int:
    """Index from 0 of a cell's column, as of 'AB12'."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def last_row(book: zipfile.ZipFile, member: str) -> int | None:
    """The sheet's number of rows, if its head tells."""
    with book.open(member) as stream:
        head = re.search(rb'<dimension ref="(?:[A-Z]+\d+:)?[A-Z]+(\d+)"', stream.read(4096))
    return int(head[1]) if head else None


def sheet_rows(book: zipfile.ZipFile, member: str, first: int = 0, end: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row from 0, cells) of the rows from first to before end that have any cell. Cells are text as the file has it, numbers
    too; truth values are TRUE and FALSE; formulas are what they came to."""
    shared, at = shared_strings(book), -1
    with book.open(member) as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag != f"{_MAIN}row":
                continue
            at = int(node.get("r")) - 1 if node.get("r") else at + 1
            if end is not None and at >= end:
                return
            if at >= first:
                cells: list[str | None] = []
                for c in node.findall(f"{_MAIN}c"):
                    k = column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    value, kind = c.findtext(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[k] = _said(c.find(f"{_MAIN}is"))
                    elif value is not None:
                        cells[k] = shared[int(value)] if kind == "s" else ("TRUE" if value == "1" else "FALSE") if kind == "b" else value
                if cells:
                    yield at, cells
            node.clear()


@dataclass
class Rows(InputPartition):
    first: int
    end: int | None


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, size: int):
        self.path, self.sheet, self.size = path, sheet, size

    def _member(self, book: zipfile.ZipFile) -> str:
        members = sheet_members(book)
        if self.sheet is not None and self.sheet not in members:
            raise ValueError(f"{self.path} has no sheet {self.sheet}")
        return members[self.sheet] if self.sheet is not None else next(iter(members.values()))

    def partitions(self) -> list[Rows]:
        with opened(self.path) as book:
            starts = list(range(0, max(1, last_row(book, self._member(book)) or 1), self.size))
        return [Rows(a, b) for a, b in zip(starts, [*starts[1:], None])]

    def read(self, partition: Rows) -> Iterator[tuple[int, list[str | None]]]:
        with opened(self.path) as book:
            yield from sheet_rows(book, self._member(book), partition.first, partition.end)


class Workbook(DataSource):
    """Options: path, sheet (else the first), rows: rows of a partition. A partition is a range of a sheet's rows; the last one goes on to
    the sheet's end, whatever the file says of its size. A task holds the workbook's shared strings and one row at a time."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "row bigint, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), int(self.options.get("rows", 50_000)))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, rows: int = 50_000) -> DataFrame:
    """row (from 0), cells (array of text) of a sheet of an .xlsx file; rows without a cell are left out."""
    importable(spark).dataSource.register(Workbook)
    reader = spark.read.format("workbook").option("rows", rows)
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


def sheet_names(path: str) -> list[str]:
    with opened(path) as book:
        return list(sheet_members(book))
