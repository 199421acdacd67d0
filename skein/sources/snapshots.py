"""SQLite files and spreadsheets as Spark data sources, by the standard library alone.

``format("sqlite")`` reads a table of every file that ``path`` names (option ``table``), one partition for each range of
row numbers, and writes one file a task.  ``format("sheets")`` reads the rows of all sheets of every workbook (.xlsx) that
``path`` names: file, sheet, row and cells; small workbooks share a partition.  Both list files by Arrow's file systems; a workbook
or SQLite file is copied to the task's temporary folder, as the library needs a local one, and removed after.
"""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from skein.operators.versions import files_of

#: Rows of a partition; workbooks of one, and the bytes from which on it takes no more of them.
ROWS = 100_000
BOOKS, BYTES = 64, 1 << 24
#: Rows handed over at once, and the bytes up to which a sheet is parsed as one piece.
AT_ONCE, PIECE = 1024, 1 << 20
KINDS = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "boolean": "INTEGER"}


@contextmanager
def _local(path: str, place: str):
    """A file of a folder as a local one."""
    files, _ = files_of(path)
    handle, name = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as out, files.open_input_stream(place) as source:
            while block := source.read(1 << 20):
                out.write(block)
        yield name
    finally:
        os.unlink(name)


def _sized(path: str, ending: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    files, place = files_of(path)
    info = files.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    return sorted((f.path, f.size) for f in files.get_file_info(fs.FileSelector(place, recursive=True)) if f.path.endswith(ending))


def _named(path: str, ending: str) -> list[str]:
    return [place for place, _ in _sized(path, ending)]


@dataclass
class Rows(InputPartition):
    place: str
    first: int
    last: int


@dataclass
class Books(InputPartition):
    places: list[str]


@dataclass
class Written(WriterCommitMessage):
    place: str


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, name: str, schema: StructType) -> None:
        self.path, self.table, self.columns = path, name, schema.names

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for place in _named(self.path, ".sqlite"):
            with _local(self.path, place) as name, sqlite3.connect(name) as db:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            found += [Rows(place, k, k + ROWS) for k in range(low or 0, (high or -1) + 1, ROWS)]
        return found or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if partition.place:
            with _local(self.path, partition.place) as name, sqlite3.connect(name) as db:
                listed = ", ".join(f'"{c}"' for c in self.columns)
                yield from db.execute(f'SELECT {listed} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.first, partition.last))


class SqliteWriter(DataSourceArrowWriter):
    def __init__(self, path: str, name: str, schema: StructType) -> None:
        self.path, self.table, self.kinds = path, name, [(f.name, KINDS[f.dataType.simpleString()]) for f in schema]

    def write(self, iterator) -> Written:
        handle, name = tempfile.mkstemp()
        os.close(handle)
        try:
            with sqlite3.connect(name) as db:
                db.execute(f'CREATE TABLE "{self.table}" (' + ", ".join(f'"{n}" {k}' for n, k in self.kinds) + ")")
                for b in iterator:
                    db.executemany(f'INSERT INTO "{self.table}" VALUES ({", ".join("?" * len(self.kinds))})', zip(*(c.to_pylist() for c in b.columns), strict=True))
            files, place = files_of(self.path)
            files.create_dir(place, recursive=True)
            to = f"{place}/{uuid.uuid4().hex}.sqlite"
            with files.open_output_stream(f"{to}.part") as out, open(name, "rb") as source:
                while block := source.read(1 << 20):
                    out.write(block)
        finally:
            os.unlink(name)
        return Written(to)

    def commit(self, messages) -> None:
        """Files get their ending, by which readers know them."""
        files, _ = files_of(self.path)
        for m in messages:
            if m is not None:
                files.move(f"{m.place}.part", m.place)

    def abort(self, messages) -> None:
        files, _ = files_of(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{m.place}.part")


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        """From the first file's declarations."""
        path, name = self.options["path"], self.options.get("table", "data")
        with _local(path, _named(path, ".sqlite")[0]) as local, sqlite3.connect(local) as db:
            kinds = {"INTEGER": "bigint", "REAL": "double"}
            return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in db.execute(f'PRAGMA table_info("{name}")'))

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options.get("table", "data"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        if overwrite:
            raise ValueError("a snapshot isn't overwritten: choose another folder")
        return SqliteWriter(self.options["path"], self.options.get("table", "data"), schema)


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


@cache
def _column(letters: str) -> int:
    """Number from 0 of a cell's letters."""
    n = 0
    for c in re.match(r"[A-Z]+", letters)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


@cache
def _letters(column: int) -> str:
    letters, n = "", column + 1
    while n:
        n, k = divmod(n - 1, 26)
        letters = chr(65 + k) + letters
    return letters


ROW, CELL, VALUE, TEXT = (MAIN + x for x in ("row", "c", "v", "t"))


def _elements(book: zipfile.ZipFile, name: str) -> Iterator[ElementTree.Element]:
    """The rows of a sheet; of a long one each goes when the next is asked for."""
    if book.getinfo(name).file_size <= PIECE:
        yield from ElementTree.fromstring(book.read(name)).iter(ROW)
        return
    with book.open(name) as source:
        for _, row in ElementTree.iterparse(source):
            if row.tag == ROW:
                yield row
                row.clear()


def sheet_rows(file) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of a workbook; cells are texts as they are stored, missing ones None."""
    with zipfile.ZipFile(file) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(TEXT)) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target, title = links[sheet.get(f"{LINK}id")].lstrip("/"), sheet.get("name")
            for row in _elements(book, target if target.startswith("xl/") else f"xl/{target}"):
                cells: list[str | None] = []
                for c in row.iter(CELL):
                    place, kind = c.get("r"), c.get("t")
                    at = _column(place.rstrip("0123456789")) if place else len(cells)
                    if at >= len(cells):
                        cells += [None] * (at + 1 - len(cells))
                    if kind == "inlineStr":
                        cells[at] = "".join([t.text or "" for t in c.iter(TEXT)])
                    elif (value := c.findtext(VALUE)) not in (None, ""):
                        cells[at] = shared[int(value)] if kind == "s" else value
                yield title, int(row.get("r") or 0), cells


class SheetsReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        held: list[str] = []
        size = 0
        for place, n in _sized(self.path, ".xlsx"):
            if held and (len(held) == BOOKS or size + n > BYTES):
                found.append(Books(held))
                held, size = [], 0
            held.append(place)
            size += n
        return [*found, Books(held)]

    def read(self, partition: Books) -> Iterator[pa.RecordBatch]:
        for place in partition.places:
            with _local(self.path, place) as name:
                rows = sheet_rows(name)
                while held := list(islice(rows, AT_ONCE)):
                    sheet, row, cells = zip(*held, strict=True)
                    yield pa.record_batch([pa.array([place] * len(held), pa.string()), pa.array(sheet, pa.string()), pa.array(row, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["file", "sheet", "row", "cells"])


class SheetsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return "file string, sheet string, row bigint, cells array<string>"

    def reader(self, schema: StructType) -> SheetsReader:
        return SheetsReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(SheetsSource)


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A small workbook of inline texts and numbers."""
    import io
    from xml.sax.saxutils import escape

    def cell(value, column: int, row: int) -> str:
        if value is None:
            return ""
        at = f"{_letters(column)}{row}"
        if isinstance(value, str):
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f'<c r="{at}"><v>{value}</v></c>'

    main, link = MAIN[1:-1], LINK[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{link}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            data = "".join(f'<row r="{r}">' + "".join(cell(v, c, r) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>')
    return out.getvalue()
