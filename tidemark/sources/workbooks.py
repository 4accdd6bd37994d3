"""Spreadsheets (Office Open XML) as tables of text cells, parsed with what Python brings along, one file a task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(reference: str) -> int:
    """0 for A, 26 for AA, of a cell reference such as AA12."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, {column: text}) of the filled rows of a sheet, by name or the first. Raises LookupError without it."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(f"{_LINK}id")]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        target = next((t for n, t in sheets if sheet is None or n == sheet), None)
        if target is None:
            raise LookupError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with book.open(path) as stream:
            number = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: dict[int, str] = {}
                at = -1
                for cell in row.iter(f"{_MAIN}c"):
                    at = column_number(cell.get("r")) if cell.get("r") else at + 1
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    cells[at] = text
                if cells:
                    yield number, cells
                row.clear()


def workbook_cells(files: DataFrame, width: int, sheet: str | None = None) -> DataFrame:
    """file, row and c0 to c(width - 1), texts, of workbooks (path, content); cells further right are left out.

    Dates are the numbers that the sheet holds: days since 1899-12-30.
    """
    schema = "file string, row int, " + ", ".join(f"c{i} string" for i in range(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(sheet_rows(content, sheet)) if content else []
                columns = [pa.array([path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), *[pa.array([cells.get(i) for _, cells in rows], pa.string()) for i in range(width)]]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "row", *[f"c{i}" for i in range(width)]])

    return files.select("path", "content").mapInArrow(run, schema)


def read_workbooks(spark: SparkSession, path: str, width: int, sheet: str | None = None) -> DataFrame:
    """The cells of one sheet of each workbook at ``path``."""
    return workbook_cells(spark.read.format("binaryFile").load(path), width, sheet)


def sheet_date(cell):
    """The date of a number that a sheet holds for one."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(cell.cast("string").try_cast("double")).cast("int"))
