"""Workbooks and archives: one container file per call of a small Arrow-batched reader."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 5000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def compressed_inner_name(name: str) -> str:
    """``data.csv.gz`` holds ``data.csv``; the codecs themselves are built into the readers."""
    return re.sub(r"(?i)\.(gz|gzip|bz2|bzip2)$", "", name)


def _batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    batch: list[tuple] = []
    for row in rows:
        batch.append(row)
        if len(batch) >= BATCH:
            yield pd.DataFrame(batch, columns=columns)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns)


def _column_number(reference: str) -> int:
    number = 0
    for char in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(char) - 64
    return number - 1


def _sheet_rows(book: zipfile.ZipFile) -> Iterator[tuple[str, list[tuple[int, str | None]]]]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter(_MAIN + "t")))
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
        target = targets[sheet.get(_REL + "id")].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        with book.open(target) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != _MAIN + "row":
                    continue
                cells: list[tuple[int, str | None]] = []
                for number, cell in enumerate(row.iter(_MAIN + "c")):
                    at = _column_number(cell.get("r")) if cell.get("r") else number
                    kind, value = cell.get("t"), cell.find(_MAIN + "v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                    elif value is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "true" if value.text == "1" else "false"
                    else:
                        text = value.text
                    cells.append((at, text.strip() if text is not None else None))
                yield sheet.get("name"), cells
                row.clear()


def _records(content: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """Header of each sheet from its first row; blank headers are numbered."""
    header: dict[int, str] = {}
    current, row_no = None, 0
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for sheet, cells in _sheet_rows(book):
            if sheet != current:
                current, row_no, blank = sheet, 0, 0
                width = max((at for at, _ in cells), default=-1) + 1
                texts = dict(cells)
                header = {}
                for at in range(width):
                    name = texts.get(at)
                    if not name:
                        name, blank = f"Column {blank}", blank + 1
                    header[at] = name
                continue
            record = {header.get(at, f"Column {at}"): text for at, text in cells if text is not None}
            if record:
                yield sheet, row_no, record
                row_no += 1


def workbook_cells(books: DataFrame) -> DataFrame:
    """(``_file``, sheet, row_no, cells map) of every worksheet of the workbooks in (path, content)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                rows = ((path, sheet, n, cells) for sheet, n, cells in _records(content))
                yield from _batches(rows, ["_file", "sheet", "row_no", "cells"])

    return books.select("path", "content").mapInPandas(
        read, "_file string, sheet string, row_no bigint, cells map<string,string>"
    )


def scan_xlsx(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The cells of workbook files, many files side by side."""
    return workbook_cells(spark.read.format("binaryFile").load(paths))


def sheet_table(cells: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """One worksheet as a table of text columns."""
    return cells.filter(F.col("sheet") == sheet).select(
        "_file", "row_no", *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns]
    )


def _members(content: bytes, pattern: str) -> Iterator[tuple[str, io.BufferedIOBase]]:
    stream = io.BytesIO(content)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as archive:
            for info in archive.infolist():
                if not info.is_dir() and re.search(pattern, info.filename.rsplit("/", 1)[-1]):
                    yield info.filename, archive.open(info)
        return
    stream.seek(0)
    with tarfile.open(fileobj=stream) as archive:
        for info in archive:
            if info.isfile() and re.search(pattern, info.name.rsplit("/", 1)[-1]):
                yield info.name, archive.extractfile(info)


def archive_lines(archives: DataFrame, member_pattern: str = ".*") -> DataFrame:
    """(archive, member, line_no, line) of the members whose base name matches, from (path, content)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                rows = (
                    (path, name, n, line.rstrip("\r\n"))
                    for name, member in _members(content, member_pattern)
                    for n, line in enumerate(io.TextIOWrapper(member, encoding="utf-8-sig", errors="replace", newline="\n"))
                )
                yield from _batches(rows, ["archive", "member", "line_no", "line"])

    return archives.select("path", "content").mapInPandas(read, "archive string, member string, line_no bigint, line string")


def scan_archive(spark: SparkSession, paths: str | list[str], member_pattern: str = ".*") -> DataFrame:
    """The lines of zip and tar files, many files side by side."""
    return archive_lines(spark.read.format("binaryFile").load(paths), member_pattern)
