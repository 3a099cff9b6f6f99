"""Workbooks as a Spark data source.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("path", "standard.xlsx").option("header", "a|b|c").load()

Each sheet is a partition. Its first row must equal the expected header, or the read fails; rows are
numbered from 2, and rows without a value are left out. Cells are text; a number without a fraction is
written without one.
"""

from __future__ import annotations

import hashlib
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def resolve(path: str | None, folder: str = ".", pattern: str = "*.xlsx") -> Path:
    """The given path, or the only workbook of a folder; an error if there is none or several."""
    if path:
        if not Path(path).exists():
            raise FileNotFoundError(path)
        return Path(path)
    found = sorted(Path(folder).glob(pattern))
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files match {pattern} in {folder}; name one")
    return found[0]


def sha256(path: str | Path) -> str:
    """Hash of a file, read in pieces."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else text


def sheets(path: str) -> list[tuple[str, str]]:
    """Names of a workbook's sheets and their parts."""
    with zipfile.ZipFile(path) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        part = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        return [(s.get("name"), part(targets[s.get(f"{_REL}id")])) for s in book.iter(f"{_MAIN}sheet")]


def rows(path: str, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers and cells of a sheet, in order; the sheet is streamed."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{_MAIN}si":
                        shared.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                        e.clear()
        with z.open(part) as f:
            n = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_MAIN}row":
                    continue
                n = int(e.get("r") or n + 1)
                cells: dict[int, str | None] = {}
                for i, c in enumerate(e.iter(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else _number(v.text) if kind == "n" else v.text
                yield n, [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                e.clear()


@dataclass
class Sheet(InputPartition):
    name: str
    part: str


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, header: list[str]):
        self.path, self.header = path, header

    def partitions(self) -> list[Sheet]:
        return [Sheet(*s) for s in sheets(self.path)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        found = rows(self.path, partition.part)
        clean = lambda v: (v or "").strip() or None
        _, first = next(found, (1, []))
        if [clean(v) for v in first] != self.header:
            raise ValueError(f"Unexpected header in sheet {partition.name}: {first}")
        k = len(self.header)
        for n, cells in found:
            cells = (cells + [None] * k)[:k]
            if any(clean(v) for v in cells):
                yield (partition.name, n, *cells)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _header(self) -> list[str]:
        return self.options["header"].split("|")

    def schema(self) -> StructType:
        own = [StructField("sheet_name", StringType()), StructField("row_number", IntegerType())]
        return StructType([*own, *(StructField(h, StringType()) for h in self._header())])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self._header())
