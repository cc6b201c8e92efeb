"""Workbooks as a data source: `spark.read.format("workbook").load(path)`.

A partition for each sheet of each file, so sheets are read in parallel; the schema comes from the header row and the types of the values
in the first rows, blanks left out, as `tabular.infer_sheet_types` tells them. Options: `sheet`, the sheet whose columns are wanted
(default: the first of the first file by name; other files give their sheet of that name), `infer_rows` (1000), `columns` (`names` adds _path,
_sheet and _row_no), `cells` (`true`: all rows of all sheets as _path, _sheet, _row_no and an array of strings, header rows included). A path is a file, a folder or a glob, opened with Python in the tasks: it must be one that all executors see as a file.

Defined cases: ragged rows are padded or cut to the header; a value that doesn't fit its column's type is null; a sheet without rows gives none, and
without a header there is no schema to read by; a file without the sheet gives no rows; a broken file fails the read and is named.
"""

from __future__ import annotations

import datetime
import glob
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import header_names, sheet_names, xlsx_rows

INT, FLOAT = re.compile(r"[+-]?[0-9]+(_[0-9]+)*"), re.compile(r"(?=.*[0-9])[+-]?([0-9]+(_[0-9]+)*)?(\.[0-9]*)?([eE][+-]?[0-9]+)?|[+-]?(inf|infinity|nan)", re.IGNORECASE)
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?")
NAMES = "_path string, _sheet string, _row_no int"


def as_bool(x: str) -> bool | None:
    return {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False}.get(x.lower())


def as_int(x: str) -> int | None:
    return int(n) if INT.fullmatch(x) and -(1 << 63) <= (n := int(x)) < 1 << 63 else None


def as_float(x: str) -> float | None:
    return float(x) if FLOAT.fullmatch(x) else None


def as_date(x: str) -> datetime.datetime | None:
    try:
        return datetime.datetime.fromisoformat(x) if DATE.fullmatch(x) else None
    except ValueError:
        return None


#: type, its Spark type, how a text becomes a value of it; a column has the first type that all its values fit
TYPES = (("bool", "boolean", as_bool), ("int", "bigint", as_int), ("float", "double", as_float), ("date", "timestamp_ntz", as_date), ("text", "string", str))


def kind_of(values: list[str]) -> str:
    fits = {"bool": lambda x: x.lower() in ("true", "false"), "int": INT.fullmatch, "float": FLOAT.fullmatch, "date": as_date}
    return next((k for k, fit in fits.items() if values and all(fit(v) for v in values)), "text")


def stripped(x: str | None) -> str:
    return (x or "").strip()


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str


def rows_of(path: str, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
    with open(path, "rb") as f:
        content = f.read()
    try:
        for name, n, cells in xlsx_rows(content, only=sheet):
            if name == sheet:
                yield n, cells
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"{path} is no workbook: {type(e).__name__}") from e


def sheets_of(path: str) -> list[str]:
    try:
        with open(path, "rb") as f:
            return sheet_names(f.read())
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"{path} is no workbook: {type(e).__name__}") from e


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(f"{path}/*.xlsx")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return found

    def sheet(self) -> str:
        return self.options.get("sheet") or sheets_of(self.files()[0])[0]

    def schema(self) -> str:
        if self.options.get("cells") == "true":
            return f"{NAMES}, cells array<string>"
        sheet, most = self.sheet(), int(self.options.get("infer_rows", 1000))
        header, seen = None, []
        for path in (p for p in self.files() if sheet in sheets_of(p)):
            for n, cells in rows_of(path, sheet):
                if header is None:
                    header, seen = header_names(cells), [[] for _ in cells]
                elif n > 1:
                    if n > most + 1:
                        break
                    for held, x in zip(seen, cells, strict=False):
                        if stripped(x):
                            held.append(stripped(x))
            break
        if header is None:
            raise ValueError(f"sheet {sheet} has no header")
        kinds = dict((k, t) for k, t, _ in TYPES)
        columns = ", ".join(f"`{n}` {kinds[kind_of(v)]}" for n, v in zip(header, seen, strict=True))
        return f"{columns}, {NAMES}" if self.options.get("columns") == "names" else columns

    def reader(self, schema: StructType) -> WorkbookReader:
        return CellReader(self.files()) if self.options.get("cells") == "true" else WorkbookReader(self.files(), self.sheet(), schema)


class CellReader(DataSourceReader):
    """All sheets as they are."""

    def __init__(self, files: list[str]):
        self.paths = files

    def partitions(self) -> list[Sheet]:
        return [Sheet(p, s) for p in self.paths for s in sheets_of(p)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        for n, cells in rows_of(partition.path, partition.sheet):
            yield partition.path, partition.sheet, n, cells


class WorkbookReader(DataSourceReader):
    def __init__(self, files: list[str], sheet: str, schema: StructType):
        self.paths, self.sheet = files, sheet
        makers = {t: make for _, t, make in TYPES}
        fields = [f for f in schema.fields if f.name not in ("_path", "_sheet", "_row_no")]
        self.makers = [makers[f.dataType.simpleString()] for f in fields]
        self.named = len(fields) < len(schema.fields)

    def partitions(self) -> list[Sheet]:
        return [Sheet(p, self.sheet) for p in self.paths if self.sheet in sheets_of(p)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        width = len(self.makers)
        for n, cells in rows_of(partition.path, partition.sheet):
            if n > 1:
                padded = [*cells, *[None] * (width - len(cells))][:width]
                values = tuple((x if make is str else make(stripped(x)) if stripped(x) else None) for x, make in zip(padded, self.makers, strict=True))
                yield (*values, partition.path, partition.sheet, n) if self.named else values


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(WorkbookSource)
