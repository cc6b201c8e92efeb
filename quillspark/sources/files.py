"""Uploaded files: validation, plain text, delimited and office files.

Binary files come from Spark's binaryFile reader, one row per file; office files are ZIP archives of XML, read by small
generators in mapInPandas (no built-in reader knows them). A file is the unit of that work.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.tabular import header_names

# Extensions by source type, leading bytes (hex) by MIME type, and the size cap.
TYPES = {
    "pdf": (".pdf",),
    "docx": (".docx",),
    "pptx": (".pptx",),
    "txt": (".txt", ".md"),
    "image": (".png", ".jpg", ".jpeg", ".webp"),
    "audio": (".mp3", ".wav", ".m4a", ".ogg", ".webm"),
    "video": (".mp4", ".mov", ".mkv", ".webm"),
    "excel": (".xlsx",),
    "csv": (".csv", ".tsv"),
    "url": (),
    "note": (),
    "youtube": (),
}
MAGIC = {"25504446": "application/pdf", "504B0304": "application/zip", "89504E47": "image/png", "FFD8FF": "image/jpeg", "52494646": "image/webp", "494433": "audio/mpeg", "4F676753": "audio/ogg"}
MOST_BYTES = 50 * 1024 * 1024
MOST_SHEETS, MOST_ROWS = 50, 200_000
SEPARATORS = ",;|\t"
SNIFFED, SNIFFED_LINES = 65_536, 2_000


def valid_type(kind: Column, filename: Column) -> Column:
    """Whether a source type is known and the file name's extension belongs to it."""
    ext, ok = X.extension(filename), F.lit(False)
    for name, extensions in TYPES.items():
        ok = F.when(kind == name, ext.isin(*extensions) if extensions else F.lit(True)).otherwise(ok)
    return ok


def sniffed(content: Column) -> Column:
    """The MIME type that the first bytes tell; null if none does."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.substring(head, 9, 8) == "66747970", "video/mp4")
    for magic, mime in MAGIC.items():
        out = F.when(head.startswith(magic), mime).otherwise(out)
    return out


def validated(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, filename, length, mime, problem) of binaryFile rows; problem is null for a file that may be read."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    known = sorted({e for v in TYPES.values() for e in v})
    mime, ext = sniffed(F.col("content")), X.extension(name)
    text_like = ext.isin(".txt", ".md", ".csv", ".tsv")
    problem = F.when(~ext.isin(*known), "extension").when(F.col("length") > most_bytes, "size").when(F.col("length") == 0, "empty").when(mime.isNull() & ~text_like, "content")
    return files.select("path", name.alias("filename"), "length", F.coalesce(mime, F.when(text_like, "text/plain")).alias("mime"), problem.alias("problem"))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, stripped."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), X.strip(F.col("value")).alias("text"))


def separator(head: str) -> str:
    """The separator that splits the head's lines most evenly: it is in the most lines, as often in each; then the most often.
    Quoted parts don't count."""
    lines = [re.sub(r'"[^"]*"', "", x) for x in head.lstrip("﻿").splitlines() if x.strip()]

    def fit(sep: str) -> tuple:
        counts = [x.count(sep) for x in lines]
        usual = max(set(counts), key=lambda n: (counts.count(n), n), default=0)
        return usual > 0, counts.count(usual) if usual else 0, usual, -SEPARATORS.index(sep)

    return max(SEPARATORS, key=fit)


def read_delimited(spark: SparkSession, path: str, quoted_lines: bool = True) -> DataFrame:
    """All columns as strings under sanitised names; the separator is told from the first SNIFFED bytes of lines, cells are
    stripped. With quoted_lines a quoted cell may go over several lines, whose ends are dropped, and a task reads a whole file;
    without, large files are split among tasks."""
    head, held = [], 0
    for row in spark.read.text(path).limit(SNIFFED_LINES).toLocalIterator():
        held += len(row["value"])
        if held > SNIFFED:
            break
        head.append(row["value"])
    options = {"header": "true", "sep": separator("\n".join(head)), "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "multiLine": str(quoted_lines).lower(), "escape": '"'}
    df = spark.read.options(**options).csv(path)
    names = header_names([c.lstrip("﻿") if not re.fullmatch(r"_c\d+", c) else "" for c in df.columns])
    whole = df.toDF(*(names + [f"_extra_{i}" for i in range(len(names), len(df.columns))])).select(*names)
    return whole.select(*[F.regexp_replace(c, "[\r\n]+", "").alias(c) for c in names]).dropna("all")


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def _said(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _tag(t) == "t")


def docx_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """One page: paragraphs and tables in body order, cells joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    lines = []
    for node in body:
        if _tag(node) == "p":
            lines.append(_said(node))
        elif _tag(node) == "tbl":
            lines += [" | ".join(_said(c).strip() for c in row if _tag(c) == "tc") for row in node if _tag(row) == "tr"]
    yield 1, "\n".join(x for x in lines if x.strip())


def pptx_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """A page per slide."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for i, (_, name) in enumerate(slides, 1):
            root = ElementTree.fromstring(z.read(name))
            yield i, "\n".join(t for p in root.iter() if _tag(p) == "p" and (t := _said(p)).strip())


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of cell styles that show dates: a built-in date format, or an own one with a day, month or year."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower() for f in root.iter() if _tag(f) == "numFmt"}
    formats = [int(x.get("numFmtId", "0")) for table in root if _tag(table) == "cellXfs" for x in table]
    return {i for i, n in enumerate(formats) if 14 <= n <= 22 or re.search("[dmyh]", own.get(n, ""))}


def _cell(cell, value: str | None, shared: list[str], dates: set[int]) -> str | None:
    """A cell's value as text; booleans as true and false, dates in ISO form (days since the end of 1899)."""
    kind = cell.get("t")
    if kind == "inlineStr":
        return _said(cell)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind in (None, "n") and int(cell.get("s", "0")) in dates:
        return (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value))).isoformat(sep=" ", timespec="seconds")
    return value


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, part) of each sheet."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))]) for s in book.iter() if _tag(s) == "sheet"]
    if len(sheets) > MOST_SHEETS:
        raise ValueError(f"more than {MOST_SHEETS} sheets")
    return sheets


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [title for title, _ in _sheets(z)]


def xlsx_rows(content: bytes, only: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook, or of one of its sheets; raises beyond 50 sheets or 200,000 rows of a sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_said(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(z)
        for title, target in _sheets(z):
            if only is not None and title != only:
                continue
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            n = 0
            for _, row in ElementTree.iterparse(io.BytesIO(z.read(name))):
                if _tag(row) != "row":
                    continue
                cells: list[str | None] = []
                for c in row:
                    letters = re.match("[A-Z]+", c.get("r", "A1"))[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (at - 1 - len(cells))
                    value = next((v.text for v in c if _tag(v) == "v"), None)
                    cells.append(_cell(c, value, shared, dates))
                row.clear()
                if any(x not in (None, "") for x in cells):
                    n += 1
                    if n > MOST_ROWS + 1:
                        raise ValueError(f"more than {MOST_ROWS} rows in {title}")
                    yield title, n, cells


def _pages(files: DataFrame, read: Callable[[bytes], Iterator[tuple[int, str]]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows, problem = [], None
                try:
                    rows = [(path, n, text, None) for n, text in read(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    problem = f"{type(e).__name__}: {e}"
                yield pd.DataFrame(rows or [(path, None, None, problem)], columns=["path", "page_no", "text", "problem"]).astype({"page_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, problem string")


def docx_texts(files: DataFrame) -> DataFrame:
    return _pages(files, docx_pages)


def pptx_texts(files: DataFrame) -> DataFrame:
    return _pages(files, pptx_pages)


def xlsx_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row_no, cells): row 1 of a sheet is its header. Arrays of strings, to be typed by `tabular.typed`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows: list[tuple] = []
                for sheet, n, cells in xlsx_rows(content):
                    rows.append((path, sheet, n, cells))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row_no int, cells array<string>")


def sheet_table(cells: DataFrame, path: str, sheet: str) -> DataFrame:
    """One sheet as a table of strings: ragged rows are padded or cut to the header."""
    rows = cells.filter((F.col("path") == path) & (F.col("sheet") == sheet))
    header = rows.filter("row_no = 1").first()
    names = header_names(header["cells"] if header else [])
    return rows.filter("row_no > 1").orderBy("row_no").select(*[F.get(F.col("cells"), F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions (JSON lines); a line that isn't JSON fails the read."""
    kind = "question string, kb_id string, expected_sources array<string>, expected_keywords array<string>, type string"
    return spark.read.schema(kind).option("mode", "FAILFAST").json(path)


def parse_source(spark: SparkSession, kind: str, path: str, seams: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """The files at `path` read as sources of one type. Texts, office files and tables have readers here; other types (pdf, image,
    audio, video, url, note, youtube) go through the caller's function for that type, from binary files to rows. A type
    that isn't known, or has no function, fails at once."""
    if kind not in TYPES:
        raise ValueError(f"unknown source type {kind}")
    if seams and kind in seams:
        return seams[kind](read_files(spark, path))
    if kind == "txt":
        return read_texts(spark, path).select("path", F.lit(1).alias("page_no"), "text", F.lit(None).cast("string").alias("problem"))
    if kind in ("docx", "pptx"):
        return {"docx": docx_texts, "pptx": pptx_texts}[kind](read_files(spark, path))
    if kind == "excel":
        return xlsx_cells(read_files(spark, path))
    if kind == "csv":
        return read_delimited(spark, path)
    raise ValueError(f"no reader for source type {kind}: give one in seams")
