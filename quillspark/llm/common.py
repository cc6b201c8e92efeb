"""Helpers that the corpus operators share: tables, folds, scratch space and Arrow batches.

Naming rule of every operator here: a result column takes the place of an input column of the same name, so
tables with extra columns, even ones with clashing names, pass through unharmed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: With it, the shuffle files of an action go as it ends; without, they stay until the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters of text that one numpy step looks at; bounds a Python worker's memory whatever the Arrow batch is.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text and is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode, where nothing else is set."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quillspark-"))
        there = sc.getCheckpointDir()
    return there


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the lineage ends at files that outlive any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each action within go as it ends."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back. Readers take their own columns, know the size and read many small
    files in one task, which they can't of a checkpoint; the step's shuffle files go as it ends."""
    path = scratch(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(lengths: Iterable[int], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters; one long text makes a range of its own."""
    start = held = i = 0
    for i, n in enumerate(lengths, 1):
        if held and held + n > chars:
            yield start, i - 1
            start, held = i - 1, 0
        held += n
    if start < i:
        yield start, i


def slices(texts: Sequence[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    return ranges((len(t) if t else 0 for t in texts), chars)


def parts_of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batch in ranges of rows, each with its texts: no more of a batch than a range is held as Python strings."""
    for a, b in ranges(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()):
        part = batch.slice(a, b - a)
        yield part, part.column(at).to_pylist()


Columns = dict[str, Sequence]


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns as c0, c1, ...: mapInArrow looks up the names that it is given unquoted."""
    return df.select(*[quoted(n).alias(f"c{i}") for i, n in enumerate(names)])


def with_text_columns(df: DataFrame, text_col: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[list], Columns]]) -> DataFrame:
    """Adds columns computed from the texts of each Arrow batch, without a shuffle; other columns pass untouched.

    make() runs once a task and returns a function from texts (None for null) to the new columns.
    """
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in names or c == text_col]
    base = by_position(df, kept)
    out = T.StructType([f for f in df.select(*map(quoted, kept)).schema.fields if f.name not in names] + list(fields))
    at = kept.index(text_col)
    keep_at = [i for i, c in enumerate(kept) if c not in names]
    arrow = [to_arrow_type(f.dataType) for f in fields]
    labels = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            compute = compute or make()
            for part, texts in parts_of(batch, at):
                got = compute(texts)
                arrays = [part.column(i) for i in keep_at] + [pa.array(got[n], type=t) for n, t in zip(labels, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[kept[i] for i in keep_at] + labels)

    return base.mapInArrow(run, out)


def filter_by_text(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], Sequence[bool]]]) -> DataFrame:
    """Keeps the rows whose text passes, with all their columns and without a shuffle."""
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = None
        for batch in batches:
            keeps = keeps or make()
            mask = [bool(x) for _, texts in parts_of(batch, at) for x in keeps(texts)]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(mask, type=pa.bool_())).columns, names=names)

    return by_position(df, names).mapInArrow(run, df.schema)
