"""Places in a total order that no task has to hold: rows are dealt by ranges of their keys, each task counts its own run,
and what lies ahead of a run is known from one summary row a partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch

ADDED = "part int, row long, rank long, closing boolean, through long"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however many readers it has."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def runs(df: DataFrame, group: str, weight: str) -> DataFrame:
    """Adds, within each partition as it is sorted: part, row, rank in its group, whether the group ends, and the weight so far."""
    names = df.columns
    at, heavy = names.index(group), names.index(weight)

    def marked(batch: pa.RecordBatch, n: int, began: int, total: int, goes_on: bool) -> tuple[pa.RecordBatch, int, int]:
        """The batch with its places; began: the first row of the group that its first row belongs to."""
        column = batch.column(at)
        changes = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        row = np.arange(n, n + len(column))
        start = np.maximum.accumulate(np.where(np.concatenate([[False], changes]), row, began))
        through = total + np.cumsum(batch.column(heavy).to_numpy(zero_copy_only=False))
        closing = np.concatenate([changes, [not goes_on]])
        part = np.full(len(row), TaskContext.get().partitionId(), np.int32)
        added = [pa.array(x) for x in (part, row, row - start, closing, through)]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "part", "row", "rank", "closing", "through"]), int(start[-1]), int(through[-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, began, total = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                same = held.column(at)[held.num_rows - 1] == batch.column(at)[0]
                out, began, total = marked(held, n, began, total, same)
                n += held.num_rows
                began = began if same else n
                yield out
            held = batch
        if held is not None:
            yield marked(held, n, began, total, False)[0]

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T.StructType.fromDDL(ADDED).fields]))


def ordered(df: DataFrame, keys: Sequence, group: str, weight: str, name: str) -> DataFrame:
    """df in the order of its keys, as a written table with row (place in the whole order, from 0), rank (place in its group),
    closing (last of its group) and through (sum of the weight up to and with the row).

    Groups follow each other in the order of the keys; group and weight are never null. Rows of one group can lie in many
    partitions, so a hot group is no hot task. df is written first, as dealing by range reads it twice; the driver sees one row a partition.
    """
    spark = df.sparkSession
    dealt = written(df, f"{name}-rows").repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = written(runs(dealt, group, weight), f"{name}-runs")
    summary = local.groupBy("part").agg(
        F.count("*").alias("n"), F.max("through").alias("sum"), F.min_by(group, "row").alias("head"), F.max_by(group, "row").alias("tail"), F.max_by("rank", "row").alias("rank")
    )
    parts = sorted(summary.collect(), key=lambda r: r["part"])
    ahead, n, total, rank, tail = [], 0, 0, 0, None
    for p, after in zip(parts, [*parts[1:], None][: len(parts)], strict=True):
        carried = rank if p["head"] == tail else 0  # rows of the first group in the partitions ahead
        ahead.append((p["part"], n, p["n"], total, carried, after is None or after["head"] != p["tail"]))
        n, total = n + p["n"], total + p["sum"]
        rank, tail = p["rank"] + 1 + (carried if p["rank"] + 1 == p["n"] else 0), p["tail"]
    offsets = F.broadcast(spark.createDataFrame(ahead, "part int, rows_ahead long, rows long, sum_ahead long, rank_ahead long, ends boolean"))
    places = {
        "closing": F.when(F.col("row") == F.col("rows") - 1, F.col("ends")).otherwise(F.col("closing")),
        "rank": F.col("rank") + F.when(F.col("row") == F.col("rank"), F.col("rank_ahead")).otherwise(0),
        "through": F.col("through") + F.col("sum_ahead"),
        "row": F.col("row") + F.col("rows_ahead"),
    }
    return local.join(offsets, "part").select(*df.columns, *[c.alias(n) for n, c in places.items()])
