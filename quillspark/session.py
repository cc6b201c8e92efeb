"""Session settings and table access that every query shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that results or plans rely on; cluster sizes (executors, memory, shuffle partitions) stay with the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(app: str = "quillspark", **more: str) -> SparkSession:
    """A session with the settings above; `more` adds or replaces settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Fixed value: seconds that a scan for a question may take.
SCAN_SECONDS = 15
R = TypeVar("R")


class ScanTimeout(TimeoutError):
    """A scan took longer than it may."""


def bounded(spark: SparkSession, seconds: float, action: Callable[[], R]) -> R:
    """What action() returns, or ScanTimeout once its jobs have run for `seconds`: they carry a tag of their own, and a timer cancels
    that tag alone, so other queries go on. Tags of the context, as a session's can only be interrupted by the thread that set them."""
    sc, tag, late = spark.sparkContext, f"scan-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        while not done.wait(0.2):  # an action may start job after job
            sc.cancelJobsWithTag(tag)

    done, timer = threading.Event(), threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise ScanTimeout(f"stopped after {seconds:g} s") from e
        raise
    finally:
        done.set()
        timer.cancel()
        sc.removeJobTag(tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir. A temporary folder serves local mode alone, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: several readers then share one pass, each with its own columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with each row's place in this order, from 0. Rows are dealt by ranges of the order and numbered within their partition; the driver
    sees one count a partition, so no task holds them all. df is written first, as dealing by range reads it twice."""
    dealt = stored(df, f"{name}-rows").repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits are the row within its partition
    local = stored(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), f"{name}-places")
    ahead, n = [], 0
    for part, count in sorted(local.groupBy("__part").count().collect()):
        ahead.append((part, n))
        n += count
    offsets = F.broadcast(df.sparkSession.createDataFrame(ahead, "__part int, __ahead long"))
    return local.join(offsets, "__part").withColumn(name, F.col("__ahead") + F.col("__row")).select(*df.columns, name)
