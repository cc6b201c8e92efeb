"""Leases of ingest work: claims by compare-and-set in a log of numbered commits, and liveness by timers.

The log lies in a folder that all drivers share. A change is computed from the state at a version, its rows are written as
Parquet, and the change counts once the file of the next number is created, which only one writer can do; a writer that comes second
computes its change anew from the state it lost to. So of two runs that want a source at once, one claims it and the other sees
the fresh claim. Every SNAPSHOT commits the state is written whole, so a reader opens one snapshot and a few commits.

Defined cases: a null source id is never claimed; a source asked for twice is claimed once; a heartbeat or an end from a run that doesn't hold
the lease changes nothing; rows of a commit that was never created are never read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import FRESH_SECONDS, claimed

STATE = "source_id string, run_id string, status string, beat_at timestamp"
SNAPSHOT, TRIES = 20, 100


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call created the file, whole: False if it was there. A local or mounted folder gets a hard link of a finished
    file; other stores are asked to create without overwriting, which HDFS does in one step. A store that can't refuse an
    existing name is unfit for the log."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        os.makedirs(os.path.dirname(at.path), exist_ok=True)
        part = f"{at.path}.{uuid.uuid4().hex}"
        with open(part, "x") as f:
            f.write(text)
        try:
            os.link(part, at.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, kind, folder) of each commit, in order. A commit is one short line in a file of its own."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    done = [n for n in names if n.isdigit()]
    if not done:
        return []
    lines = spark.read.text([f"{path}/commits/{n}" for n in done[-2 * SNAPSHOT :]]).select(F.col("value"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("n"))
    return sorted((int(r["n"]), *r["value"].split(" ", 1)) for r in lines.collect())


class Leases:
    """The lease log in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def state(self) -> tuple[int, DataFrame]:
        """(version, the newest row of each source)."""
        done = commits(self.spark, self.path)
        if not done:
            return 0, self.spark.createDataFrame([], STATE)
        since = max((i for i, (_, kind, _) in enumerate(done) if kind == "snapshot"), default=0)
        rows = None
        for number, _, folder in done[since:]:
            part = self.spark.read.schema(STATE).parquet(f"{self.path}/data/{folder}").withColumn("version", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        newest = rows.groupBy("source_id").agg(F.max_by(F.struct("run_id", "status", "beat_at"), "version").alias("x")).select("source_id", "x.*")
        return done[-1][0], newest

    def commit(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows (STATE) that change() makes of the state, committed against that state: it is called again after a lost race."""
        for _ in range(TRIES):
            version, state = self.state()
            folder = uuid.uuid4().hex
            change(state).select("source_id", "run_id", "status", "beat_at").write.parquet(f"{self.path}/data/{folder}")
            rows = self.spark.read.schema(STATE).parquet(f"{self.path}/data/{folder}")
            if rows.isEmpty():
                return rows
            if create_once(self.spark, f"{self.path}/commits/{version + 1:010d}", f"change {folder}\n"):
                if (version + 1) % SNAPSHOT == 0:
                    self.snapshot()
                return rows
        raise RuntimeError(f"no commit in {TRIES} tries")

    def snapshot(self) -> None:
        """Writes the state as a commit of its own; another writer's commit ahead of it makes it void, which loses nothing."""
        version, state = self.state()
        folder = uuid.uuid4().hex
        state.write.parquet(f"{self.path}/data/{folder}")
        create_once(self.spark, f"{self.path}/commits/{version + 1:010d}", f"snapshot {folder}\n")

    def claim(self, sources: DataFrame, wanted: DataFrame, run_id: str, now, fresh: int = FRESH_SECONDS) -> DataFrame:
        """(source_id, outcome) of each wanted source, as `claimed` tells them by the log: the claims are committed before this returns.

        sources: source_id, status, heartbeat_at, processing_started_at, created_at; what the log knows of a source takes their place.
        """
        kinds = dict(sources.dtypes)
        outcomes: list[DataFrame] = []

        def change(state: DataFrame) -> DataFrame:
            known = state.select(F.col("source_id").alias("__id"), F.col("status").alias("__status"), F.col("beat_at").alias("__beat"))
            now_known = sources.join(known, F.col("source_id").cast("string") == F.col("__id"), "left")
            there = F.col("__id").isNotNull()
            merged = now_known.select(
                "source_id", F.coalesce("__status", "status").alias("status"), F.when(there, F.col("__beat")).otherwise(F.col("heartbeat_at")).alias("heartbeat_at"),
                F.when(~there, F.col("processing_started_at")).alias("processing_started_at"), F.when(~there, F.col("created_at")).alias("created_at"),
            )
            path = f"{self.path}/outcomes/{uuid.uuid4().hex}"  # read twice: the claims of it, and what is returned
            claimed(merged, wanted, now, fresh).select("source_id", "outcome").write.parquet(path)
            outcomes.append(self.spark.read.parquet(path))
            return outcomes[-1].filter("outcome = 'claimed'").select(F.col("source_id").cast("string").alias("source_id"), F.lit(run_id).alias("run_id"), F.lit("processing").alias("status"), F.lit(now).cast("timestamp").alias("beat_at"))

        self.commit(change)
        return outcomes[-1].select(F.col("source_id").cast(kinds["source_id"]).alias("source_id"), "outcome")

    def held(self, state: DataFrame, run_id: str) -> DataFrame:
        return state.filter((F.col("run_id") == run_id) & (F.col("status") == "processing"))

    def beat(self, run_id: str, now) -> DataFrame:
        """A sign of life for all that the run holds."""
        return self.commit(lambda s: self.held(s, run_id).withColumn("beat_at", F.lit(now).cast("timestamp")))

    def finish(self, run_id: str, ended: DataFrame, now) -> DataFrame:
        """Ends leases that the run still holds: ended has source_id and status (ready or failed)."""
        done = ended.select(F.col("source_id").cast("string").alias("source_id"), F.col("status").alias("__to"))
        return self.commit(lambda s: self.held(s, run_id).join(done, "source_id").withColumn("status", F.col("__to")).withColumn("beat_at", F.lit(now).cast("timestamp")))


class Watch(StatefulProcessor):
    """A timer a source: each sign of life sets it anew, an end deletes it, and when it runs out the source is pending again."""

    def __init__(self, silence_ms: int, key: str):
        self.silence, self.key = silence_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getValueState("beats", "n long")

    def quiet(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        n = self.beats.get()[0] if self.beats.exists() else 0
        self.quiet()
        if events["kind"].iloc[-1] in ("finished", "failed"):
            self.beats.clear()
        else:
            self.beats.update((int(n) + len(events),))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield pd.DataFrame({self.key: pd.Series([], dtype=object), "status": pd.Series([], dtype=object), "beats": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.beats.get()[0] if self.beats.exists() else 0
        self.beats.clear()
        yield pd.DataFrame({self.key: [key[0]], "status": ["pending"], "beats": [int(n)]})

    def close(self) -> None:
        pass


def silent_sources(events: DataFrame, silence_seconds: float = FRESH_SECONDS, key: str = "source_id") -> DataFrame:
    """(source_id, 'pending', beats) of each source that has given no sign of life for `silence_seconds` since its last event, from a stream of
    (source_id, kind 'started', 'beat', 'finished' or 'failed', at): a timer tells, no new event is needed. State is a number and a
    timer for each source at work. The session needs the RocksDB state store (`state_store`)."""
    kind = dict(events.dtypes)[key]
    rows = events.filter(F.col(key).isNotNull()).select(key, "kind", "at")
    return rows.groupBy(key).transformWithStateInPandas(Watch(int(silence_seconds * 1000), key), f"{key} {kind}, status string, beats long", "append", "processingTime")


def state_store(spark: SparkSession) -> None:
    """The state store that timers need, for this session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
