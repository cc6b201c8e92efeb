"""Stateful and incremental jobs on Structured Streaming.

State is kept per key and bounded: a rate limiter holds at most `calls` times, the ingest queue what a watermark keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import intents as I
from ..operators.structure import packed

# Browser rounds a turn may take, sizes of translated pieces, seconds that a claim stays fresh.
MOST_ROUNDS, PIECE_CHARS, LONG_CHARS, FRESH_SECONDS = 2, 5000, 6000, 2400


def admit(times: list[float], held: list[float], calls: int, period: float) -> tuple[list[bool], list[float]]:
    """Sliding-window limit over ascending times: calls strictly older than the period go, a call is refused when `calls`
    are held, refused calls aren't held."""
    out = []
    for t in times:
        held = [h for h in held if h >= t - period]
        ok = len(held) < calls
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def rate_limited(events: DataFrame, key: str, at: str = "at", calls: int = 3, period: float = 60.0) -> DataFrame:
    """(key, at, allowed) for a stream of (key, at in seconds). Keys are the unit of state."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        times = sorted(float(x) for f in frames for x in f[at])
        allowed, held = admit(times, held, calls, period)
        state.update((held,))
        yield pd.DataFrame({key: [k[0]] * len(times), at: times, "allowed": allowed})

    kind = dict(events.dtypes)[key]
    return events.select(key, F.col(at).cast("double").alias(at)).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {at} double, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def rate_limited_batch(events: DataFrame, key: str, at: str = "at", calls: int = 3, period: float = 60.0) -> DataFrame:
    """The same over a table: each task streams its keys' ordered times and holds at most `calls` times of the key at hand.
    Rows without a time are left out; a null key is a key."""
    rows = events.select(key, F.col(at).cast("double").alias(at)).filter(F.col(at).isNotNull())
    placed = rows.repartition(key).sortWithinPartitions(key, at)
    kind = dict(events.dtypes)[key]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = object(), []
        for frame in frames:
            allowed = []
            for k, t in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                if k != current:
                    current, held = k, []
                one, held = admit([t], held, calls, period)
                allowed += one
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(allowed, pa.bool_())], names=[key, at, "allowed"])

    return placed.mapInArrow(run, f"`{key}` {kind}, `{at}` double, allowed boolean")


def ingest_queue(arrivals: DataFrame, ingest: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "source_id", late: str = "1 hour"):
    """A query that ingests new sources once: repeats within the watermark are dropped, a batch writes to its own folder, so
    a batch that runs again overwrites what it wrote."""
    once = arrivals.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        ingest(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and mean latency by window and span, of a stream with a TIMESTAMP created_at."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", width), "span").agg(F.count("*").alias("calls"), F.avg("latency_ms").alias("avg_latency_ms"))


def reset_orphans(sources: DataFrame, now, seconds: int = 2400, most: int = 50) -> DataFrame:
    """Sources whose processing gave no sign of life for longer than `seconds`: back to pending, the oldest `most` first."""
    beat = F.coalesce("heartbeat_at", "processing_started_at", "created_at")
    old = sources.filter((F.col("status") == "processing") & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(beat) > seconds))
    return old.orderBy(beat, "source_id").limit(most).withColumn("status", F.lit("pending"))


def failed_stale(sources: DataFrame, now, minutes: int = 30) -> DataFrame:
    """All sources, with those that have been processing for more than `minutes` failed."""
    beat = F.coalesce("processing_started_at", "created_at")
    old = (F.col("status") == "processing") & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(beat) >= minutes * 60)
    return sources.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def claimed(sources: DataFrame, wanted: DataFrame, now, fresh: int = FRESH_SECONDS) -> DataFrame:
    """(source_id, outcome, status, processing_started_at) of each wanted source: claimed, refused while another run's claim is
    fresh, or not found. The claim is the status that the caller writes back; a source asked for twice is claimed once."""
    asked = wanted.select("source_id").filter("source_id is not null").distinct()
    beat = F.coalesce("heartbeat_at", "processing_started_at", "created_at")
    alive = (F.col("status") == "processing") & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(beat) <= fresh)
    x = asked.join(sources.withColumn("__there", F.lit(True)).withColumn("__alive", F.coalesce(alive, F.lit(False))), "source_id", "left")
    outcome = F.when(F.col("__there").isNull(), "not found").when(F.col("__alive"), "refused").otherwise("claimed")
    took = outcome == "claimed"
    return x.select("source_id", outcome.alias("outcome"), F.when(took, "processing").otherwise(F.col("status")).alias("status"), F.when(took, F.lit(now)).otherwise(F.col("processing_started_at")).alias("processing_started_at"))


class Heartbeat(StreamingQueryListener):
    """Keeps the time of each query's last sign of life, for whoever writes it to the sources' heartbeat_at."""

    def __init__(self):
        self.last: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = event.timestamp

    def onQueryProgress(self, event) -> None:
        self.last[str(event.progress.id)] = event.progress.timestamp

    def onQueryIdle(self, event) -> None:
        self.last[str(event.id)] = event.timestamp

    def onQueryTerminated(self, event) -> None:
        self.last.pop(str(event.id), None)


def tool_turn(pending: bool, rounds: int, kind: str, needs_tool: bool, most: int = MOST_ROUNDS) -> tuple[str, bool, int]:
    """(outcome, pending, rounds) after a message or a tool's result: paused for a browser tool while rounds are left, else
    answered, which ends the turn; a result that nothing waits for is a conflict and changes nothing."""
    if kind == "result" and not pending:
        return "conflict", pending, rounds
    if kind == "message":
        rounds = 0
    if needs_tool and rounds < most:
        return "paused", True, rounds + 1
    return "answered", False, 0


def tool_turns(events: DataFrame, key: str = "conversation_id", order: str = "seq") -> DataFrame:
    """(key, order, outcome) for a stream of (key, order, kind 'message' or 'result', needs_tool). State: a flag and a count a key."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, rounds = state.get if state.exists else (False, 0)
        rows, out = sorted((r for f in frames for r in f[[order, "kind", "needs_tool"]].itertuples(index=False, name=None)), key=lambda r: r[0]), []
        for _, kind, needs in rows:
            outcome, pending, rounds = tool_turn(bool(pending), int(rounds), kind, bool(needs))
            out.append(outcome)
        state.update((bool(pending), int(rounds)))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: [r[0] for r in rows], "outcome": out})

    kinds = dict(events.dtypes)
    rows = events.select(key, order, "kind", F.coalesce("needs_tool", F.lit(False)).alias("needs_tool"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, outcome string", "pending boolean, rounds int", "append", GroupStateTimeout.NoTimeout)


def translation_turns(messages: DataFrame, key: str = "conversation_id", order: str = "seq") -> DataFrame:
    """(key, order, piece_no, total, piece) of each message that gets a part of a long translation: a request on a named
    text of more than LONG_CHARS gets its first piece, "continue" the next one until none is left; other messages give no row.

    messages: key, order, text, and named_text, the text of the file that the message names, if any. The cursor is a fold over
    a conversation's messages that carries three numbers; texts are joined to it afterwards.
    """
    pieces = F.when(I.wants_translation(F.col("text")) & (F.length("named_text") > LONG_CHARS), packed(F.split("named_text", "\n\n"), PIECE_CHARS, PIECE_CHARS))
    cut = messages.select(key, order, I.wants_more(F.col("text")).alias("more"), pieces.alias("pieces"))
    light = cut.select(key, order, "more", F.coalesce(F.size("pieces"), F.lit(0)).alias("n"))
    kind = dict(messages.dtypes)[order]
    turn = f"struct<at:{kind},origin:{kind},piece_no:int,total:int>"
    zero = F.struct(F.lit(None).cast(turn).alias("now"), F.array().cast(f"array<{turn}>").alias("out"))

    def step(acc, m):
        left = F.coalesce(acc["now"]["piece_no"] < acc["now"]["total"], F.lit(False))
        following = F.struct(m[order].alias("at"), acc["now"]["origin"].alias("origin"), (acc["now"]["piece_no"] + 1).alias("piece_no"), acc["now"]["total"].alias("total"))
        first = F.struct(m[order].alias("at"), m[order].alias("origin"), F.lit(1).alias("piece_no"), m["n"].alias("total"))
        got = F.when(m["more"] & left, following).when(m["n"] > 1, first).cast(turn)
        return F.struct(F.coalesce(got, acc["now"]).alias("now"), F.when(got.isNotNull(), F.array_append(acc["out"], got)).otherwise(acc["out"]).alias("out"))

    folded = light.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "more", "n"))).alias("m"))
    turns = folded.select(key, F.explode(F.aggregate("m", zero, step, lambda acc: acc["out"])).alias("t")).select(key, F.col("t.at").alias(order), F.col("t.origin").alias("__origin"), F.col("t.piece_no"), F.col("t.total"))
    texts = cut.filter("size(pieces) > 1").select(key, F.col(order).alias("__origin"), F.posexplode("pieces").alias("__i", "piece")).withColumn("piece_no", F.col("__i") + 1).drop("__i")
    return turns.join(texts, [key, "__origin", "piece_no"]).select(key, order, "piece_no", "total", "piece")
