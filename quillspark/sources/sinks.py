"""Writes: the document tree, replacing and purging sources, lead exports, reports, event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.people import LEAD_COLUMNS


def document_tree(drafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, segments, chunks) of drafts (workspace_id, kb_id, source_id, title, page_no, start_ms, end_ms, text,
    embedding): a segment holds the text as it came, a chunk the normalised one; blank drafts are left out."""
    kept = drafts.filter(X.strip(X.empty(F.col("text"))) != "")
    order = [c for c in ("page_no", "start_ms", "end_ms") if c in kept.columns]
    documents = kept.groupBy("workspace_id", "kb_id", "source_id").agg(F.first("title", ignorenulls=True).alias("title"), F.max("page_no").alias("page_count"), F.coalesce(F.max("end_ms"), F.lit(0)).alias("duration_ms"))
    key = F.sha1(F.concat_ws("/", F.col("source_id").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order], F.col("text")))
    rows = kept.withColumn("segment_id", key)
    segments = rows.select("workspace_id", "kb_id", "source_id", "segment_id", *order, "text")
    content = X.normalize(F.col("text"))
    chunks = rows.select("workspace_id", "kb_id", "source_id", "segment_id", F.col("segment_id").alias("chunk_id"), *order, content.alias("content"), X.token_estimate(F.size(X.words(content))).alias("tokens"), X.terms(content).alias("terms"), "embedding")
    return documents, segments, chunks


def write_partitioned(df: DataFrame, path: str, replace_partitions: bool = False) -> None:
    """Parquet by (workspace_id, kb_id), so scoped reads prune; with replace_partitions only the partitions in df change."""
    writer = df.write.mode("overwrite" if replace_partitions else "append").partitionBy("workspace_id", "kb_id")
    (writer.option("partitionOverwriteMode", "dynamic") if replace_partitions else writer).parquet(path)


def replaced(stored: DataFrame, fresh: DataFrame, key: str = "source_id") -> DataFrame:
    """The table after a re-ingest: rows of the fresh sources go, then the fresh rows come."""
    return purged(stored, fresh.select(key).distinct(), key).unionByName(fresh, allowMissingColumns=True)


def purged(stored: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    return stored.join(sources.select(key), key, "left_anti")


def write_leads(leads: DataFrame, path: str) -> None:
    """CSV parts with the fixed columns, a header and a byte order mark each, as spreadsheets expect."""
    columns = [F.col(c).cast("string").alias(c) if c in leads.columns else F.lit(None).cast("string").alias(c) for c in LEAD_COLUMNS]
    named = leads.select(*columns).withColumnRenamed(LEAD_COLUMNS[0], "﻿" + LEAD_COLUMNS[0])
    named.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame) -> DataFrame:
    """A frame's rows as lines of a Markdown table, header lines not included."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("line"))


def sse_frames(payload: Column) -> Column:
    """A server-sent event of a struct."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def answer_slices(answer: Column, size: int = 800) -> Column:
    """A ready answer in slices of `size` characters."""
    last = F.greatest(F.lit(0), F.floor((F.length(answer) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(answer, k * size + 1, F.lit(size)))
