"""Structured pages: a model marks up a document's pages batch by batch, and each call is told the section it starts in.

Batches of a document depend on one another by a section's name alone. So pages are dealt by document and sorted, and a task goes
through them with that name as its state: it holds one batch, however long a document is. Blocks, sections and the report are
expressions over the answers again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import text as X
from . import structure
from .media import PAGES_A_CALL, page_batches

# Characters of a page that a call is given, pages that a document may have, the mark of a cut.
PAGE_INPUT, MOST_PAGES = 12_000, 300
CUT = "\n…(truncated)"

HEADING = re.compile(r"^[ \t]*#{1,6}[ \t]+(.*?)[ \t]*#*[ \t\r]*$", re.M)
MARK = re.compile(r"\[PAGE ([0-9]+)\]")
FENCE = re.compile(r"^```[a-z]*\n|\n?```$")

#: What a model callable returns: its text, alone or with a mapping of prompt_tokens and completion_tokens.
Answer = str | tuple[str, dict[str, int]]


def prompt_of(pages: list[tuple[int, str]], section: str) -> str:
    """What a text model is asked: pages behind [PAGE n] marks, and the section that goes on."""
    ahead = f"The first page goes on with the section: {section}\n" if section else ""
    return "Mark up these pages as Markdown, headings as # lines. Repeat each [PAGE n] mark.\n" + ahead + "\n".join(f"[PAGE {n}]\n{t}" for n, t in pages)


def parts_of(answer: str) -> dict[int, str]:
    """Page texts of an answer by number; of repeated marks the first counts."""
    found = MARK.split(FENCE.sub("", answer.strip()))
    parts: dict[int, str] = {}
    for number, body in zip(found[1::2], found[2::2], strict=True):
        parts.setdefault(int(number), body.strip())
    return parts


def marked_up(pages: DataFrame, key: str, generate: Callable[[str], Answer], vision: Callable[[object, str], Answer], size: int = PAGES_A_CALL, page_input: int = PAGE_INPUT, most_pages: int = MOST_PAGES) -> DataFrame:
    """A row a page: key, page_no, batch_no, route, status, section_before, text, cut, prompt_tokens, completion_tokens.

    pages: key, page_no, text, image (what `vision` takes: bytes, or better a reference to them). Runs of pages with text go to
    generate(prompt), `size` at a time; a blank page goes to vision(image, section). status is 'ok'; 'raw' where a text page keeps
    its own text, since its batch failed, held nothing, or lacks its mark; 'failed' where vision failed or read nothing (text is
    null); 'refused' for all pages of a document of more than most_pages, for which nothing is called. A failure touches its own
    batch or page. section_before is the last Markdown heading ahead of the batch. Tokens stand at a batch's first page. A call
    gets page_input characters of a page (`cut` where there were more); a raw page keeps its whole text. A null key is a
    document; a task that runs again calls again. Waiting limits are the callables' own.
    """
    fields = [
        T.StructField("__doc", pages.schema[key].dataType),
        *[T.StructField(n, t) for n, t in (("page_no", T.IntegerType()), ("batch_no", T.LongType()), ("route", T.StringType()), ("status", T.StringType()), ("section_before", T.StringType()), ("text", T.StringType()), ("cut", T.BooleanType()), ("prompt_tokens", T.LongType()), ("completion_tokens", T.LongType()))],
    ]

    def called(call: Callable, *args) -> tuple[str, dict]:
        try:
            answer = call(*args)
        except Exception:  # this batch or page degrades, the others go on
            return "", {}
        return (answer or "", {}) if not isinstance(answer, tuple) else (answer[0] or "", answer[1] or {})

    def read(batch: list[dict], section: str) -> tuple[list[tuple[str, str | None]], dict]:
        """(status, text) of each page of a batch, and the call's usage."""
        if batch[0]["refused"]:
            return [("refused", None)] * len(batch), {}
        if batch[0]["route"] == "vision":
            said, usage = called(vision, batch[0]["image"], section)
            return [("ok", said.strip()) if said.strip() else ("failed", None)], usage
        sent = [(p["page_no"], p["text"] if len(p["text"]) <= page_input else p["text"][:page_input] + CUT) for p in batch]
        said, usage = called(generate, prompt_of(sent, section))
        parts = parts_of(said)
        return [("ok", parts[p["page_no"]]) if parts.get(p["page_no"]) else ("raw", p["text"]) for p in batch], usage

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"section": ""}

        def flush(held: list[dict]) -> list[tuple]:
            first = held[0]
            if "doc" not in state or state["doc"] != first["__doc"]:
                state.update(doc=first["__doc"], section="")
            before = state["section"]
            found, usage = read(held, before)
            for _, text in found:
                state["section"] = next((h for h in reversed(HEADING.findall(text or "")) if h), state["section"])
            tokens = [(usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0))] + [(0, 0)] * (len(held) - 1)
            return [(p["__doc"], p["page_no"], p["batch_no"], p["route"], status, before, text, p["route"] == "text" and len(p["text"]) > page_input, *t) for p, (status, text), t in zip(held, found, tokens, strict=True)]

        held: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(names, batch.columns, strict=True)}
                if held and (held[0]["__doc"], held[0]["batch_no"]) != (row["__doc"], row["batch_no"]):
                    out += flush(held)
                    held = []
                held.append(row)
            yield from rows_of(out)
        if held:
            yield from rows_of(flush(held))

    def rows_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema, names = to_arrow_schema(T.StructType(fields)), ["__doc", "page_no", "batch_no", "route", "refused", "text", "image"]
    own = pages.select(F.col(f"`{key}`").alias("__doc"), F.col("page_no").cast("int").alias("page_no"), X.empty(F.col("text")).alias("text"), "image")
    own = own.withColumn("refused", F.count("*").over(W.partitionBy("__doc")) > most_pages)
    batched = page_batches(own, "__doc", size).select(*names)
    done = batched.repartition("__doc").sortWithinPartitions("__doc", "page_no").mapInArrow(run, T.StructType(fields))
    return done.withColumnRenamed("__doc", key)


def elements(marked: DataFrame, key: str) -> DataFrame:
    """(key, page_no, block_no, kind, block, document_order, element_id, section, parent_id) of marked_up's pages, in reading order."""
    blocks = structure.blocks(marked.filter(X.empty(F.col("text")) != "").select(key, "page_no", "text"))
    placed = blocks.withColumn("__place", F.struct("page_no", "block_no"))
    return structure.section_chain(placed, key, "__place").drop("__place")


def report(marked: DataFrame, key: str) -> DataFrame:
    """A row a document: pages, text_batches, vision_pages, vision_done, raw_pages and failed_pages and cut_pages (numbers), degraded,
    refused, and its tokens. An aggregate with map-side combine."""
    numbers = lambda held: F.array_sort(F.collect_set(F.when(held, F.col("page_no"))))
    is_ = lambda c, v: F.col(c) == v
    return marked.groupBy(key).agg(
        F.count("*").alias("pages"),
        F.count_distinct(F.when(is_("route", "text"), F.col("batch_no"))).alias("text_batches"),
        F.count_if(is_("route", "vision")).alias("vision_pages"),
        F.count_if(is_("route", "vision") & is_("status", "ok")).alias("vision_done"),
        numbers(is_("status", "raw")).alias("raw_pages"),
        numbers(is_("status", "failed")).alias("failed_pages"),
        numbers(F.col("cut")).alias("cut_pages"),
        F.bool_or(F.col("status") != "ok").alias("degraded"),
        F.bool_or(is_("status", "refused")).alias("refused"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
