"""Chat formatting with masks aligned by offsets.

A conversation is rendered whole: `<|im_start|>role<|im_sep|>text<|im_end|>` for each turn. Control strings are
tokens of their own, at both ends of every text, so a token never reaches over a turn's edge. Inside roles and
texts every `<|` is written `<\\|` and every `<\\` is written `<\\\\`, which is undone exactly on reading.

The rendered text is encoded once, with offsets. The spans of the assistant texts and of the tokens are both
sorted; two binary searches per turn give the range of tokens inside it, which is the loss mask.

Defined cases: a null text or role counts as empty; turns with equal numbers are ordered by role, then text; a null
turn number comes first; rows with a null conv_id form one conversation; an empty table gives none. One
conversation is the unit that has to be rendered whole, so it must fit in a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, SEP, END]
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BATCH_CHARS, BATCH_ROWS = 1 << 18, 256
ESCAPED = re.compile(r"<\\([\\|])")
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
Finish = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
SCHEMA = "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
FIELDS = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), *[(n, pa.list_(pa.int32())) for n in ("token_ids", "token_starts", "token_ends")], ("loss_mask", pa.list_(pa.bool_()))])


def escape(text: str) -> str:
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the sorted spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role or '')}{SEP}", escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that share a character with a span; all arrays are ascending."""
    mask = np.zeros(len(starts), bool)
    if spans:
        a, b = np.array(spans).T
        for i, j in zip(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left"), strict=True):
            mask[i:j] = True
    return mask


def load(path: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in CONTROL])
    return tokenizer


def encoded(rows: list[tuple], encoder) -> pa.RecordBatch:
    """A formatted batch of (conv_id, rendered text, assistant spans). Texts are encoded one by one: an encoding takes far
    more memory than the arrays kept of it."""
    columns: list[list] = [[] for _ in FIELDS]
    for conv_id, text, spans in rows:
        found = encoder.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, dtype=np.int32).reshape(-1, 2)
        starts, ends = offsets[:, 0], offsets[:, 1]
        for column, value in zip(columns, (conv_id, text, np.array(found.ids, np.int32), starts, ends, mask_of(starts, ends, spans)), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)


def formatted(batches: Iterable[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Formatted batches of (conv_id, turns); a batch holds about BATCH_CHARS characters or one conversation."""
    encoder = None
    for batch in batches:
        encoder = encoder or load(tokenizer)
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            rows = [(i, *render([tuple(t.values()) for t in turns])) for i, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            for a, b in slices([r[1] for r in rows], BATCH_CHARS):
                yield encoded(rows[a:b], encoder)


def format_chats(turns: DataFrame, tokenizer: str = TOKENIZER, finish: Finish | None = None, finish_schema: str = SCHEMA) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): the rendered text, token ids, their offsets in
    code points, and the loss mask.

    finish, if given, is what becomes of the formatted batches in the same Python worker (its rows have finish_schema), so
    token arrays needn't travel to the JVM and back.
    """
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.struct(x["role"], x["text"])).alias("turns")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = formatted(batches, tokenizer)
        return finish(done) if finish else done

    return grouped.mapInArrow(run, finish_schema)


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask: runs of masked tokens, each unescaped, joined with nothing between."""
    on = np.flatnonzero(mask)
    if not len(on):
        return ""
    cut = np.flatnonzero(np.diff(on) > 1) + 1
    return "".join(unescape(formatted[starts[run[0]] : ends[run].max()]) for run in np.split(on, cut))
