"""Extension points: embedding, generation, description and transcription functions given by the caller.

A callable runs in batches inside Arrow-backed pandas UDFs; it must be picklable. Without one, the hash embedder gives
deterministic vectors, for tests and offline use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[Sequence[float]]]
BATCH = 32


def hash_embedder(dims: int = 64) -> Embed:
    """A unit vector per text from hashes of its words."""

    def embed(texts: list[str]) -> list[Sequence[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out

    return embed


def with_embeddings(df: DataFrame, embed: Embed, text_col: str = "content", out_col: str = "embedding", batch: int = BATCH) -> DataFrame:
    """Adds vectors, `batch` texts per call; a blank text fails the batch, so filter blanks first."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out = part.tolist(), []
            if any(t is None or not t.strip() for t in texts):
                raise ValueError("blank text in an embedding batch")
            for a in range(0, len(texts), batch):
                found = embed(texts[a : a + batch])
                if len(found) != len(texts[a : a + batch]):
                    raise ValueError("an embedder must return one vector a text")
                out += [list(map(float, v)) for v in found]
            yield pd.Series(out)

    return df.withColumn(out_col, run(F.col(text_col)))


def with_text(df: DataFrame, call: Callable[[object], str | None], in_col: str, out_col: str) -> DataFrame:
    """Adds what a per-row function (generation, description of a figure, OCR of a page) returns; errors become nulls."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return call(v)
            except Exception:
                return None

        return values.map(one)

    return df.withColumn(out_col, run(F.col(in_col)))


def refilled(pages: DataFrame, ocr: Callable[[object], str | None], text_col: str = "text", image_col: str = "image") -> DataFrame:
    """Blank pages read again from their image; adds ocr_used and still_empty."""
    blank = F.trim(F.coalesce(F.col(text_col), F.lit(""))) == ""
    read = with_text(pages.withColumn("__image", F.when(blank, F.col(image_col))), lambda v: ocr(v) if v is not None else None, "__image", "__ocr")
    text = F.when(blank, F.coalesce("__ocr", F.lit(""))).otherwise(F.col(text_col))
    return read.select(*[c for c in pages.columns if c != text_col], text.alias(text_col), (blank & F.col("__ocr").isNotNull()).alias("ocr_used"), (F.trim(text) == "").alias("still_empty"))


def first_answer(sources: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, served_by) of the first source with an answer that isn't empty."""
    value, by = F.lit(None), F.lit(None).cast("string")
    for name, c in reversed(sources):
        full = c.isNotNull() & (F.length(c.cast("string")) > 0)
        value, by = F.when(full, c).otherwise(value), F.when(full, F.lit(name)).otherwise(by)
    return value, by


class Registry:
    """Named callables: tools that a definition may list, or providers of a service in order of preference."""

    def __init__(self, **known: Callable):
        self.known = dict(known)

    def add(self, name: str, call: Callable) -> None:
        self.known[name] = call

    def get(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"unknown name {name!r}; known: {sorted(self.known)}")
        return self.known[name]

    def allowed(self, names: Sequence[str]) -> dict[str, Callable]:
        """Those of the listed names that are known, in the list's order."""
        return {n: self.known[n] for n in dict.fromkeys(names) if n in self.known}

    def first(self, names: Sequence[str], *args) -> tuple[object, str | None]:
        """(result, served_by) of the first listed provider whose result isn't empty; one that fails is passed over."""
        for name, call in self.allowed(names).items():
            try:
                found = call(*args)
            except Exception:  # the next provider serves
                continue
            if found:
                return found, name
        return None, None
