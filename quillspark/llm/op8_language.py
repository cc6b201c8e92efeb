"""Language identification with bit-sliced Bloom filters of n-grams.

All languages share one Bloom filter whose cells are bit masks, a bit per language (more than 64 languages take
several mask words). An n-gram's hashes pick K cells; their AND is the set of all languages whose filter holds
the n-gram. A text counts, per language, how many of its n-grams the language holds (a popcount over the
masks' bit slice), takes off what false positives add (the filter's own rate), and divides by what the language's
own training texts reach; the largest share decides, ties by name.

A language holds an n-gram if at least MIN_TEXTS of its training texts have it, at half or more of the rate of the
language that uses it most. Training texts are a bounded sample: about per_language of each language by a hash of the
id, outside the held-out fold, at most max_chars characters a language. Columns called lang_pred or score are replaced.

Defined cases: null texts and texts without a letter are `und` with score 0; without training texts all are `und`;
letters of no known n-gram get the first language by name with score 0; rows are judged each for itself, so repeated
rows and ids with several texts get a row each.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, with_text_columns

N = 4
K = 3
CELL_BITS = 20
PER_LANGUAGE, MAX_CHARS = 1500, 6_000_000
MIN_TEXTS = 3
SHARE_OF_BEST = 0.5
LETTER = re.compile(r"[^\W\d_]")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass
class Model:
    languages: list[str]
    cells: np.ndarray  # (2 ** CELL_BITS, mask words) of uint64
    false_rate: np.ndarray
    own_rate: np.ndarray


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all character n-grams of the lower-cased, space-framed texts, and how many each text has."""
    framed = [f" {t.lower()} " if t else "" for t in texts]
    sizes = np.array([max(len(t) - N + 1, 0) for t in framed], dtype=np.int64)
    points = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not sizes.sum():
        return np.empty(0, np.uint64), sizes
    key = np.zeros(len(points) - N + 1, np.uint64)
    for i in range(N):
        key = (key ^ points[i : len(points) - N + 1 + i]) * MIX[0]
        key ^= key >> np.uint64(29)
    lengths = np.array([len(t) for t in framed], dtype=np.int64)
    inside = np.repeat(np.cumsum(lengths) - lengths, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return key[inside], sizes


def cell_numbers(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys * m) >> np.uint64(64 - CELL_BITS)).astype(np.int64) for m in MIX[:K]]


def masks(model_cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The set of languages that hold each n-gram, one mask word a column."""
    first, *rest = cell_numbers(keys)
    found = model_cells[first]
    for c in rest:
        found &= model_cells[c]
    return found


def held_counts(model_cells: np.ndarray, n_languages: int, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, language) counts of held n-grams, and all n-grams of each text."""
    keys, sizes = grams(texts)
    found = masks(model_cells, keys)
    counts = np.zeros((len(texts), n_languages), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes[some]) - sizes[some]
        for j in range(n_languages):
            slice_ = ((found[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
            counts[some, j] = np.add.reduceat(slice_, starts)
    return counts, sizes


def shares(model: Model, texts: Sequence[str | None]) -> np.ndarray:
    counts, sizes = held_counts(model.cells, len(model.languages), texts)
    rate = counts / np.maximum(sizes, 1)[:, None]
    true_rate = np.maximum(0, (rate - model.false_rate) / (1 - model.false_rate))
    return true_rate / model.own_rate


def train_on(texts: dict[str, Sequence[str]]) -> Model | None:
    """A model from training texts by language."""
    languages = sorted(k for k, v in texts.items() if v)
    if not languages:
        return None
    use = []
    for lang in languages:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for a in range(0, len(texts[lang]), 64):
            k, sizes = grams(texts[lang][a : a + 64])
            ends = np.cumsum(sizes)
            each = [np.unique(k[e - s : e]) for e, s in zip(ends, sizes, strict=True)]
            keys, where = np.unique(np.concatenate([keys, *each]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, *[np.ones(len(x), np.int64) for x in each]]), minlength=len(keys)).astype(np.int64)
        use.append((keys, counts, len(texts[lang])))
    every = np.unique(np.concatenate([u[0] for u in use]))
    rates = np.zeros((len(languages), len(every)))
    several = np.zeros((len(languages), len(every)), bool)
    for j, (keys, counts, n) in enumerate(use):
        at = np.searchsorted(every, keys)
        rates[j, at] = counts / n
        several[j, at] = counts >= min(MIN_TEXTS, n)
    holds = several & (rates >= SHARE_OF_BEST * rates.max(axis=0))
    cells = np.zeros((1 << CELL_BITS, -(-len(languages) // 64)), np.uint64)
    for j in range(len(languages)):
        for c in cell_numbers(every[holds[j]]):
            np.bitwise_or.at(cells[:, j // 64], c, np.uint64(1 << (j % 64)))
    full = np.array([((cells[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(languages))])
    model = Model(languages, cells, full**K, np.ones(len(languages)))
    own = [np.median(shares(model, texts[lang])[:, j]) for j, lang in enumerate(languages)]
    model.own_rate = np.maximum(np.array(own), 1e-3)
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model | None:
    """A model from (doc_id, text, lang) outside the held-out fold. A language's sample is the ids whose hash lies under a
    threshold that about per_language of its ids do: a filter of the scan, after a count by language. A language whose
    texts exceed max_chars goes on with those that still fit."""
    known = docs.filter("lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy("lang").collect()}  # a row a language
    if not counts:
        return None
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") * F.lit(2.0**-53)
    under = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    texts = known.filter(place < under[F.col("lang")]).filter("text is not null").select("doc_id", "lang", "text")
    sample: dict[str, list[str]] = {n: [] for n in counts}
    room = dict.fromkeys(counts, max_chars)
    for row in texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).toLocalIterator():  # keys without texts: Spark samples them to the driver
        if len(row["text"]) <= room[row["lang"]] and LETTER.search(row["text"]):
            room[row["lang"]] -= len(row["text"])
            sample[row["lang"]].append(row["text"])
    return train_on({k: sorted(set(v)) for k, v in sample.items()})


def predictor(model: Model | None):
    def predict(texts):
        lettered = [bool(t) and LETTER.search(t) is not None for t in texts]
        if model is None:
            return ["und"] * len(texts), [0.0] * len(texts)
        s = shares(model, [t if ok else None for t, ok in zip(texts, lettered, strict=True)])
        best = s.argmax(axis=1)
        top = s[np.arange(len(s)), best] / np.maximum(s.sum(axis=1), 1e-12)
        return [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], [float(x) if ok else 0.0 for x, ok in zip(top, lettered, strict=True)]

    return predict


def identify(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (the predicted language's part of all languages' shares); no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** CELL_BITS cells, whatever the input

    def make():
        predict = predictor(shared.value)

        def compute(texts):
            lang, score = predict(texts)
            return {"lang_pred": lang, "score": score}

        return compute

    return with_text_columns(df, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
