"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a run of `window` item words (an item of fewer words is one pattern). Texts become arrays of word
numbers, 0 for a word that no item has, so the search's alphabet is words. For the patterns of one length:

* the shift table maps the hash of a block (the last two words read) to how far the next possible end of a
  pattern is; most blocks occur in no pattern and skip length - 1 words at once;
* a block with shift 0 selects the bucket of patterns that end in it (suffix hash);
* the words themselves are then compared, last and first word ahead of the rest.

A batch is scanned in a few thousand strips side by side, each by the shift rule, so numpy does the skipping.
Patterns are split into tables of at most `table_words` item words, whose size bounds what a task holds; with
more items than that the texts are searched once a table and the hits united. Documents are never shuffled.

Defined cases: a null or empty text has no words, no hits and is clean; items without words match nothing; an
empty benchmark leaves all clean; repeated items count by item_id; items with a null id are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_by_text, with_text_columns

#: ASCII other than letters and digits ends a word; A-Z is lower-cased; bytes from 0x80 on belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
STRIPS = 4096
TABLE_WORDS = 4_000_000
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class LengthTable:
    """Shift table and suffix buckets for patterns of one length; patterns is a (count, length) array."""

    def __init__(self, patterns: np.ndarray):
        self.patterns = patterns
        count, self.m = patterns.shape
        self.b = min(2, self.m)
        self.slots = 1 << max(10, int(np.ceil(np.log2(4 * count * self.m))))
        self.shift = np.full(self.slots, self.m - self.b + 1, np.int32)
        for end in range(self.b - 1, self.m):
            np.minimum.at(self.shift, self.block(patterns[:, end], patterns[:, end - 1]), self.m - 1 - end)
        suffix = self.block(patterns[:, -1], patterns[:, -2] if self.m > 1 else patterns[:, -1])
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.by_suffix], np.arange(self.slots + 1))

    def block(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        x = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.b == 2:
            x = (x ^ before.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x >> np.uint64(40)).astype(np.int64) & (self.slots - 1)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where a pattern may end: the positions at which the shift rule stops with a shift of 0."""
        n = len(ids)
        if n < self.m:
            return np.empty(0, np.int64)
        edges = np.linspace(self.m - 1, n, min(STRIPS, n) + 1).astype(np.int64)
        at, to = edges[:-1].copy(), edges[1:]
        found = []
        while True:
            live = at < to
            if not live.all():
                at, to = at[live], to[live]
            if not len(at):
                break
            step = self.shift[self.block(ids[at], ids[at - 1])]
            stop = step == 0
            found.append(at[stop])
            at = at + np.maximum(step, 1)
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of every occurrence."""
        at = self.ends(ids)
        slot = self.block(ids[at], ids[at - 1])
        sizes = self.bucket[slot + 1] - self.bucket[slot]
        hits_at, hits_pattern = [], []
        for a, b in blocks_of(sizes, 1 << 20):
            where = np.repeat(at[a:b], sizes[a:b])
            inner = np.arange(len(where)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
            pattern = self.by_suffix[np.repeat(self.bucket[slot[a:b]], sizes[a:b]) + inner]
            for back in [0, self.m - 1, *range(1, self.m - 1)] if self.m > 1 else [0]:
                same = ids[where - back] == self.patterns[pattern, self.m - 1 - back]
                where, pattern = where[same], pattern[same]
            hits_at.append(where)
            hits_pattern.append(pattern)
        none = np.empty(0, np.int64)
        return np.concatenate([none, *hits_at]), np.concatenate([none, *hits_pattern])


def blocks_of(sizes: np.ndarray, most: int):
    """Ranges whose sizes add up to about `most`; a larger one is a range of its own."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


class Patterns:
    """The search structure of some items: word numbers, one LengthTable a length, and each pattern's items."""

    def __init__(self, items: Sequence[tuple[int, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set[int]]] = {}
        for item, text in items:
            w = words_of(text)
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1) if size else ():
                by_length.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.tables = []
        for _, found in sorted(by_length.items()):
            owners = [sorted(x) for x in found.values()]
            self.tables.append((LengthTable(np.array(list(found), dtype=np.int64)), np.cumsum([0, *map(len, owners)]), np.array([x for o in owners for x in o], dtype=np.int64)))

    def scan(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[np.ndarray]]:
        """For each text: words, words hit, its items, and the hit words' places."""
        number = self.vocabulary.get
        counts, flat = [], [0]
        for text in texts:
            w = words_of(text)
            counts.append(len(w))
            flat += [number(x, 0) for x in w]
            flat.append(0)  # no pattern crosses from one text to the next
        ids = np.array(flat, dtype=np.int64)
        counts = np.array(counts, dtype=np.int64)
        first = 1 + np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
        change = np.zeros(len(ids) + 1, np.int64)
        items: list[set[int]] = [set() for _ in texts]
        for searcher, offsets, owners in self.tables:
            at, pattern = searcher.matches(ids)
            np.add.at(change, at - searcher.m + 1, 1)
            np.add.at(change, at + 1, -1)
            for d, p in set(zip((np.searchsorted(first, at, side="right") - 1).tolist(), pattern.tolist(), strict=True)):
                items[d].update(owners[offsets[p] : offsets[p + 1]].tolist())
        hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        doc = np.searchsorted(first, hit, side="right") - 1
        n_hit = np.bincount(doc, minlength=len(texts))
        places = np.split(hit - first[doc], np.cumsum(n_hit)[:-1]) if len(texts) else []
        return counts, n_hit, [sorted(x) for x in items], places


def item_groups(benchmark: DataFrame, id_col: str, text_col: str, table_words: int) -> list[list[tuple[int, str]]]:
    """The items in groups of at most so many words (at least one item each).

    What reaches the driver is the benchmark, a fixed test set that doesn't grow with the corpus; a group, the most
    that a task holds at once, is bounded by table_words whatever its size.
    """
    groups: list[list[tuple[int, str]]] = [[]]
    held = 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i is not null").distinct().orderBy("i", "t").toLocalIterator():
        n = len(words_of(row["t"]))
        if held and held + n > table_words:
            groups.append([])
            held = 0
        groups[-1].append((row["i"], row["t"]))
        held += n
    return groups


def is_contaminated(n_words: F.Column, n_hit: F.Column) -> F.Column:
    """Any hit, and hits make a twentieth of the words at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, table_words: int = TABLE_WORDS) -> DataFrame:
    """Adds n_words, n_hit, items (ids with occurring windows, ascending) and contaminated."""
    groups = item_groups(benchmark, item_col, item_text_col, table_words)
    sc = df.sparkSession.sparkContext
    if len(groups) == 1:
        shared = sc.broadcast(groups[0])

        def make():
            patterns = Patterns(shared.value, window)

            def compute(texts):
                n, hit, items, _ = patterns.scan(texts)
                return {"n_words": n, "n_hit": hit, "items": items}

            return compute

        out = with_text_columns(df, text_col, FIELDS, make)
    else:
        out = df
        parts = []
        for k, group in enumerate(groups):
            shared = sc.broadcast(group)

            def make(shared=shared, k=k):
                patterns = Patterns(shared.value, window)

                def compute(texts):
                    n, _, items, places = patterns.scan(texts)
                    return {"n_words": n, f"__items_{k}": items, f"__places_{k}": [p.tolist() for p in places]}

                return compute

            fields = [FIELDS[0], T.StructField(f"__items_{k}", FIELDS[2].dataType), T.StructField(f"__places_{k}", FIELDS[2].dataType)]
            out = with_text_columns(out, text_col, fields, make)
            parts.append(k)
        out = out.withColumn("n_hit", F.size(F.array_distinct(F.concat(*[f"__places_{k}" for k in parts]))).cast("long"))
        out = out.withColumn("items", F.array_sort(F.array_distinct(F.concat(*[f"__items_{k}" for k in parts]))))
        out = out.drop(*[f"__{x}_{k}" for k in parts for x in ("items", "places")])
    return out.withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13, table_words: int = TABLE_WORDS) -> DataFrame:
    """The rows of df that aren't contaminated, with the columns of df."""
    groups = item_groups(benchmark, "item_id", "text", table_words)
    if len(groups) > 1:
        name = "__row"
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), F.col(f"`{text_col}`").alias("text"))
        found = decontaminate(packed, benchmark, "text", window=window, table_words=table_words)
        return found.filter(~F.col("contaminated")).select(f"{name}.*")
    shared = df.sparkSession.sparkContext.broadcast(groups[0])

    def make():
        patterns = Patterns(shared.value, window)

        def clean(texts):
            n, hit, _, _ = patterns.scan(texts)
            return ~((hit > 0) & (20 * hit >= n))

        return clean

    return filter_by_text(df, text_col, make)


def items_digest(items: F.Column) -> F.Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


__all__ = ["Patterns", "decontaminate", "drop_contaminated", "items_digest", "words_of"]
