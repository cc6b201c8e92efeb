"""Document fingerprints by a randomised edit embedding.

Shared random walks map edit distance to Hamming distance (the CGK embedding): all texts are read by one walk
that stays on a character or moves on, by random bits that depend on the step and the character only. Two texts
that differ by an edit fall into step again soon after it, so their embeddings differ in few places.

A fingerprint samples `BITS` places of the embedding of n characters, of about 2n places. Place k of a text is
the last record, up to its length, of a shared random sequence of records; two texts of nearly equal length so
sample nearly the same places, whatever the length, and no text is cut. The bit is a random hash of the
character there. Equal texts have equal fingerprints; unrelated ones agree in about half of the bits, so likeness
is 2 * (share of equal bits) - 1, at least 0.

Near copies are found by bit-sampled banding (each band is a sample of fingerprint bits; a shared band makes a
candidate) and verified on the whole fingerprint, then, if asked for, by edit distance.

Defined cases: a null text counts as empty; the fingerprint of an empty text is all zero bits; repeated rows each
get a row and rows are ordered by doc_id, then text, a null id first; the last row is followed by the first, so a
single row follows itself; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_text_columns

BITS = 256
PERIOD = 4096  # steps after which the walk's random bits repeat
BANDS, BAND_BITS = 32, 14
LONGEST = 1 << 48
WIDTH = 128
SEED = 20240229
WALKS = 3  # a walk falls out of step for good after one edit of ten in a text of 600 characters; a search takes several
LEAST = 0.7  # a pair this alike shares a band with probability 0.96


class Walk:
    """The randomness that all texts share, from one seed."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        moves = rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
        stay = np.ones((PERIOD, 256), np.int64)
        wait = np.full(256, 1, np.int64)
        for t in range(2 * PERIOD - 1, -1, -1):  # steps until the walk leaves a character of each class met at step t
            wait = np.where(moves[t % PERIOD] == 1, 1, wait + 1)
            stay[t % PERIOD] = wait
        self.stay = np.minimum(stay, 255).astype(np.uint8).tobytes()
        self.bit = rng.integers(0, 2, (BITS, 257), dtype=np.uint8)
        records = []
        for _ in range(BITS):  # record times of a sequence of random numbers: t, then the least t' > t / uniform
            at, times = 1, []
            while at < LONGEST:
                times.append(at)
                at = int(at / (1 - rng.random())) + 1
            records.append(times)
        self.records = np.full((BITS, max(map(len, records))), 2 * LONGEST)
        for row, times in zip(self.records, records, strict=True):
            row[: len(times)] = times

    def places(self, n: int) -> np.ndarray:
        """The sampled steps, from 0, for a text of n characters."""
        last = (self.records <= max(1, 2 * n)).sum(axis=1) - 1
        return self.records[np.arange(BITS), last] - 1

    def times(self, classes: bytes, at: int) -> Iterator[int]:
        stay = self.stay
        for c in classes:
            yield at
            at += stay[(at & 4095) << 8 | c]
        yield at

    def steps(self, classes: np.ndarray, at: int = 0) -> np.ndarray:
        """The step at which the walk reaches each character, and at last the one at which it ends."""
        return np.fromiter(self.times(classes.tobytes(), at), np.int64, len(classes) + 1)

    def print_of(self, classes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        if not len(classes):
            return np.zeros(BITS, np.uint8)
        at = np.searchsorted(steps, self.places(len(classes)), side="right") - 1
        there = np.append(classes.astype(np.int64), 256)[np.minimum(at, len(classes))]
        return self.bit[np.arange(BITS), there]


def classes_of(text: str) -> np.ndarray:
    """A class below 256 for each code point; those below 256 have their own."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((points ^ (points >> 8) * np.uint32(167)) & np.uint32(255)).astype(np.uint8)


def packed(bits: np.ndarray) -> str:
    return np.packbits(bits).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, 2 * float((a == b).mean()) - 1)


def found(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two fingerprints share a band and are alike by `least`."""
    return bool((a[BAND_AT] == b[BAND_AT]).all(axis=1).any()) and likeness(a, b) >= least


BAND_AT = np.stack([np.random.default_rng(1000 + k).permutation(BITS)[:BAND_BITS] for k in range(BANDS)])


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", seed: int = SEED) -> DataFrame:
    """Adds the fingerprint of each whole text as hex digits; no shuffle."""

    def make():
        walk = Walk(seed)

        def compute(texts):
            out = []
            for t in texts:
                c = classes_of(t or "")
                out.append(packed(walk.print_of(c, walk.steps(c))))
            return {out_col: out}

        return compute

    return with_text_columns(df, text_col, [T.StructField(out_col, T.StringType())], make)


def part_of(doc_id: F.Column, bounds: list[int]) -> F.Column:
    """How many bounds lie below an id, 0 for null: found among every WIDTH-th bound, then among those between two of them."""
    if not bounds:
        return F.lit(0)
    below = lambda held: F.size(F.filter(held, lambda b: b < doc_id))
    groups = [bounds[i : i + WIDTH] for i in range(0, len(bounds), WIDTH)]
    group = F.greatest(below(F.array(*[F.lit(g[0]) for g in groups])) - 1, F.lit(0))
    fine = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    return F.coalesce(F.when(doc_id.isNull(), 0), group * WIDTH + below(F.get(fine, group)))


def next_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, last, doc_id, text) dealt to partitions by id and sorted: rows of a part in order, then, with last = 1, the
    row that follows them. One shuffle of the texts; bounds and first ids are bounded by the number of parts."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = [k / parts for k in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", cuts, 10 * max(1000, parts)).alias("b")).first()["b"] or [])) if cuts else []

    own = rows.withColumn("part", part_of(F.col("doc_id"), bounds))
    first = F.when(F.max(F.col("doc_id").isNull()), None).otherwise(F.min("doc_id")).alias("first")
    heads = {r["part"]: r["first"] for r in own.groupBy("part").agg(first).collect()}
    used = sorted(heads)
    # a row for each part that has rows: its first id, and the part ahead, whose last row that id follows
    table = spark.createDataFrame([(p, heads[p], used[k - 1]) for k, p in enumerate(used)], "part int, first long, ahead int")
    sends = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.col("ahead"))
    own = own.join(F.broadcast(table), "part")
    both = own.select(F.explode(F.array(F.struct("part", F.lit(0).alias("last")), F.struct(sends.alias("part"), F.lit(1).alias("last")))).alias("to"), "doc_id", "text").filter("to.part is not null")
    return both.select("to.part", "to.last", "doc_id", "text").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, found_edited boolean, found_next boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text (the last quarter replaced by the first as many code
    points of the next row's text), their likeness, the next row's, and whether the search would find each pair: banding, then verification."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        out: list[dict] = []
        held = None

        def close(row, after_text, after_bits):
            doc_id, text, classes, steps, bits = row
            n = len(classes)
            q = n // 4
            put = after_text[:q] if q else ""
            edited = text[: n - q] + put
            if q:
                tail = classes_of(put)
                moved = np.concatenate([steps[: n - q], walk.steps(tail, int(steps[n - q]))])
                edited_bits = walk.print_of(np.concatenate([classes[: n - q], tail]), moved)
            else:
                edited_bits = bits
            return dict(zip(NAMES, (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), packed(bits), packed(edited_bits), likeness(bits, edited_bits), likeness(bits, after_bits), found(bits, edited_bits), found(bits, after_bits)), strict=True))

        for batch in batches:
            walk = walk or Walk()
            for part, last, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and held is None:
                    continue  # a second copy of the row that follows
                classes = classes_of(text)
                steps = walk.steps(classes)
                bits = walk.print_of(classes, steps)
                if held is not None:
                    out.append(close(held, text, bits))
                held = None if last else (doc_id, text, classes, steps, bits)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                out = []

    return next_in_order(docs, id_col, text_col).mapInArrow(run, SCHEMA)


ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def near_matches(queries: DataFrame, docs: DataFrame, least: float = LEAST, max_edit_share: float | None = None, id_col: str = "doc_id", text_col: str = "text", walks: int = WALKS) -> DataFrame:
    """(query_id, doc_id, near): pairs whose fingerprints, by one of `walks` independent walks, share a band and are alike by
    `least` or more; near is the greatest likeness.

    Bands join different fingerprints only; copies come back by membership. With max_edit_share the texts' edit
    distance is verified as well, as a share of the longer one's length. Rows with a null id are searched and found like others;
    a row isn't a match of its own id. Empty texts, null included, are alike; other columns, whatever their names, stay behind.
    """

    def banded(rows: DataFrame, name: str) -> DataFrame:
        bits = F.concat(*[F.lpad(F.conv(F.substring(name, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)])
        bands = [F.concat_ws(":", F.lit(str(k)), F.concat(*[F.substring("bits", int(i) + 1, 1) for i in at])) for k, at in enumerate(BAND_AT)]
        return rows.select(name).distinct().withColumn("bits", bits).select(name, F.explode(F.array(*bands)).alias("band"))

    words = [F.bit_count(F.conv(F.substring("a", 1 + 8 * i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", 1 + 8 * i, 8), 16, 10).cast("long"))) for i in range(BITS // 32)]
    near = F.greatest(F.lit(0.0), 1 - 2 * sum(words[1:], words[0]) / F.lit(BITS))
    q_texts, d_texts = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) for df in (queries, docs))
    union = None
    for walk in range(walks):
        q_rows, d_rows = with_fingerprint(q_texts, "text", "a", SEED + walk), with_fingerprint(d_texts, "text", "b", SEED + walk)
        pairs = banded(q_rows, "a").join(banded(d_rows, "b"), "band").select("a", "b").distinct().withColumn("near", near).filter(F.col("near") >= least)
        out = pairs.join(q_rows.select("a", F.col("id").alias("query_id"), F.col("text").alias("query_text")), "a").join(d_rows.select("b", F.col("id").alias("doc_id"), "text"), "b")
        out = out.filter("not query_id <=> doc_id or query_id is null")
        if max_edit_share is not None:
            out = out.filter(F.levenshtein("query_text", "text") <= max_edit_share * F.greatest(F.length("query_text"), F.length("text")))
        out = out.select("query_id", "doc_id", "near")
        union = out if union is None else union.unionByName(out)
    return union.groupBy("query_id", "doc_id").agg(F.max("near").alias("near"))
