"""Near copies by exact Jaccard similarity of word shingles, over SimHash sketches: what operator 5's keep_one does where a
least similarity is asked for.

One 64-bit SimHash can't tell similarity 0.8: such texts differ in ten bits of 64 on average, and no block of bits that
they surely share is long enough to be an upper node. So here

* the sketch is `WORDS64` SimHashes of the set of shingles; `radius` bounds the bits in which sets that are similar enough
  differ, by formula with a miss below 0.00001;
* each component of operator 5's own index (the SimHash of all shingles, masks, Gray order, `max_diff` bits) is a node;
* further nodes are MinHash buckets: with 20 bands of 4 hashes, sets at similarity s share one with probability
  1 - (1 - s**4)**20, 0.99997 at 0.8;
* a pair of a node whose sketches lie within the radius is a candidate; the exact similarity of the shingle sets decides.

Texts of one shingle set are one class. A node isn't compared pair by pair. First each class meets its node's leader only,
the class that shares most buckets with others (of a text and its edited copies, the text), and verified links are joined
to components. Of the rest, classes that have a candidate in another component of the node stay, each with its shingle set
once a node; a task compares a node's sets by lists of the sets that have a shingle, and returns the links that join
components, never pairs. So no pair that could still join two components is left out.

A node of any size is compared as a whole, in cells. Its classes are dealt to blocks by a hash: of `node_limit` classes where
sketches are compared, of `NODE_SHINGLES` shingles where sets are. Each two blocks of a node, and each block with itself,
meet in one cell, so each pair of the node has a cell and a task holds two blocks at most.

Defined cases: a text of up to `words` words has one shingle; null and empty texts have none and are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts_of, stored, with_text_columns
from .graph import components
from .shingles import majority, shingle_hashes

BANDS, ROWS = 20, 4
WORDS64 = 4
AT_ONCE = 1 << 19  # a numpy step holds about ten arrays of so many numbers, and each core of an executor has one
NODE_LIMIT, NODE_SHINGLES = 8192, 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words, seed), dtype=np.uint64))


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A further 64-bit hash of each hash."""
    x = (x ^ np.uint64(k * int(ODD) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def band_hashes(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """BANDS hashes of each non-empty set; two sets share one where ROWS of their minima agree."""
    rng = np.random.default_rng(seed)
    factors, offsets = (rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), np.uint64(band + 1)) * ODD
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = (key ^ np.minimum.reduceat(flat * (factors[k] | np.uint64(1)) + offsets[k], starts)) * ODD
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """WORDS64 SimHashes of each set."""
    return np.stack([majority([mixed(s, k) for s in sets]) for k in range(WORDS64)], axis=1)


def radius(least: float) -> int:
    """The bits in which the sketches of two sets at similarity `least` differ, and 4.5 standard deviations more."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    n = 64 * WORDS64
    return math.ceil(n * p + 4.5 * math.sqrt(n * p * (1 - p)))


def with_bands(df: DataFrame, words: int, seed: int) -> DataFrame:
    """Adds fingerprint (a hash of the text's shingle set), simhash (operator 5's), size (of the set), sketch and bands (null for the empty set)."""

    def make():
        def compute(texts):
            hashes = [np.array(shingle_hashes(t, words, seed), dtype=np.uint64) for t in texts]
            sets = [np.unique(h) for h in hashes]
            filled = [s for s in sets if len(s)]
            bands = iter(band_hashes(filled, seed).view(np.int64)) if filled else iter(())
            prints = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], dtype=np.uint64).view(np.int64)
            return {"fingerprint": prints, "simhash": majority(hashes), "size": [len(s) for s in sets], "sketch": list(sketches(sets)), "bands": [next(bands) if len(s) else None for s in sets]}

        return compute

    fields = [*[T.StructField(n, T.LongType()) for n in ("fingerprint", "simhash")], T.StructField("size", T.LongType()), *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("sketch", "bands")]]
    return with_text_columns(df, "text", fields, make)


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float, seed: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of `least` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            a, b, of_a, of_b = batch.columns
            good = []
            for i in range(batch.num_rows):
                if held[0] != (key := a[i].as_py()):
                    held = (key, shingle_set(of_a[i].as_py(), words, seed))
                other = shingle_set(of_b[i].as_py(), words, seed)
                both = len(np.intersect1d(held[1], other, assume_unique=True))
                good.append(both >= least * (len(held[1]) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(good, pa.bool_())) for x in (a, b)], names=["a", "b"])

    full = pairs.join(texts.toDF("b", "of_b"), "b").join(texts.toDF("a", "of_a"), "a").select("a", "b", "of_a", "of_b")
    return full.mapInArrow(run, "a long, b long")


def alike(x: str, y: str, least: float) -> F.Column:
    """Whether two classes can be similar enough: their set sizes allow it and their sketches lie within the radius."""
    apart = [F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(WORDS64)]
    sizes = F.least(f"{x}.size", f"{y}.size") >= F.greatest(f"{x}.size", f"{y}.size") * least - 1e-9
    return sizes & (sum(apart[1:], apart[0]) <= radius(least))


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, elements in both) for the pairs j < i of sets that have any, in pieces of bounded size, by lists of the sets that
    have an element."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, element, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(element, kind="stable")]
    first = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    work = np.add.reduceat(counts[element], ends - sizes)
    i = 0
    while i < n:
        j = i + 1
        while j < n and (j + 1 - i) * n <= AT_ONCE and work[i : j + 1].sum() <= AT_ONCE:
            j += 1
        e = element[ends[i] - sizes[i] : ends[j - 1]]
        times = counts[e]
        at = np.repeat(first[e], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row = np.repeat(owner[ends[i] - sizes[i] : ends[j - 1]] - i, times)
        both = np.bincount(row * n + holders[at], minlength=(j - i) * n).reshape(j - i, n)
        x, y = np.nonzero(both)
        keep = y < x + i
        yield x[keep] + i, y[keep], both[x[keep], y[keep]]
        i = j


def node_links(sets: list[np.ndarray], component: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a node's sets that join its components to those that all its links join them to."""
    _, at, root = np.unique(component, return_index=True, return_inverse=True)
    root, sizes, out = at[root], np.array([len(s) for s in sets]), []
    for i, j, both in overlaps(sets):
        near = both * (1 + least) >= least * (sizes[i] + sizes[j]) - 1e-9
        for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
            if root[x] != root[y]:
                out.append((x, y))
                root[root == root[x]] = root[y]
    return out


def blocks(nodes: DataFrame, size: Column, limit: int) -> DataFrame:
    """(bucket, blocks): the number of blocks of about `limit` that a node's rows, each of the given size, are dealt to."""
    return nodes.groupBy("bucket").agg(F.ceil(F.sum(size) / F.lit(limit)).alias("blocks"))


def block_of(fingerprint: str) -> Column:
    """The block of a class, by a hash of its own: fingerprints may share bits with buckets."""
    return F.pmod(F.xxhash64(F.lit("block"), fingerprint), "blocks")


def cells(rows: DataFrame, limit: int) -> DataFrame:
    """(bucket, low, high, fingerprint, component) from rows with a size: a class of block k is in the cells of k and each block."""
    dealt = rows.join(blocks(rows, F.col("size"), limit), "bucket").withColumn("own", block_of("fingerprint"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint", "component")


def linked_in_nodes(rows: DataFrame, texts: DataFrame, words: int, least: float, seed: int) -> DataFrame:
    """Links (a, b) between components in each cell, from rows (bucket, low, high, fingerprint, component). A cell's sets meet in one task."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts_of(batch, 1):
                sets = pa.array([shingle_set(t, words, seed).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["fingerprint", "of"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def out():
            if len({c for _, c, _ in held}) > 1:
                found = node_links([np.frombuffer(s, np.uint64) for _, _, s in held], np.array([c for _, c, _ in held]), least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([held[p[k]][0] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *at, fingerprint, component, of in zip(*batch.columns, strict=True):  # a row at a time: the sets of a batch aren't held twice
                bucket, low, high = (x.as_py() for x in at)
                row = [fingerprint.as_py(), component.as_py(), of.as_py()]
                if (bucket, low, high) != cell:
                    yield from out()
                    cell, held = (bucket, low, high), []
                held.append(row)
        yield from out()

    wanted = texts.join(rows.select("fingerprint").distinct(), "fingerprint", "left_semi").select("fingerprint", "text")
    sets = stored(wanted.mapInArrow(hashed, "fingerprint long, of binary"), "similar-sets")
    key = ("bucket", "low", "high")
    full = rows.join(sets, "fingerprint").select(*key, "fingerprint", "component", "of")
    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def apart(df: DataFrame, key: str) -> DataFrame:
    """The rows of df that aren't of the component with most rows under the key: each pair of two components has one."""
    main = df.groupBy(key, "component").count().groupBy(key).agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    return df.join(main, key).filter("component <> main").drop("main")


def links(df: DataFrame, prints: DataFrame, words: int, least: float, seed: int, node_limit: int = NODE_LIMIT, more: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between fingerprints, whose components are those of all verified candidate pairs.

    df: __row, text; prints: __row, fingerprint, size, sketch, bands; more: further nodes (fingerprint, bucket), a class once in each.
    """
    classes = stored(prints.filter("size > 0").groupBy("fingerprint").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "bands")], F.min("__row").alias("__row")), "classes")
    item = F.struct("fingerprint", "size", *[F.col("sketch")[k].alias(f"s{k}") for k in range(WORDS64)]).alias("item")
    placed = classes.select("fingerprint", F.explode("bands").alias("bucket"))
    if more is not None:
        placed = placed.unionByName(more.select("fingerprint", "bucket"))
    # only the rows of shared buckets, few of all, meet their classes' sketches
    placed = placed.repartition("bucket")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(placed.join(shared, "bucket").join(classes, "fingerprint").select("bucket", "n", "__row", item), "met")
    weights = met.groupBy("item.fingerprint").agg(F.sum("n").alias("weight"), F.first("__row").alias("__row"))
    texts = stored(df.select("__row", "text").join(weights, "__row").dropDuplicates(["__row"]).select("fingerprint", "text"), "similar-texts")

    weighed = met.select("bucket", "item", F.col("item.fingerprint").alias("fingerprint")).join(weights.select("fingerprint", "weight"), "fingerprint")
    leaders = weighed.groupBy("bucket").agg(F.max_by("item", F.struct("weight", "fingerprint")).alias("leader"))
    stars = met.select("bucket", "item").join(leaders, "bucket").filter("item.fingerprint <> leader.fingerprint").filter(alike("leader", "item", least))
    first = stored(verified(stars.select(F.col("leader.fingerprint").alias("a"), F.col("item.fingerprint").alias("b")).distinct(), texts, words, least, seed), "first-links")

    named = components(met.select("bucket", "item", F.col("item.fingerprint").alias("fingerprint")), first)
    several = named.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("several")).filter("several").select("bucket")
    named = stored(named.join(several, "bucket"), "named")
    # both sides are dealt to blocks, so that a node of n classes isn't n * n comparisons of one task
    dealt = named.join(blocks(named, F.lit(1), node_limit), "bucket").withColumn("block", block_of("item.fingerprint"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    few = apart(dealt, "bucket").select("bucket", F.col("block").alias("theirs"), every.alias("ours"), F.col("item").alias("other"), F.col("component").alias("c"))
    dealt = dealt.select("bucket", F.col("block").alias("ours"), every.alias("theirs"), "item", "component")
    meets = [F.col(f"named.{k}") == F.col(f"few.{k}") for k in ("bucket", "ours", "theirs")]
    meets = meets[0] & meets[1] & meets[2] & (F.col("component") != F.col("c")) & alike("item", "other", least)
    left = dealt.alias("named").join(few.alias("few"), meets, "left_semi").select("bucket", "item.fingerprint", "component", "item.size")
    right = few.alias("few").join(dealt.alias("named"), meets, "left_semi").select("bucket", "other.fingerprint", F.col("c").alias("component"), "other.size")
    rest = stored(left.unionByName(right).distinct(), "rest")
    return first.unionByName(linked_in_nodes(cells(rest, NODE_SHINGLES), texts, words, least, seed))
