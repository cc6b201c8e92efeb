"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of word shingles link at `max_diff` differing bits or fewer. The index is a tree of nodes, each a
masked bit pattern that all fingerprints below it share:

* The upper nodes live in Spark. Free bits are cut into max_diff + 1 blocks; two linked fingerprints agree on at
  least one block, so a child node per block (mask grown by that block, pattern = fingerprint & mask) loses no
  link. A node with more different fingerprints than `node_limit` is factored again over its remaining free bits, so
  a hot pattern splits until it is small; with k free bits left a node has 2**k fingerprints at most, and one
  with fewer free bits than blocks is final.
* Below, a task holds one upper node's fingerprints in Gray order (neighbours differ in few bits), groups runs of
  eight under a shared pattern, runs of those again, and compares groups from the top: differences accumulate
  over the bits that a level adds, and a pair of groups beyond max_diff is dropped whole.

Only different fingerprints enter the index (copies are counted once, by key), and a node returns a spanning
forest of its links, never all pairs. Components come from alternating large-star and small-star steps, each round
written to the shared folder.

Defined cases: null and empty texts have fingerprint 0 and link like any other; repeated rows each get a row;
a null doc_id stays in its row, and a component of null ids only has component_id null; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar
from .common import stored, with_text_columns
from .graph import components, connected_components, row_key, survivors
from .shingles import majority, shingle_hashes

FULL = (1 << 64) - 1
FANOUT = 8
PAIRS_AT_ONCE = 1 << 18
def with_fingerprints(df: DataFrame, text_col: str = "text", words: int = 3, seed: int = 42, out_col: str = "fingerprint") -> DataFrame:
    """Adds the SimHash of each whole text as a 64-bit integer."""

    def make():
        return lambda texts: {out_col: majority([shingle_hashes(t, words, seed) for t in texts])}

    return with_text_columns(df, text_col, [T.StructField(out_col, T.LongType())], make)


def gray_rank(c: F.Column) -> F.Column:
    """Place of a bit string in the reflected Gray sequence: the running XOR of its bits from the top."""
    for shift in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, shift))
    return c


def child_masks(mask: int, blocks: int) -> list[int]:
    """The node's mask grown by each of so many blocks of its free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // blocks for k in range(blocks + 1)]
    grown = [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in grown]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within the row) for rows of these sizes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class GrayTree:
    """Groups of the Gray-ordered fingerprints of some upper nodes; level 0 is the fingerprints themselves."""

    def __init__(self, fps: np.ndarray, node_sizes: np.ndarray):
        self.n = len(fps)
        full = np.full(self.n, np.uint64(FULL))
        self.levels = [(full, fps, np.arange(self.n), np.ones(self.n, np.int64))]  # mask, pattern, first child, children
        sizes = node_sizes
        while (sizes > 1).any():
            mask, pattern, _, _ = self.levels[-1]
            groups = -(-sizes // FANOUT)
            node, k = spread(groups)
            first = (np.cumsum(sizes) - sizes)[node] + k * FANOUT
            children = np.minimum(FANOUT, sizes[node] - k * FANOUT)
            lead = np.repeat(pattern[first], children)
            agree = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), first)
            self.levels.append((agree, pattern[first] & agree, first, children))
            sizes = groups

    def links(self, max_diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs i < j within max_diff bits, in pieces of bounded size."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.int16))]
        while stack:
            level, a, b, diff = stack.pop()
            if len(a) > PAIRS_AT_ONCE // FANOUT and level:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half], diff[:half]), (level, a[half:], b[half:], diff[half:])]
                continue
            if level == 0:
                off = a != b
                if off.any():
                    yield a[off], b[off]
                continue
            mask, _, first, children = self.levels[level]
            cm, cp, _, _ = self.levels[level - 1]
            row, k = spread(children[a] * children[b])
            width = children[b][row]
            x, y = first[a][row] + k // width, first[b][row] + k % width
            keep = x <= y
            row, x, y = row[keep], x[keep], y[keep]
            new_bits = cm[x] & cm[y] & ~(mask[a] & mask[b])[row]
            total = diff[row] + popcount((cp[x] ^ cp[y]) & new_bits)
            keep = total <= max_diff
            if keep.any():
                stack.append((level - 1, x[keep], y[keep], total[keep]))


def join_sets(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The forest `root`, where every item points at the least of its set, with the sets of each a, b joined."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        lo, hi = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


def node_forest(fps: np.ndarray, node_sizes: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each upper node: (fingerprint, fingerprint of its root)."""
    root = np.arange(len(fps))
    for a, b in GrayTree(fps, node_sizes).links(max_diff):
        root = join_sets(root, a, b)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def grown_masks(masks: DataFrame, max_diff: int, node_limit: int) -> DataFrame:
    """(mask, child) for each mask that can be factored further: its node may hold more than node_limit fingerprints, and it
    has a free bit at least for each block, so every child is greater than its parent and the tree ends."""
    blocks = max_diff + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_ = [m for m in batch.column(0).to_pylist() if (free := 64 - (m & FULL).bit_count()) >= blocks and 1 << free > node_limit]
            grown = [(m, child) for m in open_ for child in child_masks(m & FULL, blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in grown], pa.int64()) for i in (0, 1)], names=["mask", "child"])

    return masks.mapInArrow(run, "mask long, child long")


def upper_nodes(fingerprints: DataFrame, max_diff: int, node_limit: int) -> DataFrame:
    """Different (fingerprint, mask): the nodes, each of a mask and a pattern, in which a fingerprint is compared.

    A node of more than node_limit fingerprints gives way to its children, a level at a time; its own rows are dropped.
    """
    pattern = F.col("fingerprint").bitwiseAND(F.col("mask"))
    roots = F.array(*[F.lit(m).cast("long") for m in child_masks(0, max_diff + 1)])
    nodes = fingerprints.select("fingerprint").distinct().select("fingerprint", F.explode(roots).alias("mask"))
    ready: list[DataFrame] = []
    while True:
        hot = stored(nodes.groupBy("mask", pattern.alias("pattern")).count().filter(F.col("count") > node_limit).select("mask", "pattern"), "hot-nodes")
        steps = stored(grown_masks(hot.select("mask").distinct(), max_diff, node_limit), "grown-masks")
        if steps.isEmpty():
            break
        hot = hot.join(steps.select("mask").distinct(), "mask")
        keyed = nodes.withColumn("pattern", pattern)
        ready.append(keyed.join(hot, ["mask", "pattern"], "left_anti").select("fingerprint", "mask"))
        split = keyed.join(hot, ["mask", "pattern"], "left_semi").join(steps, "mask")
        nodes = stored(split.select("fingerprint", F.col("child").alias("mask")).distinct(), "nodes")  # one node can be reached by two ways
    for more in ready:
        nodes = nodes.unionByName(more)
    return nodes.withColumn("pattern", pattern)


def links(fingerprints: DataFrame, max_diff: int = 2, node_limit: int = 20_000) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the different values of `fingerprint`."""
    nodes = upper_nodes(fingerprints, max_diff, node_limit)
    placed = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("fingerprint")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def out(columns, ends):
            sizes = np.diff(np.concatenate([[0], ends]))
            several = np.repeat(sizes > 1, sizes)
            a, b = node_forest(columns[0][: ends[-1]][several].view(np.uint64), sizes[sizes > 1], max_diff) if several.any() else ([], [])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            ends = np.flatnonzero((held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
            if len(ends) and len(held[0]) >= 4096:
                yield from out(held, ends)
                held = [h[ends[-1] :] for h in held]
        if len(held[0]):
            ends = np.flatnonzero((held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
            yield from out(held, np.append(ends, len(held[0])))

    return placed.select("fingerprint", "mask", "pattern").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, max_diff: int = 2, node_limit: int = 20_000) -> DataFrame:
    """One row per input row: id, fingerprint (integer) and component_id, the least id reachable over links."""
    ids = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(with_fingerprints(ids, "text", words, seed).select("doc_id", "fingerprint"), "prints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    named = components(classes, links(classes, max_diff, node_limit))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "component").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, max_diff: int = 2, node_limit: int = 20_000, least: float | None = None) -> DataFrame:
    """One row of df for each component: that of the least id, or of a null id if it has no other; all columns stay.

    Texts link at max_diff differing fingerprint bits or fewer; with `least`, at an exact Jaccard similarity of their shingle
    sets of `least` or more: the index's components are checked pair by pair, and similar.py adds pairs that differ in more bits. The survivor is a row and not an id: an id whose texts lie in several
    components can stay for each of them.
    """
    ids = df.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("__row"), F.col(f"`{text_col}`").alias("text"))
    if least is not None:
        prints = stored(similar.with_bands(ids, words, seed).drop("text"), "prints")
        sets = prints.filter("size > 0").select(F.col("fingerprint").alias("of"), F.col("simhash").alias("fingerprint")).distinct()
        indexed = components(sets, links(sets.select("fingerprint").distinct(), max_diff, node_limit))
        nodes = stored(indexed.select(F.col("of").alias("fingerprint"), F.xxhash64(F.lit("index"), "component").alias("bucket")), "index-nodes")
        named = components(prints.select("doc_id", "__row", "fingerprint"), similar.links(ids, prints, words, least, seed, min(node_limit, similar.NODE_LIMIT), nodes))
    else:
        prints = stored(with_fingerprints(ids, "text", words, seed).select("doc_id", "__row", "fingerprint"), "prints")
        named = components(prints, links(prints.select("fingerprint").distinct(), max_diff, node_limit))
    return survivors(df, named, id_col, text_col)


__all__ = ["connected_components", "keep_one", "links", "near_duplicates", "upper_nodes", "with_fingerprints"]
