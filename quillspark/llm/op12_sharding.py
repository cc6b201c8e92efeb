"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows of equal texts are one atomic group: it never straddles two shards. Groups are ordered by the SHA-256 of their text, an
order that needs no text in a shuffle, spreads every source over all shards, and lets a row's shard be told from its text and the
cuts alone. A capacity is feasible if a greedy walk, which fills each shard up to the capacity, ends within the shards
given; a group beyond the capacity has a shard of its own. The smallest feasible capacity is found by binary search, and the
greedy walk at that capacity cuts.

The walk asks for the greatest group end up to a bound, and the next group end after one. Both are answered from a bounded
index of the group ends: blocks with their first and last end. Within a block an answer is known to lie between two values;
as the walk is monotone, walks on the lower and on the upper values bracket the smallest feasible capacity and all its
cuts. Blocks that the bracketed walks can touch are split and read again until both walks agree. So the driver holds `blocks`
rows a round, whatever the table holds, and the result is exact.

Defined cases: a null text counts as empty, and both are one group of size `overhead` a row; a null id comes first in its group;
repeated rows each get a slot; fewer groups than shards leave the last shards empty; an empty table gives no rows and no cuts. Other
columns stay behind in `place`; `shard` keeps them and replaces a column called shard.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered

SHARDS, OVERHEAD, BLOCKS = 40, 16, 1 << 14


@dataclass
class Cuts:
    """The result of a search: the capacity, and for each shard the end of its last group as bytes, digest and rows up to there."""

    capacity: int
    ends: list[int]
    digests: list[bytes]
    rows: list[int]


class Ends:
    """What is known of the ascending group ends: blocks (first, last, count) that don't overlap and cover all of them."""

    def __init__(self, blocks: list[tuple[int, int, int]]):
        self.blocks = sorted(blocks)
        self.first, self.last, self.n = (list(x) for x in zip(*self.blocks, strict=True))

    def up_to(self, x: int) -> tuple[int, int]:
        """Bounds of the greatest end up to x, 0 if there is none."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0
        if x >= self.last[i]:
            return self.last[i], self.last[i]
        return self.first[i], self.first[i] if self.n[i] == 2 else x

    def after(self, x: int) -> tuple[int, int]:
        """Bounds of the least end beyond x."""
        i = bisect_right(self.last, x)
        if i == len(self.last):
            return self.last[-1], self.last[-1]
        if x < self.first[i]:
            return self.first[i], self.first[i]
        return (self.last[i] if self.n[i] == 2 else x + 1), self.last[i]

    def walk(self, capacity: int, shards: int, side: int) -> list[int]:
        """The greedy cuts at a capacity, or bounds of them: of lower values with side 0, of upper ones with side 1."""
        cuts, x = [], 0
        while x < self.last[-1] and len(cuts) < shards:
            x = max(self.up_to(x + capacity)[side], self.after(x)[side])
            cuts.append(x)
        return cuts

    def least_capacity(self, shards: int, side: int) -> int:
        low, high = 0, self.last[-1]
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, side)[-1] >= self.last[-1]:
                high = middle
            else:
                low = middle + 1
        return low

    def open(self, low: int, high: int, shards: int) -> list[bool]:
        """Which blocks hold values unknown so far that a walk at a capacity from low to high can ask for."""
        lower, upper = ([0, *self.walk(c, shards, side)] for c, side in ((low, 0), (high, 1)))
        upper += [self.last[-1]] * (len(lower) - len(upper))
        asked = [w for a, b in zip(lower, upper, strict=False) for w in ((a, b), (a + low, b + high))]
        return [n > 2 and any(first <= b and a <= last for a, b in asked) for first, last, n in self.blocks]


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, digest) of each row; no text goes on from here."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))


def ends_by_block(ends: DataFrame, width: int) -> list[tuple[int, int, int]]:
    """First, last and number of ends in each block of so many bytes."""
    found = ends.groupBy(F.floor(F.col("through") / F.lit(width)).alias("block")).agg(F.min("through").alias("first"), F.max("through").alias("last"), F.count("*").alias("n"))
    return [(r["first"], r["last"], r["n"]) for r in found.collect()]


def least_cuts(ends: DataFrame, shards: int, blocks: int = BLOCKS) -> tuple[int, list[int]]:
    """The smallest feasible capacity over all group ends (column through), and the greedy cuts there.

    Widths are powers of two, so a block is split along its own borders; blocks that are open lie within those of the round
    before, and their width is halved once at least.
    """
    total = ends.agg(F.max("through")).first()[0]
    if total is None:
        return 0, []
    width = 1 << max(0, total // blocks).bit_length()
    known = Ends(ends_by_block(ends, width))
    while True:
        low, high = known.least_capacity(shards, 1), known.least_capacity(shards, 0)
        if low == high and known.walk(low, shards, 0) == known.walk(low, shards, 1):
            return low, known.walk(low, shards, 0)
        opened = known.open(low, high, shards)
        spans: list[list[int]] = []  # neighbours among the opened blocks, joined
        for i, block in enumerate(known.blocks):
            if opened[i]:
                if i and opened[i - 1]:
                    spans[-1][1] = block[1]
                else:
                    spans.append([block[0], block[1]])
        width //= 2
        while width > 1 and 2 * sum(b - a + 1 for a, b in spans) // width <= blocks:
            width //= 2
        inside = ends.filter(" or ".join(f"through between {a} and {b}" for a, b in spans))
        known = Ends([b for b, o in zip(known.blocks, opened, strict=True) if not o] + ends_by_block(inside, width))


def plan(placed: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> Cuts:
    """The cuts for rows as `ordered` places them."""
    ends = placed.filter("closing").select("through", "row", "digest")
    capacity, cuts = least_cuts(ends.select("through"), shards, blocks)
    at = sorted((r["through"], bytes(r["digest"]), r["row"] + 1) for r in ends.filter(F.col("through").isin(cuts)).collect()) if cuts else []
    return Cuts(capacity, [a[0] for a in at], [a[1] for a in at], [a[2] for a in at])


def in_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """The rows of `sizes` in the order of groups; copies of one row are told apart by their place in the input, so that they
    don't have to lie in one partition."""
    rows = sizes(df, id_col, text_col, overhead).withColumn("copy", F.monotonically_increasing_id())
    return ordered(rows, ["digest", F.col("doc_id").asc_nulls_first(), "copy"], "digest", "size", "shards")


def place(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, blocks: int = BLOCKS) -> DataFrame:
    """A row for each row of df: doc_id, size, text_crc32, shard (from 0) and slot (gapless in its shard, from 0)."""
    placed = in_order(df, id_col, text_col, overhead)
    cuts = plan(placed, shards, blocks)
    shard = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts.ends]), lambda c: c < F.col("through")))
    start = F.element_at(F.array(*[F.lit(r).cast("long") for r in [0, *cuts.rows]]), F.col("shard") + 1)
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", (F.col("row") - start).alias("slot"))


def shard(df: DataFrame, cuts: Cuts, text_col: str = "text") -> DataFrame:
    """df with its `shard`, told from each text and the cuts: no shuffle, no join."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    found = F.size(F.filter(F.array(*[F.lit(d) for d in cuts.digests]), lambda d: d < digest)) if cuts.digests else F.lit(0)
    return df.withColumn("shard", found)


def write(df: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> Cuts:
    """Writes df as Parquet folders shard=0, shard=1 and so on, a shard's groups in order, and returns the cuts. A shard is
    dealt to several files by ranges of the digest, so a hot group is no single task's."""
    cuts = plan(in_order(df, id_col, text_col, overhead), shards)
    digest = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    dealt = shard(df, cuts, text_col).repartitionByRange("shard", digest, F.col(f"`{id_col}`").asc_nulls_first(), F.monotonically_increasing_id())
    dealt.sortWithinPartitions("shard", digest, F.col(f"`{id_col}`").asc_nulls_first()).write.partitionBy("shard").parquet(path)
    return cuts
