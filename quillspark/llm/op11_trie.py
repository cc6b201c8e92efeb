"""Conversation prefix trie by family-first merging.

A family is the conversations of one base id: `conv_id - conv_id % family`. Each is rebuilt as the first h turns of the base
conversation and then its own turns after its first h; h = crc32(decimal id) % `heads`. Turns are cogrouped by base id with the
base's head, each family's small trie is built in its task, and only a family's combined nodes are shuffled to be merged over all
families.

A turn travels as 128 bits of digest and a length, never as text. A prefix is known by the sum, in two lanes modulo 2**64, of a hash
of each (place, turn): such sums can be continued, so a conversation of any length is cut into blocks of `block` turns, a
family's task holds one block of each of its conversations, and what lies ahead of a block is one row.

Sums over subtrees need no rounds over the trie. A node belongs to its smallest member, and what a conversation owns is the
lower end of its path. So a node's saved tokens are its owner's from its depth on, and all that its other members own; leaves
likewise. Only those other members' shared prefixes, combined by family, are joined to what they own.

Defined cases: a null role or text is empty; turns come in the order of turn, null first, those of one turn by the MD5 of length of role,
role and text, so repeated rows stay; rows without a conversation id belong to none and are passed over; other columns stay
behind; an empty table has no nodes, not even a root. The digest of a node's ends needs their ids in order: they stream through one
task a node, in packs, and aren't held.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .ordered import ordered, written

FAMILY, HEADS, BLOCK = 5, 9, 256
PACK = 4096
#: Odd constants that set the hashes of the two lanes apart.
LANE_A, LANE_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def head_length(conv_id: int, heads: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % heads


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def summands(turns: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Two lanes for each (turn, place), from the turn's two."""
    at = places.astype(np.uint64)
    a = mixed(turns[:, 0] + mixed(turns[:, 1] ^ (at * LANE_A)))
    return np.stack([a, mixed(turns[:, 1] ^ mixed(turns[:, 0] + at * LANE_B))], axis=1)


def turns_of(conversations: DataFrame, family: int) -> DataFrame:
    """(base, conv_id, j, last, digest, bytes): each turn with its place in its conversation, from 1, and whether it is the last."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    rows = conversations.filter("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % family).cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = ordered(rows, ["base", "conv_id", F.col("turn").asc_nulls_first(), "digest"], "conv_id", "bytes", "trie")
    return placed.select("base", "conv_id", (F.col("rank") + 1).alias("j"), F.col("closing").alias("last"), "digest", "bytes")


def lanes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint64).reshape(-1, 2)


def own_parts(own: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each conversation, in order."""
    own = own.sort_by([("conv_id", "ascending"), ("j", "ascending")])
    ids = own.column("conv_id").to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield int(ids[a]), own.slice(a, b - a)


def with_blocks(turns: DataFrame, heads: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The turns with their block, and the base's head for each (base, block) that has turns."""
    blocked = turns.withColumn("block", F.floor((F.col("j") - 1) / block))
    head = turns.filter(f"conv_id = base and j < {heads}").select("base", F.col("j").alias("head_j"), F.col("digest").alias("head_digest"), F.col("bytes").alias("head_bytes"))
    at = blocked.select(F.col("base").alias("base"), F.col("block").alias("block")).distinct()  # columns of its own, to be cogrouped with the turns
    return blocked, at.join(head, "base")


def sums_ahead(blocked: DataFrame, heads_at: DataFrame, heads: int) -> DataFrame:
    """(base, block, conv_id, a, b): for blocks after a conversation's first, the sums over its rebuilt turns before the block."""
    deep = blocked.filter("block > 0").select("base").distinct()
    kind = "base long, block long, conv_id long, a long, b long"

    def total(own: pa.Table, head: pa.Table) -> pa.Table:
        m, out = head.num_rows, []
        at_head = head_sums(head)
        for c, rows in own_parts(own):
            h = head_length(c, heads)
            j, block = rows.column("j").to_numpy(), rows.column("block")[0].as_py()
            s = summands(lanes(rows), j + min(h, m) - h)[j > h].sum(axis=0, dtype=np.uint64)
            s = s + at_head[min(h, m)] if block == 0 else s
            out.append({"base": rows.column("base")[0].as_py(), "block": block, "conv_id": c, "a": int(s[0].view(np.int64)), "b": int(s[1].view(np.int64))})
        return pa.Table.from_pylist(out, schema=pa.schema([(x.split()[0], pa.int64()) for x in kind.split(", ")]))

    few = blocked.join(deep, "base", "left_semi").groupBy("base", "block").cogroup(heads_at.join(deep, "base", "left_semi").groupBy("base", "block"))
    wide = few.applyInArrow(total, kind).withColumns({n: F.col(n).cast("decimal(38,0)") for n in ("a", "b")})
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return wide.select("base", "block", "conv_id", *[wrapped(F.sum(n).over(before)).alias(n) for n in ("a", "b")]).filter("block > 0")


def wrapped(total: F.Column) -> F.Column:
    """A sum modulo 2**64 as a signed 64-bit integer."""
    rest = F.pmod(total, F.lit(Decimal(1 << 64)))
    return F.when(rest >= Decimal(1 << 63), rest - Decimal(1 << 64)).otherwise(rest).cast("long")


def head_sums(head: pa.Table) -> np.ndarray:
    """The sums over the first 0, 1, 2, ... turns of the head, which is sorted in place of its turns."""
    order = np.argsort(head.column("head_j").to_numpy())
    digests = head.column("head_digest").to_pylist()
    turns = np.frombuffer(b"".join(digests[i] for i in order), np.uint64).reshape(-1, 2)
    sums = np.cumsum(summands(turns, np.arange(1, len(order) + 1)), axis=0, dtype=np.uint64)
    return np.concatenate([np.zeros((1, 2), np.uint64), sums])


NODES = "a long, b long, parent_a long, parent_b long, depth long, bytes long, members array<long>, ends array<long>"


def family_nodes(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """The combined nodes of each family: key (a, b), the parent's key, depth, bytes of the last text, members and those that end here."""
    if block < heads:
        raise ValueError("a block must hold a head")
    blocked, heads_at = with_blocks(turns_of(conversations, family), heads, block)
    carried = sums_ahead(blocked, heads_at, heads)
    none = F.lit(None)
    right = heads_at.select("base", "block", "head_j", "head_digest", "head_bytes", none.cast("long").alias("carried_id"), none.cast("long").alias("carried_a"), none.cast("long").alias("carried_b"))
    right = right.unionByName(carried.select("base", "block", none.cast("long").alias("head_j"), none.cast("binary").alias("head_digest"), none.cast("long").alias("head_bytes"), F.col("conv_id").alias("carried_id"), F.col("a").alias("carried_a"), F.col("b").alias("carried_b")))
    types = [pa.field(n, pa.list_(pa.int64()) if k.startswith("array") else pa.int64()) for n, k in (x.split() for x in NODES.split(", "))]

    def build(own: pa.Table, both: pa.Table) -> pa.Table:
        is_head = both.column("head_j").is_valid()
        head, carry = both.filter(is_head), both.filter(both.column("carried_id").is_valid())
        ahead = dict(zip(carry.column("carried_id").to_pylist(), np.stack([carry.column(n).to_numpy() for n in ("carried_a", "carried_b")], axis=1), strict=True))
        at_head, m = head_sums(head), head.num_rows
        head_bytes = [b for _, b in sorted(zip(head.column("head_j").to_pylist(), head.column("head_bytes").to_pylist(), strict=True))]
        found: dict[tuple, list] = {}

        def add(c: int, key: np.ndarray, parent: np.ndarray | None, depth: int, n_bytes: int, ends: bool) -> None:
            a, b = key.tolist()
            node = found.setdefault((depth, a, b), [*(parent.tolist() if parent is not None else (None, None)), n_bytes, [], []])
            node[3].append(c)
            if ends:
                node[4].append(c)

        for c, rows in own_parts(own):
            h, first = head_length(c, heads), rows.column("block")[0].as_py() == 0
            shared = min(h, m)
            j, last = rows.column("j").to_numpy(), rows.column("last").to_numpy()
            after = j > h
            ended = bool(last.any() and not after[-1])  # all turns of its own lie within the first h
            if first:
                sums = at_head.view(np.int64)
                for d in range(shared + 1):
                    add(c, sums[d], sums[d - 1] if d else None, d, head_bytes[d - 1] if d else 0, ended and d == shared)
            start = at_head[shared] if first else ahead[c].view(np.uint64)
            depth = (j + shared - h)[after]
            sums = np.concatenate([start[None], start + np.cumsum(summands(lanes(rows), j + shared - h)[after], axis=0, dtype=np.uint64)]).view(np.int64)
            for i, (d, n, e) in enumerate(zip(depth.tolist(), rows.column("bytes").to_numpy()[after].tolist(), last[after].tolist(), strict=True)):
                add(c, sums[i + 1], sums[i], d, n, e)
        rows = [(a, b, pa_, pb, depth, n, members, ends) for (depth, a, b), (pa_, pb, n, members, ends) in found.items()]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), types, strict=True)], schema=pa.schema(types))

    nodes = blocked.groupBy("base", "block").cogroup(right.groupBy("base", "block")).applyInArrow(build, NODES)
    return written(nodes, "trie-families")


KEY = ["depth", "a", "b"]


def ends_digests(families: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end. Ids are sorted over ranges of (node, id), packed, and a node's packs
    stream through a hash."""
    ids = families.select(*KEY, F.explode("ends").alias("conv_id"))
    dealt = ids.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(n, pa.int64()) for n in (*KEY, "first")], ("pack", pa.string())])
        key, held = None, []
        for batch in batches:
            out = []
            for *at, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != key or len(held) >= PACK:
                    if held:
                        out.append((*key, held[0], ",".join(map(str, held))))
                    key, held = at, []
                held.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, held[0], ",".join(map(str, held))), schema, strict=True)], schema=schema)

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(n, pa.int64()) for n in KEY], ("ends_sha256", pa.string())])
        key, hashed = None, None
        for batch in batches:
            out = []
            for *at, _, pack in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != key:
                    if key is not None:
                        out.append((*key, hashed.hexdigest()))
                    key, hashed = at, hashlib.sha256(pack.encode())
                else:
                    hashed.update(b"," + pack.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, hashed.hexdigest()), schema, strict=True)], schema=schema)

    packs = dealt.mapInArrow(packed, "depth long, a long, b long, first long, pack string")
    return packs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digested, "depth long, a long, b long, ends_sha256 string")


def owned(nodes: DataFrame, block: int) -> DataFrame:
    """The nodes with `tail`: what their owner saves at their depth and below. A long path is summed by blocks of depths."""
    nodes = nodes.withColumn("slab", F.floor(F.col("depth") / block)).withColumn("saves", (F.col("n_convs") - 1) * F.col("bytes"))
    slabs = nodes.groupBy("conv_id", "slab").agg(F.sum("saves").alias("slab_saves"))
    below = W.partitionBy("conv_id").orderBy(F.col("slab").desc()).rowsBetween(W.unboundedPreceding, -1)
    slabs = slabs.select("conv_id", "slab", F.coalesce(F.sum("slab_saves").over(below), F.lit(0)).alias("below"))
    here = W.partitionBy("conv_id", "slab").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    return nodes.withColumn("tail", F.sum("saves").over(here)).join(slabs, ["conv_id", "slab"]).withColumn("tail", F.col("tail") + F.col("below")).drop("slab", "below", "saves")


def build(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations, a row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. conv_id and depth name a node."""
    families = family_nodes(conversations, family, heads, block)
    merged = families.groupBy(*KEY).agg(
        F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("parent_a").alias("parent_a"), F.first("parent_b").alias("parent_b")
    )
    nodes = written(merged, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = written(owned(known, block), "trie-owned")

    # what each conversation owns as a whole: from which depth on, and its sums
    paths = known.groupBy("conv_id").agg(F.min("depth").alias("from_depth"), F.max("tail").alias("path_saves"), F.max((F.col("n_children") == 0).cast("long")).alias("path_leaf"))
    others = families.select(*KEY, F.explode("members").alias("conv_id")).join(paths, "conv_id").filter("depth < from_depth")
    lent = others.groupBy(*KEY).agg(F.sum("path_saves").alias("lent_saves"), F.sum("path_leaf").alias("lent_leaves"))

    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    own = known.join(paths.select("conv_id", "path_leaf"), "conv_id")
    own = own.join(lent, KEY, "left").join(ends_digests(families), KEY, "left").join(parents, ["depth", "parent_a", "parent_b"], "left")
    return own.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("path_leaf") + F.coalesce("lent_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("tail") + F.coalesce("lent_saves", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
