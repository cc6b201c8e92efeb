"""Filter interaction audit: what each of five filters removes, alone and in every order, by partition-refinement duplicates
and counts of failure masks.

A document's mask has a bit for each filter that it fails: A under `LEAST_WORDS` words, B less than 80 % different words, C more
than 10 % capitals, D a character of `#$%&*|`, E a text that a smaller id holds as well. Masks, with the two labels, are counted
once; every order's steps follow from at most 32 counts a part, so no order reads a document again.

E comes from partition refinement. Rows are split by the code points of their text, then by a hash of each successive block of
code points, blocks growing `GROWTH` times; after each split classes of one row go, and rows whose blocks are used up wait. The
texts of what is left are then compared in full: texts equal in their class are one, counted with partial aggregates, so a
third of the table may be one text. Only texts that a fixed-size bitmap of the surviving classes lets pass are shuffled. A class with
several different texts, by a collision of hashes, is marked text by text.

Defined cases: a null text counts as empty, which has 0 words and fails A alone, or E as well; a null id is neither smaller nor greater than
another and so never fails E; a row of the least id doesn't fail E, repeated or not; a document is good or toxic if any label of its id
says so; a null language is the part ''; other columns stay behind; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .ordered import written

LETTERS = "ABCDE"
LEAST_WORDS = 100
FIRST_BLOCK, GROWTH = 64, 16
#: Slots of the bitmap of surviving classes: 2**26 are 8 MB, whatever the table holds.
SLOTS = 1 << 26
WORD = r"[^\x20\x09-\x0D]+"


def text_bits(text: F.Column) -> F.Column:
    """The bits of A to D, lowest first."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    of_words = F.transform(F.array(words), lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)).cast("long") < 80 * F.size(w), 2).otherwise(0))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return of_words + F.when(100 * capitals > 10 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def block_bounds(longest: int) -> list[tuple[int, int]]:
    """First code point, from 1, and length of the successive blocks up to the longest text."""
    out, start, size = [], 1, FIRST_BLOCK
    while start <= longest:
        out.append((start, size))
        start, size = start + size, size * GROWTH
    return out


def class_keys(text: F.Column, bounds: list[tuple[int, int]], hash_mask: int) -> list[F.Column]:
    """A hash of each block, and null from the block on that begins behind the text."""
    return [F.when(F.length(text) >= start, F.xxhash64(F.substring(text, start, size)).bitwiseAND(hash_mask)) for start, size in bounds]


def several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)


def refined(rows: DataFrame, levels: int) -> DataFrame:
    """The classes (length, class) of rows that no split tells apart and that hold several rows. rows: length, blocks."""
    held = rows.select("length", F.col("length").cast("long").alias("class"), "blocks")
    done = None
    for level in range(levels + 1):
        held = held.join(several(held, ["length", "class"]), ["length", "class"], "left_semi")
        ended = F.lit(True) if level == levels else F.col("blocks")[level].isNull()
        full = held.filter(ended).select("length", "class").distinct()
        done = full if done is None else done.unionByName(full)
        if level == levels:
            return done
        held = checkpointed(held.filter(~ended).withColumn("class", F.xxhash64("class", F.col("blocks")[level])))
        if held.isEmpty():
            return done
    return done


def class_of(blocks: list[F.Column], length: F.Column) -> F.Column:
    """The class that refinement ends with: the length, and one block hash after the other as long as there are blocks."""
    out = length.cast("long")
    for block in blocks:
        out = F.when(block.isNull(), out).otherwise(F.xxhash64(out, block))
    return out


def passing(df: DataFrame, classes: DataFrame, slots: int) -> DataFrame:
    """The rows of df whose class, by a bitmap of all classes, can be one of them: a map-side filter of bounded size."""
    slot = F.pmod(F.xxhash64("length", "class"), F.lit(slots))
    maps = classes.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    marked = df.withColumn("slot", slot).withColumn("bucket", F.bitmap_bucket_number("slot")).withColumn("bit", F.bitmap_bit_position("slot"))
    octet = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return marked.join(F.broadcast(maps), "bucket").filter(F.getbit(octet, F.col("bit") % 8) == 1).drop("slot", "bucket", "bit", "bits")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", hash_mask: int = -1, slots: int = SLOTS) -> DataFrame:
    """(doc_id, part, mask) of each row: the filters that it fails, without the order of any. hash_mask keeps bits of the block hashes: fewer
    make more classes collide and results no different."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bounds = block_bounds(base.agg(F.max(F.length("text"))).first()[0] or 0)
    keys = class_keys(F.col("text"), bounds, hash_mask)
    keyed = base.withColumn("length", F.length("text")).withColumn("class", class_of(keys, F.length("text")))
    rows = written(keyed.select("doc_id", "part", "length", "class", text_bits(F.col("text")).alias("bits"), F.array(*keys).cast("array<long>").alias("blocks")), "audit-rows")
    classes = checkpointed(refined(rows, len(bounds)))

    texts = passing(keyed, classes, slots).groupBy("length", "class", "text").agg(F.min("doc_id").alias("least"))
    counted = checkpointed(texts.groupBy("length", "class").agg(F.min("least").alias("least"), F.count("*").alias("n_texts")))
    marked = rows.drop("blocks").join(counted, ["length", "class"], "left")
    mixed = counted.filter("n_texts > 1").select("length", "class")
    if mixed.isEmpty():
        return marked.select("doc_id", "part", mask(F.col("bits")).alias("mask"))
    alone = marked.filter("n_texts is null or n_texts = 1").select("doc_id", "part", mask(F.col("bits")).alias("mask"))
    apart = keyed.join(mixed, ["length", "class"], "left_semi")
    leaders = apart.groupBy("length", "class", "text").agg(F.min("doc_id").alias("least"))
    return alone.unionByName(apart.join(leaders, ["length", "class", "text"]).select("doc_id", "part", mask(text_bits(F.col("text"))).alias("mask")))


def mask(bits: F.Column) -> F.Column:
    """All five bits; only classes of several rows have a least id, and one that is null makes no row fail."""
    return bits + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)


def orders() -> F.Column:
    """An array of (filter_order, step, bit of the step's filter, bits of the filters ahead) for all orders."""
    steps = [("".join(p), i + 1, 1 << LETTERS.index(x), sum(1 << LETTERS.index(y) for y in p[:i])) for p in permutations(LETTERS) for i, x in enumerate(p)]
    return F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(a).alias("ahead")) for o, s, b, a in steps])


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step what the step's filter does. masks: doc_id, part, mask; labels: doc_id, quality, toxic."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    counts = masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("of"))
    steps = by_part.withColumn("s", F.explode(orders())).select("part", "of", "s.*")
    bit, ahead = F.col("bit"), F.col("ahead")

    def total(field, condition):
        return F.aggregate(F.filter("of", condition), F.lit(0).cast("long"), lambda a, m: a + m[field])

    fails, free = lambda m: m["mask"].bitwiseAND(bit) != 0, lambda m: m["mask"].bitwiseAND(ahead) == 0
    out = steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "bit",
        total("n", lambda m: m["mask"].bitwiseAND(ahead.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & free(m)).alias("removed"),
        total("n", lambda m: fails(m) & ~free(m)).alias("redundant"),
        total("n", lambda m: m["mask"] == bit).alias("unique_fails"),
        total("good", lambda m: fails(m) & free(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & free(m)).alias("toxic_lost"),
    )
    shares = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "bit"]).drop("bit")
