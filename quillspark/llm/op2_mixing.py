"""Mixing sources to target weights, in DataFrame expressions only.

Temperature mixing: source s, with the share p of all tokens, gets the weight q ~ p ** alpha. alpha in [0, 1] is
found by bisection: the entropy of q falls and the repetition of small sources shrinks as alpha grows, so alpha is
the larger of the one that meets the target entropy (a share of the greatest possible, the log of the number of
sources) and the one that meets the repetition limit, how often the most repeated source may be used; 1 where the corpus
is even enough as it is. Every step of the bisection is an aggregate over the sources that returns a few sums.

The weights are then realised as budgeted block permutations. A source's budget is budget * q tokens; by default
`budget` is the least with which every document is used at least once. Each epoch of a source is an own
permutation of its documents (by hash); a document whose epoch offset + tokens ahead of it lies within the budget
is used, in block floor(place / source budget * blocks), so each block of about block_tokens tokens has every source
at its weight. `slot` orders a block.

The tokens ahead of a document are a prefix sum in two levels: documents of a (source, epoch) fall by hash into
buckets of bounded size, totals of buckets are summed up over buckets, and documents within a bucket. No task
holds a source; with n documents in a source, buckets hold and number about sqrt(n) or less.

Tokens are words between white space. Defined cases: null texts and empty texts have no tokens and are placed by
their hash, once an epoch; a null source is a source of its own; a source without tokens keeps its documents,
once each; repeated rows count as rows; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import checkpointed

TARGET_ENTROPY = 0.95
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1_000_000
BUCKET_DOCS = 2000
HALVINGS = 40
AT_ONCE = 4  # halvings per pass: the sums for all 2 ** AT_ONCE - 1 inner points of the interval
SMALL = 20_000  # sources up to which their table is broadcast
NO_SOURCE = "\u0000"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def uniform(h: Column) -> Column:
    """A number in [0, 1) from a 64-bit hash."""
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def token_counts(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, source, key, n_tokens, h): what mixing needs of a document."""
    source = F.col(f"`{source_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"), F.coalesce(source, F.lit(NO_SOURCE)).alias("key"), n_tokens(F.col(f"`{text_col}`")).alias("n_tokens"))
    return rows.withColumn("h", F.xxhash64(F.lit(seed), "key", "doc_id"))


def entropies(sources: DataFrame, alphas: list[float]) -> list[float]:
    """Entropy of p ** alpha, normalised, for each alpha: one pass, two sums an alpha."""
    p = F.col("share")
    sums = [x for a in alphas for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
    row = sources.filter("share > 0").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    return [math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i] for i, a in enumerate(alphas)]


def bisect(sources: DataFrame, target: float) -> float:
    """The alpha in [0, 1] at which the entropy, which falls with alpha, is `target`; several halvings a pass."""
    lo, hi = 0.0, 1.0
    if entropies(sources, [1.0])[0] >= target:
        return 1.0
    for _ in range(HALVINGS // AT_ONCE):
        n = 2**AT_ONCE
        inner = [lo + (hi - lo) * k / n for k in range(1, n)]
        found = entropies(sources, inner)
        below = sum(h >= target for h in found)
        lo, hi = lo + (hi - lo) * below / n, lo + (hi - lo) * (below + 1) / n
    return hi


def least_alpha(spread: float, max_repeats: float) -> float:
    """The least alpha with (largest share / smallest share) ** (1 - alpha) <= max_repeats, by bisection. spread: log of
    that ratio. With the default budget, which uses the least repeated source once, it bounds the uses of every source."""
    lo, hi = 0.0, 1.0
    if spread <= math.log(max_repeats):
        return 0.0
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spread * (1 - mid) > math.log(max_repeats) else (lo, mid)
    return hi


def repeats(sources: DataFrame, alphas: list[float], scale: float) -> list[float]:
    """How often the most repeated source, the smallest, is used for each alpha: scale times its weight over its share, with
    scale the budget over all tokens. One pass, two sums an alpha."""
    p = F.col("share")
    row = sources.filter("share > 0").agg(F.min(p).alias("least"), *[F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(alphas)]).first()
    return [scale * row["least"] ** (a - 1) / row[f"z{i}"] for i, a in enumerate(alphas)]


def budget_alpha(sources: DataFrame, scale: float, max_repeats: float) -> float:
    """The least alpha at which no source is used more than max_repeats times under a given budget, by bisection; 1, the even
    use of all sources, where the budget alone asks for more."""
    lo, hi = 0.0, 1.0
    first, last = repeats(sources, [0.0, 1.0], scale)
    if first <= max_repeats or last > max_repeats:
        return 0.0 if first <= max_repeats else 1.0
    for _ in range(HALVINGS // AT_ONCE):
        n = 2**AT_ONCE
        over = sum(r > max_repeats for r in repeats(sources, [lo + (hi - lo) * k / n for k in range(1, n)], scale))
        lo, hi = lo + (hi - lo) * over / n, lo + (hi - lo) * (over + 1) / n
    return hi


def source_weights(counts: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> tuple[DataFrame, float, int]:
    """(key, tokens, docs, share, weight, target) of each source, the budget in tokens, and the number of sources."""
    sources = checkpointed(counts.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    seen = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count_if(F.col("tokens") > 0).alias("full"), F.max("tokens").alias("hi"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("lo")).first()
    sources = sources.coalesce(1 + seen["n"] // 200_000)
    if not seen["t"]:
        return sources.select("key", "tokens", "docs", F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("target")), 0.0, seen["n"]
    sources = sources.withColumn("share", F.col("tokens") / F.lit(float(seen["t"])))
    limit = least_alpha(math.log(seen["hi"] / seen["lo"]), max_repeats) if budget is None else budget_alpha(sources, budget / seen["t"], max_repeats)
    alpha = max(bisect(sources, target_entropy * math.log(seen["full"])), limit)
    raw = F.when(F.col("tokens") > 0, F.pow("share", F.lit(alpha))).otherwise(F.lit(0.0))
    sums = sources.agg(F.sum(raw).alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / raw)).alias("most")).first()
    tokens = float(budget) if budget is not None else sums["most"] * sums["z"]
    weighted = sources.withColumn("weight", raw / F.lit(sums["z"])).withColumn("target", F.col("weight") * F.lit(tokens))
    return weighted, tokens, seen["n"]


def mix(df: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each use of a document: doc_id, source, weight, epoch, block, slot, place (tokens of its source ahead of
    it), n_tokens."""
    counts = checkpointed(token_counts(df, id_col, source_col, text_col, seed))
    sources, tokens, n = source_weights(counts, target_entropy, max_repeats, budget)
    blocks = max(1, math.ceil(tokens / block_tokens))
    # what the source's documents are used: repeats epochs, the last one in part; at least one, so none is lost by default
    repeats = F.greatest(F.lit(1), F.ceil(F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens") - 1e-9).otherwise(F.lit(1.0)))).cast("int")
    buckets = F.ceil(F.col("docs") / F.greatest(F.lit(float(BUCKET_DOCS)), F.sqrt("docs"))).cast("long")
    plan = sources.select("key", "tokens", "weight", "target", repeats.alias("repeats"), buckets.alias("buckets"))
    uses = counts.join(F.broadcast(plan) if n <= SMALL else plan, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    uses = uses.withColumn("order", F.xxhash64("h", "epoch")).withColumn("bucket", F.floor(uniform(F.col("order")) * F.col("buckets")))
    totals = uses.groupBy("key", "epoch", "bucket").agg(F.sum("n_tokens").alias("t"))
    ahead = totals.select("key", "epoch", "bucket", (F.sum("t").over(W.partitionBy("key", "epoch").orderBy("bucket")) - F.col("t")).alias("before"))
    within = W.partitionBy("key", "epoch", "bucket").orderBy("order", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = uses.join(ahead, ["key", "epoch", "bucket"]).withColumn("place", F.col("epoch") * F.col("tokens") + F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    if budget is None:
        used = (F.col("epoch") == 0) | (F.col("place") < F.col("target"))
    else:
        used = (F.col("tokens") == 0) | (F.col("place") < F.col("target"))
    share = F.when(F.col("target") > 0, F.col("place") / F.col("target")).otherwise(uniform(F.col("order")))
    block = F.least(F.lit(blocks - 1), F.floor(share * blocks)).cast("long")
    return placed.filter(used).select("doc_id", "source", "weight", F.col("epoch").cast(T.LongType()).alias("epoch"), block.alias("block"), F.xxhash64("order", block).alias("slot"), F.col("place").cast("long").alias("place"), "n_tokens")
