"""Hybrid retrieval as one lazy plan: vector, full-text and title streams, rank fusion, title boost, threshold, content
de-duplication, rerank.

Candidates: chunk_id, source_id, title, filename, content, embedding, and the scope columns of `scope`. Each stream
is a filter, an expression and a top-k (no shuffle of candidates: each task keeps its best k), and reads only its own
columns of the scan; what leaves the streams is at most 3 * limit rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions import vectors as V
from . import scope as S

RRF_K = 60
MULTIPLIER, FINAL_K, MOST_K = 3, 8, 50
NAMED_BONUS, NAMED_COVER = 0.25, 0.99
CARRIED = ("chunk_id", "source_id", "title", "filename", "content")

Rerank = Callable[[str, DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Settings:
    final_k: int = FINAL_K
    multiplier: int = MULTIPLIER
    rrf_k: int = RRF_K
    min_score: float = 0.0
    all_terms: bool = True
    fuse_width: int | None = None
    rerank: str = "none"
    rerankers: dict[str, Rerank] = field(default_factory=dict)


def limits(top_k: int | None = None, settings: Settings = Settings()) -> tuple[int, int]:
    """(final k, stream limit)."""
    k = max(1, min(top_k if top_k is not None else max(1, settings.final_k), MOST_K))
    return k, k * max(1, settings.multiplier)


def query_tokens(query: str) -> list[str]:
    """What `text.tokens` makes of a query, on the driver: a query is a constant of the plan."""
    folded = query.translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO, X.FOLD_DELETE)).lower()
    return [t for t in folded.split() if len(t) > 1]


def query_terms(query: str) -> list[str]:
    folded = query.translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO, X.FOLD_DELETE)).lower()
    spaced = "".join(c if c.isalnum() or c == "_" else " " for c in folded)
    return list(dict.fromkeys(spaced.split()))


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _ranked(df: DataFrame, metric: str, limit: int, rank: str) -> DataFrame:
    """The best `limit` rows by metric, then id, with 0-based ranks; the window runs over those rows alone."""
    best = df.orderBy(F.desc(metric), "chunk_id").limit(limit)
    return best.withColumn(rank, F.row_number().over(W.orderBy(F.desc(metric), "chunk_id")) - 1)


def _carried(df: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in df.columns]


def vector_stream(candidates: DataFrame, qvec: Sequence[float], limit: int) -> DataFrame:
    """Exact nearest neighbours by cosine; chunks without an embedding can't come up."""
    size = sum(float(x) ** 2 for x in qvec) ** 0.5
    near = V.cosine(F.col("embedding"), V.vector(qvec), F.lit(size))
    scored = candidates.filter(F.col("embedding").isNotNull()).select(*_carried(candidates), near.alias("similarity"))
    return _ranked(scored, "similarity", limit, "vector_rank")


def fulltext_stream(candidates: DataFrame, query: str, limit: int, all_terms: bool = True) -> DataFrame:
    """Chunks with all query terms, by their frequency; or, with all_terms=False, chunks in which any query token occurs
    as a substring (case as stored), by the number of tokens. A `terms` column, if stored, saves the tokenising."""
    if all_terms:
        wanted = query_terms(query)
        if not wanted:
            return candidates.limit(0).select(*_carried(candidates), F.lit(0).alias("frequency"), F.lit(0).alias("fts_rank"))
        maybe = candidates
        if "terms" in candidates.columns:
            found = F.col("terms")
            for t in wanted:
                maybe = maybe.filter(F.array_contains(found, t))
        else:
            found = X.terms(F.col("content"))
            # a cheap substring test of each term first: most rows are never tokenised
            low = F.lower(X.normalize(X.empty(F.col("content"))))
            for t in wanted:
                maybe = maybe.filter(F.contains(low, F.lit(t)))
        hits = F.filter(found, lambda t: F.array_contains(strings(wanted), t))
        scored = maybe.select(*_carried(candidates), hits.alias("__h")).filter(F.size(F.array_distinct("__h")) == len(wanted))
        scored = scored.withColumn("frequency", F.size("__h")).drop("__h")
    else:
        wanted = list(dict.fromkeys(query_tokens(query)))
        if not wanted:
            return candidates.limit(0).select(*_carried(candidates), F.lit(0).alias("frequency"), F.lit(0).alias("fts_rank"))
        count = sum((F.contains(X.empty(F.col("content")), F.lit(t)).cast("int") for t in wanted[1:]), F.contains(X.empty(F.col("content")), F.lit(wanted[0])).cast("int"))
        scored = candidates.select(*_carried(candidates), count.alias("frequency")).filter("frequency > 0")
    return _ranked(scored, "frequency", limit, "fts_rank")


def title_stream(candidates: DataFrame, query: str, limit: int) -> DataFrame:
    """Chunks whose document title or file name has query tokens (longer than 2, the first 6), by how many."""
    wanted = [t for t in query_tokens(query) if len(t) > 2][:6]
    if not wanted:
        return candidates.limit(0).select(*_carried(candidates), F.lit(0).alias("cover"), F.lit(0).alias("title_rank"))
    like = F.lit(False)
    for t in wanted:
        like = like | F.contains(F.lower(X.empty(F.col("title"))), F.lit(t)) | F.contains(F.lower(X.empty(F.col("filename"))), F.lit(t))
    named = X.tokens(F.concat_ws(" ", X.empty(F.col("title")), X.empty(F.col("filename"))))
    cover = F.size(F.filter(strings(wanted), lambda t: F.array_contains(named, t)))
    scored = candidates.filter(like).select(*_carried(candidates), cover.alias("cover")).filter("cover > 0")
    return _ranked(scored, "cover", limit, "title_rank")


def fuse(streams: Sequence[tuple[DataFrame, str]], top_k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (stream, rank column), summed in the streams' order; ties go to the earlier stream's
    better rank. Adds score and position."""
    ranks = [r for _, r in streams]
    parts = [s.select(*_carried(s), *[F.col(r).cast("int").alias(r) if r == own else F.lit(None).cast("int").alias(r) for r in ranks]) for s, own in streams]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    keep = [c for c in _carried(streams[0][0]) if c != "chunk_id"]
    rows = union.groupBy("chunk_id").agg(*[F.first(c).alias(c) for c in keep], *[F.min(r).alias(r) for r in ranks])
    score = F.lit(0.0)
    for r in ranks:
        score = score + F.when(F.col(r).isNotNull(), F.lit(1.0) / (F.lit(rrf_k + 1) + F.col(r))).otherwise(F.lit(0.0))
    first = F.coalesce(*[F.when(F.col(r).isNotNull(), F.lit(k * 1_000_000) + F.col(r)) for k, r in enumerate(ranks)])
    scored = rows.withColumn("score", score).withColumn("seen", first).orderBy(F.desc("score"), "seen").limit(top_k)
    return with_position(scored, F.desc("score"), F.col("seen")).drop("seen")


def with_position(hits: DataFrame, *order: Column) -> DataFrame:
    """Hits (a few dozen rows) numbered from 0 in this order."""
    return hits.withColumn("position", F.row_number().over(W.orderBy(*order)) - 1)


def title_boost(hits: DataFrame, query: str) -> DataFrame:
    """score * (1 + cover), and 0.25 more where title and file name cover the query; stable re-sort."""
    wanted = sorted(set(query_tokens(query)))
    if not wanted:
        return hits
    named = F.array_distinct(X.tokens(F.concat_ws(" ", X.empty(F.col("title")), X.empty(F.col("filename")))))
    cover = F.size(F.array_intersect(named, strings(wanted))) / F.lit(float(len(wanted)))
    boosted = hits.withColumn("__c", cover).withColumn("score", F.col("score") * (1 + F.col("__c")) + F.when(F.col("__c") >= NAMED_COVER, F.lit(NAMED_BONUS)).otherwise(F.lit(0.0)))
    return with_position(boosted.drop("__c").withColumnRenamed("position", "__p"), F.desc("score"), F.col("__p")).drop("__p")


def threshold(hits: DataFrame, min_score: float) -> DataFrame:
    return hits.filter(F.col("score") >= min_score) if min_score > 0 else hits


def dedupe_content(hits: DataFrame) -> DataFrame:
    """Of equal normalised contents the best-placed one; blank ones all stay, each a group of its own, so that many of them aren't one
    window. Hits of one content and place all stay but one."""
    blank = X.strip(X.empty(F.col("content"))) == ""
    own = W.partitionBy("__d").orderBy("position")
    digest = F.when(blank, F.concat(F.lit("blank "), F.col("position").cast("string"))).otherwise(X.content_hash(F.col("content")))
    marked = hits.withColumn("__b", blank).withColumn("__d", digest).withColumn("__n", F.row_number().over(own))
    return marked.filter((F.col("__n") == 1) | F.col("__b")).drop("__b", "__d", "__n")


def heuristic_rerank(query: str, hits: DataFrame, top_k: int) -> DataFrame:
    """Overlap, early overlap (30 tokens), the phrase, the file name's cover and a hundredth of the score."""
    q = query_tokens(query)
    if not q:
        return hits.filter(F.col("position") < top_k).withColumn("rerank_score", F.lit(None).cast("double"))
    wanted, n = sorted(set(q)), float(len(set(q)))
    toks = X.tokens(F.col("content"))
    share = lambda t: F.size(F.array_intersect(F.array_distinct(t), strings(wanted))) / F.lit(n)
    phrase = F.contains(F.array_join(toks, " "), F.lit(" ".join(q))).cast("double")
    total = share(toks) + 0.5 * share(F.slice(toks, 1, 30)) + 0.5 * phrase + share(X.tokens(F.col("filename"))) + 0.01 * F.col("score")
    scored = hits.withColumn("rerank_score", F.when(F.size(toks) > 0, total).otherwise(F.lit(0.0))).withColumnRenamed("position", "__p")
    return with_position(scored, F.desc("rerank_score"), F.col("__p")).drop("__p").filter(F.col("position") < top_k)


def rerank(query: str, hits: DataFrame, top_k: int, settings: Settings) -> DataFrame:
    """By method: none, heuristic, or a registered callable (its omissions are appended); unknown names disable it, and a callable
    that raises while it plans leaves the order as it is."""
    if settings.rerank == "heuristic":
        return heuristic_rerank(query, hits, top_k)
    custom = settings.rerankers.get(settings.rerank)
    try:
        chosen = custom(query, hits, top_k).select("chunk_id", "rerank_score") if custom else None
    except Exception:  # a reranker is a stranger's service: search goes on without it
        chosen = None
    if chosen is None:
        return hits.filter(F.col("position") < top_k).withColumn("rerank_score", F.lit(None).cast("double"))
    both = hits.withColumnRenamed("position", "__p").join(chosen, "chunk_id", "left")
    return with_position(both, F.desc_nulls_last("rerank_score"), F.col("__p")).drop("__p").filter(F.col("position") < top_k)


Trace = dict[str, Observation]


def watched(df: DataFrame, trace: Trace | None, name: str, *more: Column) -> DataFrame:
    """df, whose rows are counted under a name while the plan that holds it runs: no job of its own."""
    if trace is None:
        return df
    trace[name] = Observation()
    return df.observe(trace[name], F.count(F.lit(1)).alias("rows"), *more)


def traced(trace: Trace) -> dict[str, dict]:
    """What was counted, once the plan has run: rows by name, and each stream's best score."""
    return {name: dict(o.get) for name, o in trace.items()}


def search_in(rows: DataFrame, query: str, qvec: Sequence[float] | None, top_k: int | None = None, settings: Settings = Settings(), trace: Trace | None = None) -> DataFrame:
    """Hybrid search over candidates that are already in scope. trace, an empty dictionary, gets a counter of each stream, of the fused hits
    and of those that stay; `traced` reads them after the search has run."""
    k, limit = limits(top_k, settings)
    streams = [(fulltext_stream(rows, query, limit, settings.all_terms), "fts_rank", "frequency"), (title_stream(rows, query, limit), "title_rank", "cover")]
    if qvec is not None:
        streams.insert(0, (vector_stream(rows, qvec, limit), "vector_rank", "similarity"))
    found = [(watched(s, trace, rank.removesuffix("_rank"), F.max(F.col(metric).cast("double")).alias("best")), rank) for s, rank, metric in streams]
    hits = fuse(found, settings.fuse_width or k, settings.rrf_k)
    if qvec is None:
        hits = hits.withColumn("vector_rank", F.lit(None).cast("int"))
    hits = watched(hits, trace, "fused")
    hits = watched(dedupe_content(threshold(title_boost(hits, query), settings.min_score)), trace, "kept")
    return rerank(query, with_position(hits.withColumnRenamed("position", "__p"), F.col("__p")).drop("__p"), k, settings)


def hybrid_search(chunks: DataFrame, workspace: str | None, query: str, qvec: Sequence[float] | None = None, kb: str | None = None, types: Sequence[str] | None = None, top_k: int | None = None, ready_only: bool = True, settings: Settings = Settings()) -> DataFrame:
    """Search within a workspace."""
    return search_in(S.candidates(chunks, workspace, kb, types, ready_only), query, qvec, top_k, settings)


def hybrid_search_global(chunks: DataFrame, kb_ids: Sequence[str], query: str, qvec: Sequence[float] | None = None, types: Sequence[str] | None = None, top_k: int | None = None, ready_only: bool = True, settings: Settings = Settings()) -> DataFrame:
    """Search within assigned shared knowledge bases."""
    return search_in(S.global_candidates(chunks, kb_ids, types, ready_only), query, qvec, top_k, settings)


def merge_scopes(found: Sequence[DataFrame], top_k: int) -> DataFrame:
    """Results of several searches: the best score of each chunk (the earlier search wins ties), the best top_k."""
    union = None
    for i, df in enumerate(found):
        part = df.withColumn("__from", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    own = W.partitionBy("chunk_id").orderBy(F.desc("score"), "__from")
    best = union.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")
    order = (F.desc("score"), F.col("__from"), F.col("chunk_id"))
    return with_position(best.orderBy(*order).limit(top_k), *order).drop("__from")


def dominant_source(hits: DataFrame, share: float = 0.6, least: int = 2) -> DataFrame:
    """(source_id, n, share) of the source that owns enough of the hits; no row if none does."""
    counts = hits.filter(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    whole = W.partitionBy()
    shared = counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
    best = shared.orderBy(F.desc("n"), "first").limit(1)
    return best.filter((F.col("n") >= least) & (F.col("share") >= share)).select("source_id", F.col("n").cast("long").alias("n"), "share")


def passages(hits: DataFrame, chunks: DataFrame, order: Sequence[str] = ("page_no", "chunk_id"), cap: int = 2000) -> DataFrame:
    """(chunk_id, passage): each hit with its neighbours in reading order, its section's heading ahead if outside of
    them, cut at `cap`; windows that better ones cover are left out.

    chunks: chunk_id, document_id, content, element_id, parent_id and the order columns. Only documents that hold a hit
    are windowed (hits are a few dozen rows, so their ids are broadcast).
    """
    wanted = hits.select("chunk_id", "score")
    ids = chunks.select("chunk_id", "document_id").join(F.broadcast(wanted.select("chunk_id")), "chunk_id", "left_semi").select("document_id").distinct()
    docs = chunks.join(F.broadcast(ids), "document_id", "left_semi")
    own = W.partitionBy("document_id").orderBy(*order)
    around = own.rowsBetween(-1, 1)
    rows = docs.withColumn("__ids", F.collect_list("chunk_id").over(around)).withColumn("__text", F.array_join(F.collect_list(X.empty(F.col("content"))).over(around), "\n"))
    hit = rows.join(F.broadcast(wanted), "chunk_id")
    heads = docs.filter("element_id is not null").groupBy("document_id", "element_id").agg(F.min(F.struct("chunk_id", "content")).alias("h")).select(F.col("document_id").alias("__d"), F.col("element_id").alias("__e"), "h")
    joined = hit.join(heads, (F.col("document_id") == F.col("__d")) & (F.col("parent_id") == F.col("__e")), "left")
    head = X.strip(F.col("h.content"))
    outside = F.col("h").isNotNull() & ~F.array_contains("__ids", F.col("h.chunk_id")) & (head != "")
    text = F.concat(F.when(outside, F.concat(F.lit("["), head, F.lit("]\n"))).otherwise(F.lit("")), F.col("__text"))
    window = F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("id"), F.col("__ids").alias("ids"), X.truncated(text, cap).alias("text"))
    # the greedy cover is an ordered fold over the hits' windows, at most MOST_K of them
    listed = joined.agg(F.array_sort(F.collect_list(window)).alias("w"))
    zero = F.struct(F.slice("w", 1, 0).alias("kept"), F.slice(F.flatten(F.transform("w", lambda x: x["ids"])), 1, 0).alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.size(F.array_except(x["ids"], acc["seen"])) > 0
        return F.when(fresh, F.struct(F.array_append(acc["kept"], x).alias("kept"), F.array_union(acc["seen"], x["ids"]).alias("seen"))).otherwise(acc)

    kept = listed.select(F.explode(F.aggregate("w", zero, step, lambda acc: acc["kept"])).alias("k"))
    return kept.select(F.col("k.id").alias("chunk_id"), (-F.col("k.s")).alias("score"), F.col("k.text").alias("passage"))


def citations(hits: DataFrame) -> DataFrame:
    """What a caller shows: a struct of ids, name, text and the score to six digits."""
    return hits.select("position", F.struct("chunk_id", "source_id", F.col("filename").alias("source"), "content", F.round("score", 6).alias("score")).alias("citation"))


def numbered_context(hits: DataFrame, kind: str = "S") -> DataFrame:
    """One row: hits as `[S1] name: text` lines."""
    line = F.concat(F.lit(f"[{kind}"), (F.col("position") + 1).cast("string"), F.lit("] "), X.empty(F.col("filename")), F.lit(": "), X.empty(F.col("content")))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))
