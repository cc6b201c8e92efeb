"""Whole texts and wider searches behind thin or one-sided hits: the full text of one source, query expansion, merged context."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from . import intents as I
from . import retrieval as R

# Cap of a full text, shares of dominance, sizes of the merged context and of expansion.
FULLTEXT_CHARS, DOMINANCE, LEAST_CHUNKS, LONG_TOKEN = 12_000, 0.6, 2, 4
CONTEXT_HITS, THIN, REWRITES, REWRITE_CHARS = 6, 2, 3, 200
RULES = ("named", "file", "dominant")
CONTEXT_KINDS = ("G", "W", "X", "S", "M")  # shared and workspace knowledge, sheets, web search, maps


def chosen_source(hits: DataFrame, titles: DataFrame, query: str, share: float = DOMINANCE, least: int = LEAST_CHUNKS, rules: Sequence[str] = RULES) -> DataFrame:
    """(source_id, filename, title, rule) of the source whose full text is wanted, or no row. Rules in order: the title and
    name hold every query token; the query speaks of files and shares a longer token with the name; the source owns most hits. Those of `rules` alone are tried.

    hits: source_id, filename, position (50 rows at most); titles: source_id, title, of which the longest counts.
    """
    asked = list(dict.fromkeys(R.query_tokens(query)))
    about_files = any(w in query.lower() for w in I.FILE_WORDS)
    known = hits.filter(F.col("source_id").isNotNull())
    per = known.groupBy("source_id").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.min_by("filename", "position").alias("filename"))
    longest = titles.join(F.broadcast(per.select("source_id")), "source_id", "left_semi").groupBy("source_id").agg(F.max_by("title", F.length(X.empty(F.col("title")))).alias("title"))
    x = per.join(longest, "source_id", "left").withColumn("title", X.empty(F.col("title"))).withColumn("__all", F.sum("n").over(W.partitionBy()))  # over the hits alone
    tokens = X.tokens(F.concat_ws(" ", "title", X.empty(F.col("filename"))))
    named = F.lit(bool(asked)) & (F.size(F.array_except(R.strings(asked), tokens)) == 0)
    overlap = F.size(F.array_intersect(F.filter(X.tokens(F.col("filename")), lambda t: F.length(t) >= LONG_TOKEN), R.strings(asked)))
    holds = {"named": named, "file": F.lit(about_files) & (overlap > 0), "dominant": (F.col("n") >= least) & (F.col("n") / F.col("__all") >= share)}
    rule = F.coalesce(*[F.when(holds[r] & F.lit(r in rules), k) for k, r in enumerate(RULES)])
    ranked = x.withColumn("__rule", rule).filter("__rule is not null").orderBy("__rule", F.when(F.col("__rule") == 1, -overlap).otherwise(-F.col("n") * (F.col("__rule") == 2).cast("int")), "first")
    return ranked.limit(1).select("source_id", "filename", "title", F.element_at(R.strings(RULES), F.col("__rule") + 1).alias("rule"))


def source_fulltext(hits: DataFrame, titles: DataFrame, segments: DataFrame, query: str, order: Sequence[str] = ("document_id", "page_no", "start_ms"), cap: int = FULLTEXT_CHARS, share: float = DOMINANCE, least: int = LEAST_CHUNKS, rules: Sequence[str] = RULES) -> DataFrame:
    """chosen_source with its `text` (cut at `cap`) and `truncated`; no row where nothing is chosen or it has no text."""
    chosen = chosen_source(hits, titles, query, share, least, rules)
    return chosen.crossJoin(F.broadcast(I.capped_text(I.of_source(segments, chosen), order, cap)))  # one row by one row


def expanded(hits: DataFrame, rewrite: Callable[[], Sequence[str]], search: Callable[[str], DataFrame], top: int = CONTEXT_HITS, thin: int = THIN) -> DataFrame:
    """hits, or where fewer than `thin` came back, the best `top` of them and of searches for at most three rewrites.

    Whether the rewriting model is called depends on the hits, so up to `thin` of them are counted first; a rewriter that
    fails leaves the hits as they are.
    """
    if hits.limit(thin).count() >= thin:
        return hits
    try:
        asked = [q.strip()[:REWRITE_CHARS] for q in rewrite() if q and q.strip()]
    except Exception:  # a caller's model may fail in any way
        return hits
    return R.merge_scopes([hits, *[search(q) for q in list(dict.fromkeys(asked))[:REWRITES]]], top)


def merged_context(searches: Sequence[DataFrame], sheets: DataFrame | None = None, top: int = CONTEXT_HITS) -> DataFrame:
    """The best `top` hits of all searches, the earlier search's row of a chunk, then every spreadsheet hit."""
    best = R.merge_scopes(searches, top)
    if sheets is None:
        return best
    after = R.with_position(sheets, F.desc("score"), F.col("chunk_id"))
    held = best.agg(F.count("*").alias("__held"))
    rows = after.crossJoin(F.broadcast(held)).withColumn("position", (F.col("position") + F.col("__held")).cast("int")).drop("__held")
    return best.unionByName(rows, allowMissingColumns=True)


def padded(ranked: DataFrame, hits: DataFrame, top: int | None = None) -> DataFrame:
    """hits in the order of `ranked` (chunk_id, place), then those that a re-ranker left out in their own order; the first `top`."""
    once = ranked.groupBy("chunk_id").agg(F.min("place").alias("__place"))
    rows = R.with_position(hits.join(F.broadcast(once), "chunk_id", "left"), F.col("__place").asc_nulls_last(), F.col("position")).drop("__place")
    return rows if top is None else rows.filter(F.col("position") < top)


def locator(page_no: Column, start_ms: Column, end_ms: Column) -> Column:
    """Where a hit stands: a page, or a span of time, or "?"."""
    page = F.when(page_no > 0, F.concat(F.lit("p."), page_no.cast("string")))
    span = F.concat(start_ms.cast("string"), F.lit("-"), end_ms.cast("string"), F.lit("ms"))
    return F.coalesce(page, span, F.lit("?"))


def _listed(lines: DataFrame, *keys: str, name: str) -> DataFrame:
    """Hits' lines (position, __line) joined by blank lines in order, a row for each value of the keys."""
    parts = F.array_sort(F.collect_list(F.struct("position", "__line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["__line"]), "\n\n").alias(name))


def debug_context(hits: DataFrame) -> DataFrame:
    """One row: hits (position, filename, page_no, start_ms, end_ms, content) numbered from 1, with the place of each; empty
    without hits."""
    place = locator(F.col("page_no"), F.col("start_ms"), F.col("end_ms"))
    line = F.concat(F.lit("["), (F.col("position") + 1).cast("string"), F.lit("] ("), F.coalesce("filename", F.lit("?")), F.lit(" "), place, F.lit(")\n"), X.empty(F.col("content")))
    return _listed(hits.select("position", line.alias("__line")), name="context")


def context_blocks(hits: DataFrame) -> DataFrame:
    """(place, kind, block): the numbered text of each kind of hit, in the order of CONTEXT_KINDS: `[W1] (source / title) text`.

    hits: kind, position, source, detail (a document's title or a sheet's name, if any), content; other kinds are left out.
    """
    known = hits.withColumn("place", F.array_position(R.strings(CONTEXT_KINDS), F.col("kind")).cast("int")).filter("place > 0")
    number = F.row_number().over(W.partitionBy("kind").orderBy("position")).cast("string")
    detail = X.strip(X.empty(F.col("detail")))
    said = F.when(F.col("kind") == "X", F.concat(F.lit(" / sheet "), detail)).when(detail != "", F.concat(F.lit(" / "), detail)).otherwise("")
    line = F.concat(F.lit("["), "kind", number, F.lit("] ("), X.empty(F.col("source")), said, F.lit(") "), X.empty(F.col("content")))
    return _listed(known.select("place", "kind", "position", line.alias("__line")), "place", "kind", name="block")
