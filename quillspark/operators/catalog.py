"""The catalog around sources: chunks with their dimensions, counts and lists for people, states and references.

Every list that is cut takes the newest by a column, ties by id, so a task keeps its best rows and only those meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

FIGURE_KINDS = ("image", "figure")
MOST_AUDIT, MOST_USERS = 200, 500


def joined_chunks(chunks: DataFrame, segments: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks with their segment's place, document's title and source's name, type and state: inner equi-joins, so a chunk
    without one of them is no candidate."""
    place = segments.select("segment_id", "document_id", "page_no", "start_ms", "end_ms")
    title = documents.select("document_id", "source_id", "title")
    source = sources.select("source_id", "filename", "type", "status")
    return chunks.join(place, "segment_id").join(title, "document_id").join(source, "source_id")


def chunk_counts(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, n_chunks, n_figures) of every source, 0 where it has none."""
    held = chunks.groupBy("source_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("kind").isin(*FIGURE_KINDS)).alias("n_figures"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sources.select("source_id").join(held, "source_id", "left").select("source_id", none("n_chunks"), none("n_figures"))


def figure_list(chunks: DataFrame) -> DataFrame:
    """Image and figure chunks (chunk_id, element_id, page_no, kind, caption, vision_description, vision_failed, vision_skipped,
    vision_uncertain, storage_key, content) with their state: a failure counts before a skip, a skip before a description."""
    skipped = F.when(X.empty(F.col("vision_skipped")) != "", F.concat(F.lit("skipped:"), "vision_skipped"))
    described = F.when(X.empty(F.col("vision_description")) != "", "described").otherwise("placeholder")
    status = F.when(F.coalesce("vision_failed", F.lit(False)), "failed").otherwise(F.coalesce(skipped, described))
    texts = [X.empty(F.col(c)).alias(c) for c in ("element_id", "caption", "storage_key")]
    figures = chunks.filter(F.col("kind").isin(*FIGURE_KINDS))
    return figures.select("chunk_id", texts[0], "page_no", texts[1], status.alias("vision_status"), F.coalesce("vision_uncertain", F.lit(False)).alias("vision_uncertain"), texts[2], F.substring(X.empty(F.col("content")), 1, 300).alias("excerpt"))


def skip_counts(figures: DataFrame, *by: str) -> DataFrame:
    """(by, reason, n) of figures that were skipped."""
    return figures.filter(X.empty(F.col("reason")) != "").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def removal_counts(documents: DataFrame, segments: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, documents, segments, chunks, blobs): what a re-ingest of these sources removes. All have a source_id;
    blobs are chunks with a storage_key."""
    one = lambda df, *flags: df.select("source_id", *[F.lit(int(f)).alias(n) if isinstance(f, bool) else f.cast("int").alias(n) for n, f in zip(("documents", "segments", "chunks", "blobs"), flags, strict=True)])
    blob = X.empty(F.col("storage_key")) != ""
    rows = one(documents, True, False, False, False).unionByName(one(segments, False, True, False, False)).unionByName(one(chunks, False, False, True, blob))
    return rows.join(sources.select("source_id").distinct(), "source_id", "left_semi").groupBy("source_id").agg(*[F.sum(c).alias(c) for c in ("documents", "segments", "chunks", "blobs")])


def newest(df: DataFrame, limit: int, most: int, key: str, at: str = "created_at") -> DataFrame:
    """The newest rows: audit rows with most=MOST_AUDIT, users with limit and most MOST_USERS."""
    return df.orderBy(F.desc(at), key).limit(max(1, min(limit, most)))


def list_order() -> list[Column]:
    """Pinned conversations first, then the newest, ties by id."""
    return [F.desc(F.coalesce("pinned", F.lit(False))), F.desc("created_at"), F.col("conversation_id")]


def conversation_list(conversations: DataFrame, owner: str) -> DataFrame:
    """An owner's conversations, pinned ones first, then the newest."""
    return conversations.filter(F.col("user_id") == owner).orderBy(*list_order())


def conversation_places(conversations: DataFrame) -> DataFrame:
    """All rows with `place`, from 1, in the list of their owner."""
    return conversations.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(*list_order())))


def patched(states: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """(key, state): each state map with the keys of its patch set anew; a patch without a state is the state."""
    both = states.select(key, F.col("state").alias("__s")).join(patches.select(key, F.col("state").alias("__p")), key, "full")
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("__s", none), F.coalesce("__p", none)
    return both.select(key, F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new).alias("state"))


def patched_json(states: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """(key, state) of free-form states and patches (key, state: JSON text of an object): each state with the keys of its patch set anew, whatever
    lies below them; values stay what they are, nested ones too. A text that is no object counts as an empty one; of a key that
    comes twice in one object the last counts."""
    parsed = lambda df, name: df.select(key, F.coalesce(F.from_json("state", "map<string,variant>"), F.create_map().cast("map<string,variant>")).alias(name))
    both = parsed(states, "__s").join(parsed(patches, "__p"), key, "full")
    none = F.create_map().cast("map<string,variant>")
    old, new = F.coalesce("__s", none), F.coalesce("__p", none)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return both.select(key, F.to_json(merged).alias("state"))


def at_path(state: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as `$.task.steps[0]` of a JSON text, in a type; null where there is none or it doesn't fit."""
    return F.try_variant_get(F.try_parse_json(state), path, kind)


def knowledge_of(instances: DataFrame, definitions_kbs: DataFrame, instance_kbs: DataFrame) -> DataFrame:
    """(instance_id, kb_id): an agent's own knowledge bases and those of its definition, each once."""
    shared = instances.select("instance_id", "definition_id").join(definitions_kbs, "definition_id").select("instance_id", "kb_id")
    return shared.unionByName(instance_kbs.select("instance_id", "kb_id")).distinct()


def references(hits: DataFrame, places: Sequence[str] = ("page_no", "start_ms", "end_ms")) -> DataFrame:
    """Numbered references of a plan's hits, in their order: (n, chunk_id, source, page_no, start_ms, end_ms)."""
    return hits.select((F.col("position") + 1).alias("n"), "chunk_id", X.empty(F.col("filename")).alias("source"), *[F.col(c) if c in hits.columns else F.lit(None).cast("long").alias(c) for c in places])
