"""An inverted full-text index: posting lists with positions, in folders by workspace and hash bucket of the term.

A row is one block of one term's postings: (kb_id, term, postings of chunk_id, source_id, positions), those of one slice of chunks, `BLOCK`
postings at most, so a hot term is many rows and no task builds or reads it as one. Rows are sorted by term, so that a search reads its buckets' folders and
there the row groups of its terms alone. Terms are those of `functions.text.terms`; positions count from 1.

Re-ingesting sources appends a generation with their new postings and a note that older ones of those sources are void; `compacted`
writes what is live as one generation. Nothing is rewritten in place, so readers see a whole index at any time: a generation
counts from the moment its note is written.

Two ranks: `frequency`, the count of the query's terms, and `weighted`, the published formula of PostgreSQL's ts_rank for a conjunction of
terms of one weight: pairs of positions of different terms add up by how near they are, and a single term by its
occurrences, the first one most.

Defined cases: null and blank contents have no postings; a null chunk or source id is left out, as it can't be found again; a null
workspace is a shared one, with a folder of its own; a chunk id that comes twice is one chunk with the positions of both; other columns
stay behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators.retrieval import query_terms, strings

BUCKETS, BLOCK = 64, 4096
TERMS_AT_ONCE = 1 << 21  # terms of a slice, and pairs of positions, that one numpy step looks at
# The formula's weight, its largest distance and position, positions kept a term, and the limit of the sum of 1 / i**2.
WEIGHT, FAR, LAST_POSITION, MOST_POSITIONS, LIMIT = 0.1, 100, 16383, 256, 1.64493406685
SHARED = "__shared"
ROW = "workspace string, bucket int, kb_id string, term string, postings array<struct<chunk_id:{id},source_id:{source},positions:array<int>>>"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def occurrences(chunks: DataFrame, buckets: int, block: int) -> DataFrame:
    """(workspace, bucket, kb_id, term, postings): each term's postings in a slice of `block` chunks at most, sorted and cut as Arrow columns.
    Chunks are tokenised once, where they lie: only blocks are shuffled."""
    found = F.col("terms") if "terms" in chunks.columns else X.terms(F.col("content"))
    workspace = F.coalesce(F.col("workspace_id").cast("string"), F.lit(SHARED))
    rows = chunks.filter("chunk_id is not null and source_id is not null").select(workspace.alias("workspace"), F.col("kb_id").cast("string").alias("kb_id"), "chunk_id", "source_id", found.alias("terms"))
    kinds = dict(rows.dtypes)
    out = f"workspace string, kb_id string, term string, postings array<struct<chunk_id:{kinds['chunk_id']},source_id:{kinds['source_id']},positions:array<int>>>"

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        lengths = pc.fill_null(pc.list_value_length(part.column(4)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        owner, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(1, ends[-1] + 1) - np.repeat(ends - lengths, lengths)
        terms = part.column(4).flatten().dictionary_encode()
        spaces, kbs = (part.column(i).dictionary_encode(null_encoding="encode") for i in (0, 1))
        group = spaces.indices.to_numpy().astype(np.int64) * len(kbs.dictionary) + kbs.indices.to_numpy()
        key = group[owner] * len(terms.dictionary) + terms.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # chunks and places stay in order within a term
        key, owner, place = key[order], owner[order], place[order]
        turn = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(turn | np.concatenate([[True], owner[1:] != owner[:-1]]))  # where a posting begins
        first = np.flatnonzero(turn[at])  # the first posting of a term
        positions = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)), pa.int32()), pa.array(place, pa.int32()))
        held = pa.StructArray.from_arrays([*(part.column(i).take(pa.array(owner[at])) for i in (2, 3)), positions], ["chunk_id", "source_id", "positions"])
        lead = at[first]
        columns = [*(part.column(i).take(pa.array(owner[lead])) for i in (0, 1)), terms.dictionary.take(pa.array(key[lead] % len(terms.dictionary)))]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), held)], names=["workspace", "kb_id", "term", "postings"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                few = batch.slice(start, block)
                few = few.filter(pc.greater(pc.fill_null(pc.list_value_length(few.column(4)), 0), 0))
                counts = np.cumsum(pc.list_value_length(few.column(4)).to_numpy(zero_copy_only=False))
                while few.num_rows:  # a slice of many terms is cut before it is sorted
                    n = max(1, int(np.searchsorted(counts, TERMS_AT_ONCE, side="right")))
                    yield cut(few.slice(0, n))
                    few, counts = few.slice(n), counts[n:] - counts[n - 1]

    spread = rows.mapInArrow(run, out)
    return spread.select("workspace", bucket_of(F.col("term"), buckets).alias("bucket"), "kb_id", "term", "postings")


def gathered(rows: DataFrame) -> DataFrame:
    """Blocks by folder, in the order of their terms; a folder with many rows, as a hot term makes it, is split over tasks."""
    return rows.hint("rebalance", "workspace", "bucket").sortWithinPartitions("workspace", "bucket", "term")


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """Postings, one a row, in blocks: dealt by ranges of (workspace, bucket, term, chunk), so a hot term lies in several tasks; each task
    streams its rows and holds one block."""
    keys = ["workspace", "bucket", "term", "kb_id", "chunk_id"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = dict(rows.dtypes)
    ids = {k: v for k, v in kinds.items() if k in ("chunk_id", "source_id")}
    schema = ROW.format(id=ids["chunk_id"], source=ids["source_id"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        kind = None

        def out(done: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([d[0][i] for d in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([d[1] for d in done], pa.list_(kind))], names=["workspace", "bucket", "kb_id", "term", "postings"])

        for batch in batches:
            fields = batch.schema
            kind = kind or pa.struct([fields.field(n).with_name(n) for n in ("chunk_id", "source_id")] + [pa.field("positions", pa.list_(pa.int32()))])
            done = []
            columns = [batch.column(fields.get_field_index(n)).to_pylist() for n in ("workspace", "bucket", "kb_id", "term", "chunk_id", "source_id", "positions")]
            for *at, chunk, source, positions in zip(*columns, strict=True):
                if at != key or len(held) >= block:
                    if held:
                        done.append((key, held))
                    key, held = at, []
                held.append({"chunk_id": chunk, "source_id": source, "positions": positions})
            if done:
                yield out(done)
        if held:
            yield out([(key, held)])

    return dealt.mapInArrow(run, schema)


def generation(spark: SparkSession, path: str) -> int:
    """The newest complete generation, 0 for a path without any."""
    try:
        return spark.read.parquet(f"{path}/notes").agg(F.max("generation")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise


def write(chunks: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK, void: DataFrame | None = None) -> int:
    """Appends the chunks (chunk_id, source_id, workspace_id, kb_id, content or terms) as a generation and returns its number. void: a
    table of source_id whose older postings no longer count. All generations of a path have the same number of buckets."""
    spark = chunks.sparkSession
    number = generation(spark, path) + 1
    part = f"{number:08d}-{uuid.uuid4().hex}"  # what a run that failed left behind has no note and is never read
    gathered(occurrences(chunks, buckets, block)).write.partitionBy("workspace", "bucket").parquet(f"{path}/blocks/part={part}")
    gone = (void if void is not None else chunks.limit(0)).select(F.col("source_id").cast("string").alias("source_id")).filter("source_id is not null").distinct()
    note = gone.unionByName(spark.createDataFrame([(None,)], "source_id string")).select(F.lit(number).alias("generation"), F.lit(part).alias("part"), F.lit(buckets).alias("buckets"), "source_id")
    note.coalesce(1).write.mode("append").parquet(f"{path}/notes")
    return number


def replace(chunks: DataFrame, path: str, block: int = BLOCK) -> int:
    """Re-ingest: the postings of these chunks' sources give way to the new ones."""
    spark = chunks.sparkSession
    return write(chunks, path, spark.read.parquet(f"{path}/notes").first()["buckets"], block, chunks.select("source_id").distinct())


def live(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(blocks of complete generations, void sources with the generation that voids them, or None)."""
    parts = [r["part"] for r in spark.read.parquet(f"{path}/notes").select("part").distinct().collect()]
    rows = spark.read.parquet(f"{path}/blocks").filter(F.col("part").isin(parts)).withColumn("generation", F.substring("part", 1, 8).cast("int"))
    void = spark.read.parquet(f"{path}/notes").filter("source_id is not null")
    return rows, None if void.isEmpty() else void.groupBy(F.col("source_id").alias("void_id")).agg(F.max("generation").alias("voided"))


def postings(spark: SparkSession, path: str, workspace: str | None, terms: Sequence[str], kb: str | None = None) -> DataFrame:
    """(term, chunk_id, source_id, positions) of some terms, read from their buckets' folders alone."""
    rows, void = live(spark, path)
    buckets = spark.read.parquet(f"{path}/notes").first()["buckets"]
    # buckets of the terms, as constants, so that folders are pruned while the search is planned
    wanted = [r[0] for r in spark.range(1).select(F.explode(strings(terms)).alias("t")).select(bucket_of(F.col("t"), buckets)).distinct().collect()] if terms else []
    rows = rows.filter((F.col("workspace") == (SHARED if workspace is None else str(workspace))) & F.col("bucket").isin(wanted) & F.col("term").isin(*terms))
    if kb is not None:
        rows = rows.filter(F.col("kb_id") == str(kb))
    found = rows.select("generation", "term", F.explode("postings").alias("p")).select("generation", "term", "p.*")
    if void is not None:
        found = found.join(void, F.col("source_id").cast("string") == F.col("void_id"), "left").filter("voided is null or generation >= voided")
    return found.select("term", "chunk_id", "source_id", "positions")


def weighted_rank(hits: DataFrame, n_terms: int) -> DataFrame:
    """Adds weight, ts_rank of `by_term` (for each term its ascending positions): one term by its occurrences, several by nearness. by_term
    itself is dropped."""
    kept = F.transform("by_term", lambda p: F.transform(F.slice(p, 1, MOST_POSITIONS), lambda x: F.least(x, F.lit(LAST_POSITION))))
    names = [c for c in hits.columns if c != "by_term"]
    rows = hits.select(*names, kept.alias("by_term"))
    # the sum of weight / i**2 over occurrences: the greatest weight counts once in full, and all weights are equal
    alone = np.concatenate([[0.0], np.cumsum(WEIGHT / np.arange(1, MOST_POSITIONS + 1) ** 2)]) / LIMIT
    distance = np.arange(1, FAR + 1)
    near = np.log1p(-np.sqrt(WEIGHT * WEIGHT / (1.005 + 0.05 * np.exp(distance / 1.5 - 2))))
    factor = np.concatenate([[0.0], near, [0.0]])  # logarithms of 1 - weight by distance; beyond FAR it is within 1e-16 of 0
    pairs = [(i, j) for i in range(1, n_terms) for j in range(i)]

    def ranked(part: pa.RecordBatch) -> np.ndarray:
        flat = part.column(len(names)).flatten()
        sizes = pc.list_value_length(flat).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n_terms)
        if n_terms == 1:
            return alone[sizes[:, 0]]
        place = flat.flatten().to_numpy(zero_copy_only=False)
        first = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
        total = np.zeros(len(sizes))
        for i, j in pairs:
            n = sizes[:, i] * sizes[:, j]
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            x, y = first[row, i] + k // sizes[row, j], first[row, j] + k % sizes[row, j]
            total += np.bincount(row, factor[np.minimum(np.abs(place[x] - place[y]), FAR + 1)], len(n))
        return -np.expm1(total)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TERMS_AT_ONCE // MOST_POSITIONS**2)
        for batch in batches:
            weights = [ranked(batch.slice(k, step)) for k in range(0, batch.num_rows, step)]
            if weights:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(weights))], names=[*names, "weight"])

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in rows.dtypes if n != "by_term") + ", weight double")


def search(spark: SparkSession, path: str, workspace: str | None, query: str, limit: int, kb: str | None = None, rank: str = "frequency", candidates: DataFrame | None = None) -> DataFrame:
    """(chunk_id, source_id, frequency, weight, fts_rank): chunks with all terms of the query, the best `limit` by the chosen rank, then by
    id. candidates, if given, has the chunk_ids that may come up. weight is null unless it is the rank asked for."""
    if rank not in ("frequency", "weighted"):
        raise ValueError(f"unknown rank {rank}")
    terms = query_terms(query)
    found = postings(spark, path, workspace, terms, kb)
    if not terms:
        return found.limit(0).select("chunk_id", "source_id", F.lit(0).cast("long").alias("frequency"), F.lit(None).cast("double").alias("weight"), F.lit(0).alias("fts_rank"))
    if rank == "weighted":
        grouped = found.groupBy("chunk_id", "source_id").agg(F.collect_list(F.struct("term", "positions")).alias("of"))
        of_term = lambda t: F.array_sort(F.flatten(F.transform(F.filter("of", lambda x: x["term"] == t), lambda x: x["positions"])))
        hits = grouped.withColumn("by_term", F.array(*map(of_term, terms))).filter(~F.exists("by_term", lambda p: F.size(p) == 0)).withColumn("frequency", F.size(F.flatten("by_term")).cast("long")).drop("of")
    else:  # counts are enough: no position is shuffled
        counted = found.select("term", "chunk_id", "source_id", F.size("positions").cast("long").alias("n"))
        hits = counted.groupBy("chunk_id", "source_id").agg(F.sum("n").alias("frequency"), F.size(F.collect_set("term")).alias("found")).filter(F.col("found") == len(terms))
    if candidates is not None:
        hits = hits.join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    if rank == "weighted":
        scored = weighted_rank(hits, len(terms)).withColumn("weight", F.round("weight", 9))
    else:
        scored = hits.select("chunk_id", "source_id", "frequency", F.lit(None).cast("double").alias("weight"))
    by = "weight" if rank == "weighted" else "frequency"
    best = scored.select("chunk_id", "source_id", "frequency", "weight").orderBy(F.desc(by), "chunk_id").limit(limit)
    return best.withColumn("fts_rank", F.row_number().over(W.orderBy(F.desc(by), "chunk_id")) - 1)


def compacted(spark: SparkSession, path: str, out: str, block: int = BLOCK) -> None:
    """The live postings as a new index of one generation."""
    rows, void = live(spark, path)
    flat = rows.select("generation", "workspace", "bucket", "kb_id", "term", F.explode("postings").alias("p")).select("generation", "workspace", "bucket", "kb_id", "term", "p.*")
    if void is not None:
        flat = flat.join(void, F.col("source_id").cast("string") == F.col("void_id"), "left").filter("voided is null or generation >= voided").drop("void_id", "voided")
    part = f"{1:08d}-{uuid.uuid4().hex}"
    blocks(flat.drop("generation"), block).withColumn("part", F.lit(part)).write.partitionBy("part", "workspace", "bucket").parquet(f"{out}/blocks")
    buckets = spark.read.parquet(f"{path}/notes").first()["buckets"]
    spark.createDataFrame([(1, part, buckets, None)], "generation int, part string, buckets int, source_id string").coalesce(1).write.parquet(f"{out}/notes")
