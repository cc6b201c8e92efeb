"""Approximate nearest neighbours: inverted lists by nearest centroid, one partition folder a list.

Centroids are trained on a bounded sample, every vector goes to the list of its nearest one, and a search opens only the lists
nearest to the query: Spark prunes the other folders. How many lists reach the wanted recall is measured when the index is
built, by an exact search of sample queries over all rows. With `exact=True` a search goes on to every list that could
still hold a nearer vector, by the list's radius, so its result is that of a full scan.

Defined cases: null vectors aren't indexed; a zero vector has similarity 0 to everything and lies in list 0; equal similarities go by
id; repeated ids each count. Vectors of one index have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import vectors as V

MOST_LISTS, SAMPLE, SAMPLE_QUERIES, BLOCK = 4096, 50_000, 64, 4096


@dataclass(frozen=True)
class Centroids:
    """What the driver knows of an index: at most MOST_LISTS unit vectors, each list's least similarity to its own, its size."""

    at: np.ndarray
    least: np.ndarray
    n: np.ndarray
    probes: int
    id_type: str

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists from the nearest on, for each row of q."""
        return np.argsort(-(units(np.atleast_2d(q)) @ self.at.T), axis=1, kind="stable")

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The greatest similarity that a vector of each list can have to q."""
        angle = np.arccos(np.clip(self.at @ units(q[None])[0], -1, 1)) - np.arccos(np.clip(self.least, -1, 1))
        return np.cos(np.maximum(0, angle))


def units(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def trained(rows: DataFrame, lists: int, sample: int, seed: int) -> np.ndarray:
    """Centroids of at most `sample` rows, the first by a hash of their id."""
    some = rows.filter(V.norm(F.col("embedding")) > 0).orderBy(F.xxhash64("id"), "id").limit(sample)
    points = some.select(array_to_vector(F.col("embedding")).alias("features"))
    model = KMeans(k=lists, distanceMeasure="cosine", maxIter=10, seed=seed).fit(points)
    return units(np.array(model.clusterCenters()))


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE, k: int = 10, recall: float = 0.95, seed: int = 7) -> None:
    """Writes the index of all vectors. lists: by default the root of the row count, MOST_LISTS at most."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding")).filter("embedding is not null")
    n = rows.filter(V.norm(F.col("embedding")) > 0).count()
    lists = max(1, min(lists or round(math.sqrt(n)), MOST_LISTS, max(n, 1)))
    at = trained(rows, lists, sample, seed) if lists > 1 else np.ones((1, 1))
    shared = spark.sparkContext.broadcast(at)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(matrix(batch.column(1)))
            near = x @ shared.value.T if len(shared.value) > 1 else np.where(np.abs(x).sum(axis=1, keepdims=True) > 0, 1.0, 0.0)
            own = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(near[np.arange(len(own)), own])], names=["id", "embedding", "list", "near"])

    placed = rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("near", T.DoubleType())]))
    # a large list is dealt to several files by id; a file holds few lists
    placed.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/lists")
    id_type = dict(rows.dtypes)["id"]
    counted = {r["list"]: r for r in stored_lists(spark, path, id_type).groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("least")).collect()}
    table = [(i, c.tolist(), counted[i]["least"] if i in counted and len(at) > 1 else -1.0, counted[i]["n"] if i in counted else 0, id_type) for i, c in enumerate(at)]
    spark.createDataFrame(table, "list int, centroid array<double>, least double, n long, id_type string").coalesce(1).write.parquet(f"{path}/centroids")
    probes = calibrated(spark, path, k, recall) if n and len(at) > 1 else 1
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")


def centroids(spark: SparkSession, path: str, probes: int | None = None) -> Centroids:
    """The index's centroids; probes, if given, takes the place of the measured number."""
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])
    probes = probes or spark.read.parquet(f"{path}/probes").first()["probes"]
    return Centroids(np.array([r["centroid"] for r in rows]), np.array([r["least"] for r in rows]), np.array([r["n"] for r in rows]), probes, rows[0]["id_type"])


def stored_lists(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """All lists; with the schema given, as an empty index has no file to tell it."""
    return spark.read.schema(f"id {id_type}, embedding array<double>, near double, list int").parquet(f"{path}/lists")


def calibrated(spark: SparkSession, path: str, k: int, recall: float) -> int:
    """The fewest lists that, opened nearest first, hold `recall` of the k nearest neighbours of SAMPLE_QUERIES rows: an exact
    search of those over all rows."""
    known = centroids(spark, path, probes=1)
    every = stored_lists(spark, path, known.id_type)
    queries = every.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_QUERIES).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    found = neighbours(queries, path, k, probes=len(known.at)).join(queries, "query_id").collect()
    places = sorted(int(np.flatnonzero(known.order(np.array(r["q"]))[0] == r["list"])[0]) + 1 for r in found)
    return places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)] if places else 1


def in_lists(spark: SparkSession, path: str, known: Centroids, lists: Sequence[int]) -> DataFrame:
    """The rows of some lists: the filter stands on the partition column, so other folders aren't read."""
    return stored_lists(spark, path, known.id_type).filter(F.col("list").isin([int(i) for i in lists]))


def nearest(rows: DataFrame, q: Sequence[float], k: int) -> DataFrame:
    size = math.sqrt(sum(float(x) ** 2 for x in q))
    return rows.select("id", V.cosine(F.col("embedding"), V.vector(q), F.lit(size)).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def search(spark: SparkSession, path: str, q: Sequence[float], k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(id, similarity) of the k nearest rows in the nearest lists; with exact, of all rows."""
    known, vector = centroids(spark, path, probes), np.array(q, dtype=float)
    if len(known.at) == 1:
        return nearest(in_lists(spark, path, known, [0]), q, k)
    order = known.order(vector)[0]
    opened = order[: known.probes]
    found = nearest(in_lists(spark, path, known, opened), q, k)
    if not exact:
        return found
    best = found.collect()  # k rows
    least = best[-1]["similarity"] if len(best) == k else -1.0
    open_ = known.bounds(vector) >= least - 1e-9
    more = [i for i in order[known.probes :] if open_[i] and known.n[i] or i == 0]  # zero vectors lie in list 0 whatever its radius
    return nearest(in_lists(spark, path, known, [*opened, *more]), q, k)


def neighbours(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, list): for each query (query_id, q) the k nearest rows other than itself.

    Queries go to the lists that they open; a list's vectors and its queries meet in blocks of about `block` each, so neither a large
    list nor a popular one is a single task. Each block keeps k rows a query.
    """
    spark = queries.sparkSession
    known = centroids(spark, path, probes)
    shared = spark.sparkContext.broadcast(known)
    kinds = dict(queries.dtypes)
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter("q is not null")

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = shared.value
                lists = c.order(matrix(batch.column(1)))[:, : c.probes] if len(c.at) > 1 else np.zeros((batch.num_rows, 1), int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    wanted = asked.mapInArrow(opened, f"query_id {kinds['query_id']}, q array<double>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list"))
    # numbers of blocks by list: at most MOST_LISTS rows
    n_queries = wanted.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"))
    sizes = F.broadcast(spark.createDataFrame([(i, -(-int(n) // block)) for i, n in enumerate(known.n)], "list int, v_blocks int").join(n_queries, "list").filter("v_blocks > 0"))
    left = stored_lists(spark, path, known.id_type).join(sizes, "list")
    left = left.select("list", F.pmod(F.xxhash64("id"), "v_blocks").cast("int").alias("v_block"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"), "id", "embedding")
    right = wanted.join(sizes, "list")
    right = right.select("list", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("v_block"), F.pmod(F.xxhash64("query_id"), "q_blocks").cast("int").alias("q_block"), "query_id", "q")
    out = f"query_id {kinds['query_id']}, id {known.id_type}, similarity double, list int"

    def block_best(rows: pa.Table, asking: pa.Table) -> pa.Table:
        near = units(matrix(asking.column("q"))) @ units(matrix(rows.column("embedding"))).T if rows.num_rows and asking.num_rows else np.zeros((asking.num_rows, 0))
        ids, q_ids = rows.column("id"), asking.column("query_id")
        most = min(k + 1, near.shape[1])  # one more, as a query finds itself
        best = np.argpartition(-near, most - 1, axis=1)[:, :most] if most else np.zeros((len(near), 0), int)
        at = np.repeat(np.arange(len(near)), most)
        # rows as similar as the last one kept stay too: ids decide later
        if most and most < near.shape[1]:
            edge = np.take_along_axis(near, best, 1).min(axis=1)
            at, flat = np.nonzero(near >= edge[:, None])
        else:
            flat = best.ravel()
        return pa.table({"query_id": q_ids.take(pa.array(at)), "id": ids.take(pa.array(flat)), "similarity": pa.array(near[at, flat] if len(at) else np.zeros(0)), "list": pa.array(np.full(len(at), rows.column("list")[0].as_py() if rows.num_rows else 0, np.int32))})

    keys = ["list", "v_block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_best, out).filter("id <> query_id")
    own = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= k).drop("__n")
