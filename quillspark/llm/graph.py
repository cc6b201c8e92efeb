"""Connected components of links, and the row that stays of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b): component is the least id reachable.

    Alternating star steps: a large star ties an id's greater neighbours to its least one, a small star its
    smaller ones; a forest of stars is the fixed point, after a number of rounds about the log of the diameter.
    Both steps need an id's edges alone, so a round has two exchanges, and its edges are no more than those before.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    least = F.min("v").over(Window.partitionBy("u"))
    while True:
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        near = both.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
        with freed(e.sparkSession):  # each id is a root, below all its neighbours, or has one neighbour, below it
            stars = near.filter("least < u and least < most").isEmpty()
        if stars:
            return near.select(F.col("u").alias("id"), F.least("u", "least").alias("component"))
        large = both.withColumn("m", F.least("u", least)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.repartition("u").distinct().withColumn("m", least)  # an id's edge to m becomes its own, the others those of its neighbours
        e = stored(small.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")), "edges")


def components(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of `prints`, which has doc_id and a 64-bit `fingerprint`, with the least fingerprint over the edges as `component`."""
    comps = connected_components(edges)
    return prints.join(comps.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def row_key(id_col: str, text_col: str) -> F.Column:
    """Equal for rows of the same id, null or not, and the same text."""
    return F.xxhash64(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`"))


def survivors(df: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of df for each component of `named` (__row, doc_id, component): that of the least id, null ids last; all columns stay."""
    key = "__row"
    while key in df.columns:  # a user's column of that name stays
        key += "_"
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("w")).select(F.col("w.__row").alias(key))
    kept = df.withColumn(key, row_key(id_col, text_col)).join(first, key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)
