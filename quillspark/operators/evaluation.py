"""Retrieval quality: per-question metrics, summaries by arm and type, and the difference of two arms.

Everything groups by question, so questions spread over the cluster; a question's ranking is at most a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

METRICS = ("recall_at_k", "precision_at_k", "ndcg_at_k", "mrr", "keyword_coverage")


def question_metrics(questions: DataFrame, returned: DataFrame) -> DataFrame:
    """(question_id, hits, and the metrics, four digits) for each question.

    questions: question_id, expected (array<string>), keywords (array<string>). returned: question_id, rank (from 1),
    source, text. A result is relevant if an expected name equals or is part of its source. Recall counts distinct
    expected names; a question without expectations has recall 1, and precision and nDCG 1 if nothing came back.
    """
    q = questions.select("question_id", F.coalesce("expected", F.array().cast("array<string>")).alias("expected"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    rows = q.join(returned.select("question_id", "rank", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")), "question_id", "left")
    found = F.filter("expected", lambda e: (e == F.col("source")) | ((e != "") & F.contains(F.col("source"), e)))
    seen = F.filter("keywords", lambda k: (k != "") & F.contains(F.col("text"), k))
    hit = rows.withColumn("found", found).withColumn("seen", seen).withColumn("rel", F.when(F.col("rank").isNotNull(), (F.size("found") > 0).cast("int")))
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    best = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("rel"), "rank"))
    ideal = F.when(F.col("rel") == 1, F.lit(1.0) / F.log2(F.col("i") + 1)).otherwise(F.lit(0.0))
    per = (
        hit.withColumn("i", best)
        .groupBy("question_id")
        .agg(
            F.count("rank").alias("hits"),
            F.sum("rel").alias("rel"),
            F.sum(F.when(F.col("rel") == 1, gain).otherwise(F.lit(0.0))).alias("dcg"),
            F.sum(ideal).alias("idcg"),
            F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
            F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"),
            F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n_seen"),
            F.first(F.size("expected")).alias("n_expected"),
            F.first(F.size(F.array_distinct("keywords"))).alias("n_keywords"),
        )
    )
    none = F.when(F.col("n_expected") == 0, 1.0).otherwise(0.0)
    return per.select(
        "question_id",
        "hits",
        F.round(F.when(F.col("n_expected") > 0, F.col("n_found") / F.col("n_expected")).otherwise(1.0), 4).alias("recall_at_k"),
        F.round(F.when(F.col("hits") > 0, F.col("rel") / F.col("hits")).otherwise(none), 4).alias("precision_at_k"),
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(none), 4).alias("ndcg_at_k"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.when(F.col("n_keywords") > 0, F.col("n_seen") / F.col("n_keywords")).otherwise(1.0), 4).alias("keyword_coverage"),
    )


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Averages (two digits) of answerable questions, and how often unanswerable ones came back empty, by arm or more.

    rows: metrics, `unanswerable` (boolean) and `top_score`.
    """
    ok = ~F.col("unanswerable")
    means = [F.round(F.avg(F.when(ok, F.col(m))), 2).alias(f"avg_{m}") for m in METRICS]
    empty = F.round(F.avg(F.when(~ok, (F.col("hits") == 0).cast("int"))), 4).alias("unanswerable_empty_rate")
    top = F.round(F.avg(F.when(~ok, F.coalesce("top_score", F.lit(0.0)))), 4).alias("unanswerable_avg_top_score")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_answerable"), *means, empty, top)


def recall_by_type(rows: DataFrame, *by: str) -> DataFrame:
    return rows.filter(~F.col("unanswerable")).groupBy(*by, "type").agg(F.round(F.avg("recall_at_k"), 4).alias("recall"))


def arm_delta(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(question_id, metric, base, other, delta) of two arms, metrics as rows."""
    long = rows.select("question_id", "arm", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x"))
    wide = long.groupBy("question_id", "x.metric").agg(F.max(F.when(F.col("arm") == base, F.col("x.v"))).alias("base"), F.max(F.when(F.col("arm") == other, F.col("x.v"))).alias("other"))
    return wide.withColumn("delta", F.round(F.col("other") - F.col("base"), 4))
