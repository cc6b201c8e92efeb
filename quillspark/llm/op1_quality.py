"""Quality by hierarchical empirical Bayes.

1. A document classifier gives evidence: a naive Bayes log-odds over binned features of the whole text (shares of
   capitals, symbols, separators and repeated words, word and line lengths). The bins' counts by label are grouped aggregates of
   all labelled rows outside the held-out fold; a logistic slope and intercept calibrate the sum.
2. Hosts and paths get posteriors from grouped aggregates of their documents' probabilities: a host's mean is shrunk
   towards the global mean, a path's towards its host's. How much, the prior's strength in documents, comes from the
   data by moments: the spread of hosts about the global mean, and of paths about their own host's, beyond what sampling
   explains; documents vary within their path. A sparse site stays near the prior.
3. A document's score adds, in log-odds, its own evidence and its path's posterior against the global mean, with its own
   part taken out of the sums.

Sums run with map-side combine, so a hot host costs a partial row a task; documents meet their path's row in an
equi-join of narrow rows that adaptive execution can split.

Defined cases: null texts count as empty; a null host or path is a group of its own; without labels of both
kinds the evidence is 0 and scores are 0.5; repeated rows each get a row, and equal texts of one path equal scores; a score of
exactly KEEP is kept; texts of any length are read whole; other columns, of whatever name, aren't read and don't come back.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held_out

FEATURES = ("capitals", "symbols", "bars", "shouts", "repeats", "word_length", "line_words", "words")
BINS = 12
KEEP = 0.5
PSEUDO = 2.0


def features(text: Column) -> dict[str, Column]:
    """Each feature's bin, 0 to BINS - 1."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.col("__words")
    count = F.greatest(F.size(words), F.lit(1))
    cap = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(BINS - 1)).cast("int")
    share = lambda pattern, scale: cap(F.ceil(F.regexp_count(t, F.lit(pattern)) / n * scale))
    return {
        "capitals": share(r"\p{Lu}", 15),
        "symbols": share(r"[%&$#*@~^<>=_{}\\]", 60),
        "bars": share(r"\|", 100),
        "shouts": share(r"!", 100),
        "repeats": cap(F.floor((1 - F.size(F.array_distinct(words)) / count) * BINS)),
        "word_length": cap(F.floor(n / count)),
        "line_words": cap(F.floor(F.log2(1 + count / (1 + F.regexp_count(t, F.lit("\n")))))),
        "words": cap(F.floor(F.log2(1 + count))),
    }


def with_bins(df: DataFrame, text_col: str) -> DataFrame:
    split = df.withColumn("__words", F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != ""))
    return split.select(*[c for c in df.columns if c != text_col], F.array(*features(F.col(text_col)).values()).alias("bins"))


def bin_weights(labelled: DataFrame) -> dict[tuple[int, int], float]:
    """Log-odds added by (feature, bin), shrunk by pseudo-counts towards 0; at most 8 * 12 rows leave the executors."""
    rows = labelled.select("quality", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    good = sum(r["good"] for r in rows if r["feature"] == 0)
    bad = sum(r["bad"] for r in rows if r["feature"] == 0)
    if not good or not bad:
        return {}
    rate = lambda k, n, r: (k + PSEUDO * (r["good"] + r["bad"] + 1) / (good + bad + 1)) / (n + PSEUDO)
    return {(r["feature"], r["bin"]): math.log(rate(r["good"], good, r)) - math.log(rate(r["bad"], bad, r)) for r in rows}


def weighted_sum(weights: dict[tuple[int, int], float]) -> Column:
    """The sum of the bins' weights; a bin that no labelled row had adds nothing."""
    total = F.lit(0.0)
    for f in range(len(FEATURES)):
        table = F.array(*[F.lit(weights.get((f, b), 0.0)) for b in range(BINS)])
        total = total + F.get(table, F.get(F.col("bins"), F.lit(f)))
    return total


def calibration(labelled: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the sums, from counts by (rounded sum, label): a bounded table."""
    rows = labelled.withColumn("x", F.round(F.greatest(F.lit(-40), F.least(F.lit(40), "raw")), 1)).groupBy("x").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    x, good, bad = (np.array([float(r[k]) for r in rows]) for k in ("x", "good", "bad"))
    z = np.stack([x, np.ones(len(x))], axis=1)
    beta = np.array([0.5, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (good - (good + bad) * p) - np.array([0.1, 0.1]) * beta
        hess = (z * ((good + bad) * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        beta += np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0]), float(beta[1])


def strength(groups: DataFrame, within: float) -> float:
    """The prior's strength in documents, by moments, from groups (parent, n, s): means of a parent's groups vary about the parent's
    own mean by between + within / n, and so `within / between` documents weigh as much as the parent. Parents of one group tell
    nothing. Only sums of sums leave the executors."""
    mean = F.col("s") / F.col("n")
    # the spread about the parent's mean, as a difference of sums of squares, so that one aggregate by parent is enough
    per = groups.groupBy("parent").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * mean).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"))
    several = per.filter("k > 1").select((F.col("ss") - F.col("s") * mean).alias("v"), (F.col("k") - 1).alias("free"), (F.col("n") - F.col("nn") / F.col("n")).alias("spread"))
    row = several.agg(*[F.sum(c).alias(c) for c in ("v", "free", "spread")]).first()
    if row["free"] is None:
        return 1e6
    between = max((row["v"] - row["free"] * within) / max(row["spread"], 1e-9), 1e-9)
    return min(max(within / between, 1.0), 1e6)


def assess(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, keep) for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    rows = checkpointed(with_bins(rows, "text"))
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = rows.join(known, "doc_id").select("quality", "bins")
    weights = bin_weights(labelled)
    evidence = F.lit(0.0)
    if weights:
        slope, intercept = calibration(labelled.withColumn("raw", weighted_sum(weights)))
        evidence = F.lit(slope) * weighted_sum(weights) + F.lit(intercept)
    p = 1 / (1 + F.exp(-F.col("evidence")))
    scored = rows.select("doc_id", "host", "path", F.greatest(F.lit(-12.0), F.least(F.lit(12.0), evidence)).alias("evidence")).withColumn("p", p)
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.coalesce(F.var_samp("p"), F.lit(0.0)).alias("v")))
    spread = F.sum(F.col("v") * (F.col("n") - 1)) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))
    whole = paths.agg((F.sum("s") / F.sum("n")).alias("m"), spread.alias("v")).first()
    mean, within = whole["m"] if whole["m"] is not None else 0.5, max(whole["v"] or 0.0, 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    k_host = strength(hosts.select(F.lit(0).alias("parent"), F.col("host_n").alias("n"), F.col("host_s").alias("s")), within)
    k_path = strength(paths.select(F.col("host").alias("parent"), "n", "s"), within)
    sites = paths.join(hosts, "host")
    less = lambda c, by: F.greatest(F.col(c) - by, F.lit(0.0))
    host_post = (less("host_s", F.col("p")) + F.lit(k_host * mean)) / (less("host_n", F.lit(1)) + F.lit(k_host))
    path_post = (less("s", F.col("p")) + F.lit(k_path) * F.col("host_posterior")) / (less("n", F.lit(1)) + F.lit(k_path))
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = scored.join(sites, ["host", "path"]).withColumn("host_posterior", clip(host_post)).withColumn("path_posterior", clip(path_post))
    m = min(max(mean, 1e-6), 1 - 1e-6)
    total = F.col("evidence") + F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) - F.lit(math.log(m / (1 - m)))
    out = joined.withColumn("score", 1 / (1 + F.exp(-total)))
    return out.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP).alias("keep"))
