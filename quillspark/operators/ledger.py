"""Usage ledger: cleaning and pricing events, and its roll-ups.

Roll-ups are single aggregations with map-side combine; the price list is a small constant that is joined by broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# USD per 1000 prompt and completion tokens, by provider and model, in order of preference.
PRICES = (
    ("openai_compat", "gpt-4o-mini", 0.00015, 0.0006),
    ("openai_compat", "gpt-4.1-nano", 0.0001, 0.0004),
    ("openai_compat", "text-embedding-3-small", 0.00002, 0.0),
    ("openai_compat", "gemini-2.5-flash", 0.0003, 0.0025),
    ("openai_compat", "gemini-2.5-flash-lite", 0.0001, 0.0004),
    ("openai_compat", "gemini-2.0-flash", 0.0001, 0.0004),
    ("gemini", "gemini-2.0-flash", 0.0001, 0.0004),
    ("gemini", "gemini-2.5-flash", 0.0003, 0.0025),
)


def prices(spark: SparkSession, rows: tuple = PRICES) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, provider string, model string, prompt_price double, completion_price double")


def with_cost(events: DataFrame, price_list: DataFrame) -> DataFrame:
    """Adds cost_usd: the price of (provider, model), else of the first row with the model, else null (unpriced, not free)."""
    exact = price_list.select(F.col("provider").alias("__p"), F.col("model").alias("__m"), F.struct("prompt_price", "completion_price").alias("__exact"))
    any_provider = price_list.groupBy("model").agg(F.min_by(F.struct("prompt_price", "completion_price"), "place").alias("__any")).withColumnRenamed("model", "__m2")
    provider, model = F.lower(X.strip(X.empty(F.col("provider")))), X.strip(F.col("model"))
    joined = events.join(F.broadcast(exact), (provider == F.col("__p")) & (model == F.col("__m")), "left").join(F.broadcast(any_provider), model == F.col("__m2"), "left")
    price = F.coalesce("__exact", "__any")
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    exact_price = lambda c: price[c].cast("decimal(12,8)")  # noqa: E731  decimals, so that halves round as they're written
    cost = (n("prompt_tokens") * exact_price("prompt_price") + n("completion_tokens") * exact_price("completion_price")) * F.lit(Decimal("0.001"))
    return joined.select(*[F.col(c) for c in events.columns if c != "cost_usd"], F.round(cost, 6).cast("double").alias("cost_usd"))


def cleaned(events: DataFrame, spans: list[str]) -> DataFrame:
    """Events as the ledger keeps them: known spans only, counts not negative, one call at least, names cut."""
    least = lambda c, n: F.greatest(F.coalesce(F.col(c), F.lit(n)), F.lit(n)).alias(c)
    cut = lambda c, n: F.substring(c, 1, n).alias(c)
    fixed = {"prompt_tokens": least("prompt_tokens", 0), "completion_tokens": least("completion_tokens", 0), "total_tokens": least("total_tokens", 0), "calls": least("calls", 1), "provider": cut("provider", 50), "model": cut("model", 200)}
    return events.filter(F.col("span").isin(spans)).select(*[fixed.get(c, F.col(c)) for c in events.columns])


def filtered(events: DataFrame, workspace: str | None = None, user: str | None = None, since: str | None = None, span: str | None = None) -> DataFrame:
    """All given filters together; a `since` that isn't a time is ignored. Filters are on stored columns, so scans prune."""
    if workspace is not None:
        events = events.filter(F.col("workspace_id") == workspace)
    if user is not None:
        events = events.filter(F.col("user_id") == user)
    if span is not None:
        events = events.filter(F.col("span") == span)
    if since is not None:
        at = F.try_to_timestamp(F.lit(since))
        events = events.filter(at.isNull() | (F.col("created_at") >= at))
    return events


def _sums() -> list[Column]:
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return [
        F.count("*").alias("events"),
        whole("calls"),
        whole("prompt_tokens"),
        whole("completion_tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
    ]


def totals(events: DataFrame) -> DataFrame:
    return events.agg(*_sums())


def by_model(events: DataFrame) -> DataFrame:
    return events.groupBy("span", "provider", "model").agg(*_sums())


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest events, 0 to 200 of them."""
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(max(0, min(limit, 200)))


def audit_rows(events: DataFrame, meta: str = "meta") -> DataFrame:
    """Audit rows with their string metadata redacted."""
    return events.withColumn(meta, F.transform_values(meta, lambda _, v: X.redact(v)))


def merged_settings(layers: list[DataFrame], known: list[str]) -> DataFrame:
    """(key, value, layer) from (key, value, layer) frames, weakest first: the last layer that sets a key wins. A key
    that isn't known fails the query, so that a misspelt setting doesn't pass unseen."""
    union = None
    for i, df in enumerate(layers):
        part = df.select("key", "value", "layer", F.lit(i).alias("rank"))
        union = part if union is None else union.unionByName(part)
    sound = F.when(F.col("key").isin(known), True).otherwise(F.raise_error(F.concat(F.lit("unknown setting "), F.coalesce("key", F.lit("null")))).cast("boolean"))
    best = union.filter(sound & F.col("value").isNotNull()).groupBy("key").agg(F.max_by(F.struct("value", "layer"), "rank").alias("x"))
    return best.select("key", "x.value", "x.layer")
