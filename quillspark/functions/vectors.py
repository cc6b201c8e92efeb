"""Vector expressions over ARRAY<FLOAT> or ARRAY<DOUBLE>, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A literal vector, folded into the plan: no join brings it to the rows."""
    return F.array(*[F.lit(float(v)) for v in values])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common length."""
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine similarity; a zero vector's norm counts as 1, so its similarity is 0. Null vectors give null."""
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b) if b_norm is None else b_norm))
