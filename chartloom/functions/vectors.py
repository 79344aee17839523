"""Vector and score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is all zeros."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid_vector(v: Column) -> Column:
    """Neither null nor all zeros, and without NaN."""
    return F.coalesce(~F.exists(v, F.isnan) & F.exists(v, lambda x: x != 0), F.lit(False))


def min_max(score: Column, *keys: str) -> Column:
    """The score scaled to 0..1 within the keys; a constant score becomes 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (score - low) / F.when(high > low, high - low).otherwise(1.0)


def half_life(days: Column, weight: float = 0.20, halflife: float = 180.0) -> Column:
    """A boost that halves with every ``halflife`` days."""
    return F.lit(weight) * F.pow(F.lit(0.5), days / halflife)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def discount(rank: Column) -> Column:
    """The discount of cumulative gain at a rank counted from one."""
    return 1 / F.log2(rank + 1)
