"""Vector functions over arrays: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(a: Column, dim: int) -> Column:
    """Of the right length, without nulls and NaN, not of length 0."""
    return a.isNotNull() & (F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x)) & F.exists(a, lambda x: x != 0)


def normalize(a: Column) -> Column:
    """Unit vector; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hybrid(structural: Column, semantic: Column, alpha: float) -> Column:
    """Score of two cosines."""
    return F.lit(alpha) * structural + F.lit(1 - alpha) * semantic


def hybrid_concat(structural: Column, semantic: Column, alpha: float) -> Column:
    """Cosine of weighted, concatenated unit vectors, from their two cosines."""
    a, b = alpha * alpha, (1 - alpha) * (1 - alpha)
    return (F.lit(a) * structural + F.lit(b) * semantic) / F.lit(a + b)


def weighted_concat(structural: Column, semantic: Column, alpha: float) -> Column:
    return F.concat(F.transform(structural, lambda x: x.cast("double") * alpha), F.transform(semantic, lambda x: x.cast("double") * (1 - alpha)))
