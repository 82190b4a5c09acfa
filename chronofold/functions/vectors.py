"""Arithmetic on arrays of doubles, inside code generation's reach."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(product: Column, norm_a: Column, norm_b: Column) -> Column:
    scale = norm_a * norm_b
    return F.when(scale > 0, product / scale).otherwise(F.lit(0.0))


def inverse_rank(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def discount(rank: Column, k: int) -> Column:
    """Gain of the one relevant item at ``rank``: 1 / log2(rank + 1) within the first k, else 0."""
    return F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(F.lit(0.0))


def left_pad(values: Column, size: int, filler: int = -1) -> Column:
    return F.concat(F.array_repeat(F.lit(filler).cast("long"), F.greatest(F.lit(size) - F.size(values), F.lit(0))), values)


def overlap(a: Column, b: Column) -> Column:
    """Share of ``a`` that is in ``b``."""
    return F.size(F.array_intersect(a, b)) / F.size(a)
