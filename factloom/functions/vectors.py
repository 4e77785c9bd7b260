"""Vectors of doubles: norm, unit vector and cosine by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Between -1 and 1; 0 for empty, zero, unequal or non-finite vectors."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    c = F.try_divide(dot(a, b), n)
    usable = (F.size(a) == F.size(b)) & (n > 0) & ~F.isnan(n) & (n != float("inf"))
    return F.coalesce(F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))), F.lit(0.0))
