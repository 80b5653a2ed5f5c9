"""Vector arithmetic in DOUBLE as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; elements are widened before they are multiplied."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector divided by its length; zero vectors stay."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def axpy(a: Column, k: float, b: Column) -> Column:
    """a + k * b."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y * F.lit(k))
