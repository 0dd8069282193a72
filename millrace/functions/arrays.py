"""Aggregates over nested arrays: no shuffle, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    """The sum of an array of doubles; null elements count nothing, a null array gives 0."""
    return F.coalesce(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), F.lit(0.0))


def mean(a: Column) -> Column:
    """The mean over all elements; 0 for an empty or null array."""
    return F.coalesce(F.try_divide(total(a), F.nullif(F.size(a), F.lit(0)).cast("double")), F.lit(0.0))


def share_over(a: Column, least: float) -> Column:
    """The share of elements above `least` (strictly); 0 for an empty or null array."""
    over = F.size(F.filter(a, lambda x: x > least)).cast("double")
    return F.coalesce(F.try_divide(over, F.nullif(F.size(a), F.lit(0)).cast("double")), F.lit(0.0))


def inner(a: Column, b: Column) -> Column:
    """The inner product of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def first_argmax(a: Column) -> Column:
    """The 0-based place of the first maximum; null for an empty array."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.try_element_at(F.array_sort(pairs), F.lit(1))["i"]


def normalized_weights(a: Column, kind: str = "normalized", cap: float = 2.0) -> Column:
    """Per-unit weights: uniform, raw, normalized to a mean of 1 (uniform if all are 0), or capped and normalized again."""
    n = F.size(a).cast("double")
    uniform = F.transform(a, lambda x: F.lit(1.0))
    if kind == "uniform":
        return uniform
    if kind == "raw":
        return a
    scaled = F.when(total(a) == 0, uniform).otherwise(F.transform(a, lambda x: x * n / total(a)))
    if kind == "normalized":
        return scaled
    capped = F.transform(scaled, lambda x: F.least(x, F.lit(cap)))
    return F.transform(capped, lambda x: x * n / total(capped))
