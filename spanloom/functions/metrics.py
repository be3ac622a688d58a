"""Ratios and their conventions for empty denominators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def prf(tp: Column, predicted: Column, support: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    return ratio(tp, predicted), ratio(tp, support), ratio(2 * tp, predicted + support)


def harmonic_mean(a: Column, b: Column) -> Column:
    """0 if either is 0; null for negative or not finite values."""
    bad = (a < 0) | (b < 0) | F.isnan(a) | F.isnan(b)
    return F.when(bad, None).otherwise(ratio(2 * a * b, a + b))


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def softmax(x: Column) -> Column:
    """Of an array; the largest value is taken off first."""
    shifted = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(shifted, lambda v: v / total)


def argmax(x: Column) -> Column:
    """Position from 0 of the first largest value."""
    return F.array_position(x, F.array_max(x)) - 1
