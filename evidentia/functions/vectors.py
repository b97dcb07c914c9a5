"""Vector expressions over arrays; products and sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    return F.transform(doubles(v), lambda x: F.coalesce(F.try_divide(x, norm(v)), x))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def percent(score: Column, clamped: bool = False) -> Column:
    """A score as whole percent, cut, not rounded."""
    whole = (score * 100).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), whole)) if clamped else whole
