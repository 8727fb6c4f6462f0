"""Functions of dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    length = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") / length)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
