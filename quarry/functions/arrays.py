"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dedupe_ignoring_case(values: Column) -> Column:
    """Stripped values without blanks; of those that differ in case only, the first stays."""
    own = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(own, lambda x: F.lower(x))
    return F.filter(own, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def first_by(items: Column, key: str) -> Column:
    """Of structs with the same key, the first stays."""
    first = lambda own, keys: F.filter(own, lambda x, i: F.array_position(keys, x[key]) == i + 1)
    return let(items, lambda own: let(F.transform(own, lambda x: x[key]), lambda keys: first(own, keys)))


def joined(values: Column, separator: str, prefix: str = "") -> Column:
    """prefix and the joined values; null for an empty or null array."""
    return F.when(F.size(F.coalesce(values, F.array())) > 0, F.concat(F.lit(prefix), F.array_join(values, separator)))
