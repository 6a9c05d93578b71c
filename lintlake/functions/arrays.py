"""Running sums inside arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sums(values: Column, first: Column) -> Column:
    """The first value, and its sums with ever more of the values."""
    return F.aggregate(values, F.array(first), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def sums_before(values: Column, block: int = 256) -> Column:
    """For each int of an array the sum of those before it, by blocks, so that no long array is copied for every element."""
    zero = F.lit(0)
    blocks = F.transform(F.sequence(zero, F.floor(F.greatest(F.size(values) - 1, zero) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    totals = _sums(F.transform(blocks, lambda y: F.aggregate(y, zero, lambda s, x: s + x)), zero)
    return F.flatten(F.zip_with(blocks, F.slice(totals, F.lit(1), F.size(totals) - 1), lambda y, t: F.slice(_sums(y, t), F.lit(1), F.size(y))))
