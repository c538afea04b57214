"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(3.6e9)


def stepped(value: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """The first step's value whose limit is not passed."""
    out = F.when(value <= steps[0][0], steps[0][1])
    for limit, x in steps[1:]:
        out = out.when(value <= limit, x)
    return out.otherwise(beyond)


def level_weight(level: Column, strong: float = 1.0, medium: float = 0.7, weak: float = 0.4) -> Column:
    return F.when(level == "strong", strong).when(level == "medium", medium).otherwise(weak)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def lowered(c: Column) -> Column:
    return F.array_distinct(F.transform(c, F.lower))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two maps key -> weight: sum of the smaller over sum of the larger weights; 0 without a shared key."""
    low = F.map_zip_with(a, b, lambda k, x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    high = F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    over = total(F.map_values(high))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (over == 0), 0.0).otherwise(total(F.map_values(low)) / over)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for a null, empty, zero or differently long vector."""
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    size = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(~usable | (size == 0), 0.0).otherwise(dot / size)
