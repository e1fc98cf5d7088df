"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    """L2 norm; 0 for null and for the empty array."""
    return F.coalesce(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for null or empty arrays, different sizes and zero norms."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (magnitude(a) > 0) & (magnitude(b) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot / (magnitude(a) * magnitude(b))).otherwise(F.lit(0.0))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two distributions, base 2; 0 for null, empty and unequal arrays."""

    def part(x: Column, y: Column) -> Column:
        mid = (x + y) / 2
        return F.when((x > 0) & (mid > 0), x * F.log2(x / mid)).otherwise(F.lit(0.0))

    total = _sum(F.zip_with(p, q, lambda x, y: 0.5 * part(x, y) + 0.5 * part(y, x)))
    return F.when(F.coalesce((F.size(p) > 0) & (F.size(p) == F.size(q)), F.lit(False)), total).otherwise(F.lit(0.0))
