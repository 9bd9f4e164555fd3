"""Vector expressions (F3): dot products, norms, cosines, combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 where lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at unit length; zero stays zero."""
    return F.element_at(F.transform(F.array(a), lambda t: F.element_at(F.transform(F.array(norm(t)), lambda n: F.when(n > 0, F.transform(t, lambda x: x / n)).otherwise(t)), 1)), 1)


def combined(a: Column, b: Column, of_a: float, of_b: float) -> Column:
    """The unit vector along a weighted sum; zero stays zero."""
    return unit(F.zip_with(a, b, lambda x, y: x * of_a + y * of_b))
