"""Expressions on arrays of numbers, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, floor: float = 1e-12) -> Column:
    """``a`` scaled to length 1; lengths are taken to be ``floor`` at least.

    The length is bound once, as the one element of an array: inside the lambda it would be found anew for every element.
    """
    length = F.array(F.greatest(norm(a), F.lit(floor)))
    return F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def min_max(x: Column, low: Column, high: Column, floor: float = 1e-8) -> Column:
    """``x`` scaled to 0..1 between ``low`` and ``high``; a flat range gives 0."""
    return (x - low) / F.greatest(high - low, F.lit(floor))
