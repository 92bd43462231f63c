"""Vector arithmetic on array columns (JVM side, higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def scale(v: Column, divisor: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / divisor)


def normalize(v: Column, floor: float = NORM_FLOOR) -> Column:
    """Unit vector in double precision; the norm is floored so that a zero vector stays zero."""
    # The norm is computed once per row through a one-element array, not once per component.
    packed = F.array(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(floor)).alias("n")))
    return F.element_at(F.transform(packed, lambda s: scale(s["v"], s["n"])), 1)
