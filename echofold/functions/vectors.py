"""Vector arithmetic as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 127


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def quantised(a: Column, scale: int = SCALE) -> Column:
    """Components times scale, rounded half away from zero and kept within one byte's range."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * scale).cast("int"))))


def distance(a: Column, q: Column, scale: int = SCALE) -> Column:
    """Euclidean distance of a vector and a quantised one."""
    return F.sqrt(total(F.zip_with(a, q, lambda x, y: F.pow(x.cast("double") - y / scale, F.lit(2)))))
