"""Vectors as float arrays; arithmetic in double, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector) -> Column:
    """A query vector; Catalyst folds it into one constant."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(a: Column, b: Column, metric: str = "l2") -> Column:
    """``l2``: 1 - distance, which may be negative; ``cosine``: the cosine."""
    return F.lit(1.0) - l2_distance(a, b) if metric == "l2" else cosine(a, b)


def wire_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def of_dimension(v: Column, n: int) -> Column:
    return F.size(v) == n
