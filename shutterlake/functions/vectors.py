"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """v / |v|; v as it is when it is next to nothing."""
    n = norm(v)
    return F.when(n <= 1e-8, v).otherwise(F.transform(v, lambda x: x / n))


def literal(v: Sequence[float]) -> Column:
    """A constant vector; folded once, however long."""
    return F.split(F.lit(",".join(repr(float(x)) for x in v)), ",").cast("array<double>")


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(normalize(a), normalize(b))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
