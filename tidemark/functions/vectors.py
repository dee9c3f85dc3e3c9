"""Columns on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine cut to 0..1; 0 for vectors of different length or without direction."""
    size = norm(a) * norm(b)
    value = F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))
