"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, as far as both reach, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty or zero or lengths differ."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def cosine_zipped(a: Column, b: Column) -> Column:
    """Products as far as both reach, over the whole norms; 0 where one is zero."""
    size = norm(a) * norm(b)
    return F.when(F.coalesce(size, F.lit(0.0)) == 0, 0.0).otherwise(dot(a, b) / size)


def mean(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def literal(vector: list[float]) -> Column:
    """One row's vector, sent with the plan."""
    return F.array(*(F.lit(float(x)) for x in vector))
