"""Vector expressions over arrays of floats, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different lengths or without length."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), F.lit(0.0)).otherwise(dot(a, b) / length)


def score(similarity: Column) -> Column:
    """The reported score of a hit: 1 minus a distance of (1 - cosine) / 2."""
    return (F.lit(1.0) + similarity) / 2


def checked(vector: Column, dimensions: int) -> Column:
    """The vector; the query fails if it has another length."""
    return F.when(F.assert_true(F.size(vector) == dimensions, F.lit(f"vectors need {dimensions} dimensions")).isNull(), vector)
