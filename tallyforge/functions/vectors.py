"""Vector scalars: dot products, cosine, hashed embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cosine_unit(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in [0, 1]; 0 where a vector is empty or lengths differ."""
    return F.when((F.size(a) <= 0) | (F.size(a) != F.size(b)), 0.0).otherwise(clamp01(dot(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """True cosine in [0, 1]; 0 where a norm is 0 or lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(clamp01(F.try_divide(dot(a, b), norms)))
