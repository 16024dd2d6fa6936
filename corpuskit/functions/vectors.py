"""Vector column functions. Stored as array<float>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuskit.functions.text import _c


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(vector: Column | str) -> Column:
    vector = _c(vector)
    return F.sqrt(_dot(vector, vector))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return F.lit(1.0) - _dot(a, b) / (norm(a) * norm(b))


def round_vector(vector: Column | str, places: int = 7) -> Column:
    return F.transform(_c(vector), lambda x: F.round(x.cast("double"), places))


def profile(vector: Column | str) -> Column:
    """Length, L2 norm, extremes and a unit-norm flag."""
    vector = _c(vector)
    length = norm(vector)
    return F.struct(
        F.size(vector).alias("dim"),
        length.alias("norm"),
        F.array_min(vector).cast("double").alias("smallest"),
        F.array_max(vector).cast("double").alias("largest"),
        (F.abs(length - 1.0) < 1e-3).alias("is_unit"),
    )
