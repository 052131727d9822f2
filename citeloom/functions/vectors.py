"""Column functions over ``array<float>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unequal or zero vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (norms > 0), _dot(a, b) / norms).otherwise(F.lit(0.0))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def fit_dimension(vec: Column, dim: int) -> Column:
    """Cut or zero-pad to ``dim`` values."""
    return (
        F.when(F.size(vec) == dim, vec)
        .when(F.size(vec) > dim, F.slice(vec, 1, dim))
        .otherwise(F.concat(vec, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(vec), F.lit(0)))))
    )


def zero_fallback(vec: Column, dim: int) -> Column:
    return F.coalesce(vec, zeros(dim))


def is_zero(vec: Column) -> Column:
    return ~F.exists(vec, lambda x: x != 0)
