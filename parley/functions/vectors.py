"""Vector arithmetic as Columns on ARRAY<DOUBLE>/ARRAY<FLOAT>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: str | Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    # as the one entry of an array the norm is worked out once a vector, not once an entry
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(col(v), lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))), F.lit(0))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_valid(v: str | Column, size: int) -> Column:
    """Right length and every entry finite."""
    v = col(v)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & finite, F.lit(False))
