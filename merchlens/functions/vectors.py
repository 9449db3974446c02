"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero, so such rows rank with unrelated ones."""
    raw = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(raw, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """R16. 1 - cosine clamped to [0, 2]; 1.0 for a zero vector."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - cosine(a, b)))
    return F.coalesce(raw, F.lit(1.0))


def vector_problem(a: Column, dim: int, tolerance: float = 1e-3) -> Column:
    """R15. First failing check of a vector, NULL when it is usable."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(a.isNull(), F.lit("missing"))
        .when(F.size(a) != dim, F.lit("dimension"))
        .when(bad, F.lit("not finite"))
        .when(norm(a) == 0, F.lit("zero"))
        .when(F.abs(norm(a) - 1.0) > tolerance, F.lit("not unit"))
    )
