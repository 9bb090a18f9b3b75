"""Intervals and vectors, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hull_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over hull, as used to drop overlapping hits."""
    inter = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return inter / (F.greatest(a1, b1) - F.least(a0, b0) + 1e-9)


def ordered_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union; end points are put in order first, empty unions give 0."""
    la, ha, lb, hb = F.least(a0, a1), F.greatest(a0, a1), F.least(b0, b1), F.greatest(b0, b1)
    inter = F.greatest(F.lit(0.0), F.least(ha, hb) - F.greatest(la, lb))
    union = (ha - la) + (hb - lb) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    """In double precision, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_valid(a: Column) -> Column:
    """Whether a vector's squared norm exceeds 1e-10."""
    return F.coalesce(dot(a, a) > 1e-10, F.lit(False))


def unit(a: Column) -> Column:
    """Length 1; null for a vector of zeros."""
    n = norm(a)
    # the norm stands outside of the lambda, or it would be computed for each element
    return F.when(n > 0, F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, m: x.cast("double") / m))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))
