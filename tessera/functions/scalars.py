"""Lenient casts and guards for loosely typed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# What counts as true.
TRUE_WORDS = ("1", "true", "yes", "y", "on")


def clean(c: Column) -> Column:
    """Trimmed, with white space runs as one blank; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def loose_float(c: Column) -> Column:
    """A number from trimmed text, or null; suffixes such as '1d' aren't numbers."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def loose_bool(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*TRUE_WORDS)


def clamp01(c: Column) -> Column:
    """Within 0 and 1; null as 0, NaN stays."""
    v = F.coalesce(c, F.lit(0.0))
    return F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def string_list(c: Column, most: int) -> Column:
    """Cleaned, not blank, each once in order of first sight, the first ``most``."""
    items = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean), lambda x: x != "")
    return F.slice(F.array_distinct(items), 1, most)


def string_set(c: Column) -> Column:
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def safe_divide(a: Column, b: Column) -> Column:
    """Null when the divisor is zero or either side is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite_or_zero(c: Column) -> Column:
    v = loose_float(c)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
