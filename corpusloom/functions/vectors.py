"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_vector(v: Column, dim: int) -> Column:
    """``dim`` finite numbers: cut or padded with zeros; what is null, not a number or infinite becomes 0; a null vector is all zeros."""
    clean = F.transform(F.coalesce(v, F.array().cast("array<double>")).cast("array<double>"), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    return F.slice(F.concat(clean, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))
