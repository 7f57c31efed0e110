"""Percentiles by floored rank, clamps and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def floor_rank(n: Column, p: float) -> Column:
    """The 1-based rank of percentile ``p`` among ``n`` sorted values: element floor(n * p) from 0, the last at most."""
    return F.least(F.floor(n * F.lit(p)), n - 1) + 1


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))
