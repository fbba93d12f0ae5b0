"""Guarded arithmetic; missing values are NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_ratio(num: Column, den: Column, least: float = 1e-6, default: float | None = 0.0) -> Column:
    """num / den where den > least, else the default."""
    return F.when(den > least, num / den).otherwise(F.lit(default).cast("double"))


def clip(x: Column, lo: Column | float | None = None, hi: Column | float | None = None) -> Column:
    """x within [lo, hi]; a null stays null."""
    y = x
    if hi is not None:
        y = F.least(y, F.lit(hi) if not isinstance(hi, Column) else hi)
    if lo is not None:
        y = F.greatest(y, F.lit(lo) if not isinstance(lo, Column) else lo)
    return F.when(x.isNotNull(), y)


def cyclic(x: Column, period: float, k: int = 1) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi * k / period) * x
    return F.sin(angle), F.cos(angle)


def logistic(z: Column, bound: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clip(z, -bound, bound)))


def strict_sum(*parts: Column) -> Column:
    """Sum that is null unless all parts are present."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def rounded_up(x: Column, digits: int = 6) -> Column:
    """``rounded`` for values that often stand half-way: these go up whatever the order in which they were summed."""
    return F.round(x + F.lit(1e-9), digits) + F.lit(0.0)
