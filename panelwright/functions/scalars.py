"""Scalar functions under one rule: no NaN or infinity enters a frame, only NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def finite(x: Column) -> Column:
    """x, NULL if NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def number(x: Column) -> Column:
    """x as a double, NULL where it isn't a finite number."""
    return finite(F.try_cast(x, "double") if hasattr(F, "try_cast") else x.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def safe_div(a: Column, b: Column) -> Column:
    """NULL where the denominator is within TINY of 0."""
    return F.when(F.abs(b) > TINY, F.try_divide(a, b))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def minimum(a: Column, b: Column) -> Column:
    """NULL if either is (least() would skip it)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(x, F.lit(float(high)))))
