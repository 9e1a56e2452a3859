"""Number and date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(c: Column, digits: int) -> Column:
    """Scale, round half to even, unscale: the rounding numpy and pandas use."""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


#: Zeros and values between these sizes are added exactly, with 18 decimals; 1e11 of them fit the sum.
EXACT_FROM, EXACT_BELOW = 1e-3, 1e9


def fixed_sum(c: Column) -> Column:
    """Sum that does not depend on row order for values from ``EXACT_FROM`` to ``EXACT_BELOW``, so that a
    retried or differently split task cannot change it; others, which 18 decimals would cut, are added as doubles."""
    value = c.cast("double")
    small = (value == 0) | ((F.abs(value) >= EXACT_FROM) & (F.abs(value) < EXACT_BELOW))
    exact = F.sum(F.when(small, value.cast("decimal(28,18)"))).cast("double")
    rest = F.sum(F.when(~small, value))
    return F.when(exact.isNull(), rest).when(rest.isNull(), exact).otherwise(exact + rest)


def fixed_mean(c: Column) -> Column:
    """Mean by ``fixed_sum``."""
    return fixed_sum(c) / F.count(c)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return round_even(part.cast("double") / whole * F.lit(100.0), digits)


def month_start(c: Column) -> Column:
    return F.trunc(c.cast("date"), "month")
