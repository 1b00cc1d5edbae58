"""Small column expressions shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """Division that yields NULL on a zero denominator (ANSI mode would raise)."""
    return F.try_divide(c(num), c(den))


def truth(cond: Column) -> Column:
    """A comparison with a missing operand counts as False."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return truth(cond).cast("int")


def either(cond: Column, yes, no) -> Column:
    return F.when(truth(cond), F.lit(yes)).otherwise(F.lit(no))


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = c(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def grid(x, digits: int) -> Column:
    """Round half up on the binary value; the same steps give the same bits in any engine."""
    scale = float(10**digits)
    return F.floor(c(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def signal_of(p) -> Column:
    p = c(p)
    return F.when(p > 0.6, "BUY").when(p < 0.4, "SELL").otherwise("HOLD")


def confidence_of(p) -> Column:
    return F.abs(c(p) - F.lit(0.5)) * F.lit(2.0)
