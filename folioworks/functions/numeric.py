"""Numbers that come out the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(c: Column, n: int) -> Column:
    """Half-up rounding by way of decimal(18,9), as a double: independent of summing order and of the engine."""
    return F.round(c.cast("decimal(18,9)"), n).cast("double")


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def exact_sum(c: Column) -> Column:
    """A sum that no order of its addends changes."""
    return F.sum(c.cast("decimal(28,9)"))


def exact_avg(c: Column, n: int) -> Column:
    total, count = exact_sum(c), F.count(c)
    return F.round(F.when(count > 0, total.cast("double") / count).cast("decimal(18,9)"), n).cast("double")
