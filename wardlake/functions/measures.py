"""Arithmetic shared by views and dashboard queries."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column, F.lit(0))


def total(*names: str) -> Column:
    """Row total in which a missing term counts as zero."""
    return reduce(add, (or_zero(name) for name in names))


def ratio(numerator: Column, denominator: Column, scale: int) -> Column:
    """Decimal quotient rounded half up to ``scale`` digits; NULL over zero."""
    return F.try_divide(numerator, denominator).cast(f"decimal(18,{scale})")


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL unless the denominator is above zero."""
    above = denominator.cast("double")
    return F.when(above > 0, F.try_divide(numerator.cast("double"), above))


def mean(value: Column | str) -> Column:
    """Average of a decimal or integer column as one exact sum over a count.

    Summing before the change to double makes the result independent of the
    order in which partitions are merged.
    """
    column = F.col(value) if isinstance(value, str) else value
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def month_of(day: Column | str) -> Column:
    return F.trunc(day, "month")


def month_label(month: Column | str) -> Column:
    return F.date_format(month, "yyyy-MM")


def month_begins_back(day: Column, months: int) -> Column:
    """Step back over ``months`` month starts; the first step only reaches this month's start."""
    first = F.trunc(day, "month")
    return F.when(day == first, F.add_months(first, -months)).otherwise(
        F.add_months(first, 1 - months)
    )


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
