"""Aggregate expressions whose result does not depend on the order of rows.

A plain ``avg`` of doubles adds in whatever order tasks finish, so a value near
a rounding boundary may differ from run to run.  Sums of decimals do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,18)"


def odd(column: Column) -> Column:
    """Whether a value is NaN or infinite."""
    number = column.cast("double")
    return F.isnan(number) | (F.abs(number) == float("inf"))


def exact_sum(column: Column) -> Column:
    """Sum as a double, added up with 18 decimals.

    NaN and infinity propagate as in ``sum``; null is left out.  A value or a sum
    of 1e20 or more does not fit, and fails the job rather than going missing.
    """
    apart = F.sum(F.when(odd(column), column.cast("double")))
    return F.coalesce(apart, F.sum(F.when(~odd(column), column).cast(WIDE)).cast("double"))


def exact_mean(column: Column) -> Column:
    """Mean as a double, from ``exact_sum``; null when there is no value."""
    return F.try_divide(exact_sum(column), F.count(column))


def sum_if(condition: Column, column: Column) -> Column:
    """Conditional sum; rows that do not match count as zero."""
    return exact_sum(F.when(condition, column).otherwise(F.lit(0.0)))
