"""Aggregate expressions whose null rules differ from plain Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sum0(value: ColumnOrName) -> Column:
    """Sum that is 0, not null, for an empty or all-null group."""
    return F.coalesce(F.sum(value), F.lit(0))


def n_unique(value: ColumnOrName) -> Column:
    """Distinct count in which null is one more value."""
    column = as_column(value)
    has_null = F.coalesce(F.max(F.when(column.isNull(), 1).otherwise(0)), F.lit(0))
    return (F.count_distinct(column) + has_null).cast("bigint")


def exact_mean(value: ColumnOrName) -> Column:
    """Mean as exact sum over count.

    For integers and decimals the sum is exact, so the result does not depend
    on the order in which partial sums arrive.
    """
    column = as_column(value)
    return F.try_divide(F.sum(column).cast("double"), F.count(column))


def divide(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Double division that gives null for a zero or null denominator."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def share_of_all(amount: ColumnOrName) -> Column:
    """An amount over the sum of all rows.

    For totals per group only: the rows meet in one task, and there is one row
    per group.
    """
    column = as_column(amount)
    return divide(column, F.sum(column).over(Window.partitionBy()))
