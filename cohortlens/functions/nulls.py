"""Missing-value rules of the study, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that stays null when the condition is null."""
    return F.when(cond, yes).when(~cond, no)


def strict_sum(column: Column) -> Column:
    """Sum that is null as soon as one input of the group is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def to_number(column: Column, kind: str = "double") -> Column:
    """Cast that gives null for text that is not a number."""
    return column.try_cast(kind)


def ratio(num: Column, den: Column) -> Column:
    """Division as doubles, null for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def distinct_tuples(*columns) -> Column:
    """Distinct count over a tuple in which null counts as a value."""
    return F.count_distinct(F.struct(*columns))
