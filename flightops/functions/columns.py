"""Null-safe column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(col: Column, low=None, high=None) -> Column:
    """Bound a column and keep null as null (``least``/``greatest`` skip nulls)."""
    bounded = col
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low).cast("double"))
    if high is not None:
        bounded = F.least(bounded, F.lit(high).cast("double"))
    return F.when(col.isNotNull(), bounded)


def round_to(col: Column, digits: int) -> Column:
    """Round half to even in binary floating point."""
    scale = 10.0**digits
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def as_flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null on a zero divisor instead of an ANSI error."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def hhmm_to_minutes(col: Column) -> Column:
    """Clock integer such as 1430 to minutes after midnight."""
    return (F.floor(col / F.lit(100)) * 60 + col % 100).cast("int")


def one_row(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (always exactly one row).

    They come as a scalar subquery: computed once, then a constant in every task.
    """
    names = thresholds.columns
    row = thresholds.select(F.struct(*names).alias("_row")).scalar()
    return df.withColumns({name: row.getField(name) for name in names})
