"""Time-ordered split and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightops.functions import one_row, ratio, round_to
from flightops.functions.ordered import with_position

_EPOCH = "2000-01-01"


def _day() -> Column:
    return F.datediff("FlightDate", F.lit(_EPOCH).cast("date"))


def split_day(df: DataFrame, q: float = 0.75) -> DataFrame:
    """Day number (since 2000-01-01) at quantile ``q``, interpolated; one row.

    Legs are counted per date first, so the one task of the percentile sees one row per
    calendar day.
    """
    days = df.groupBy("FlightDate").agg(F.count(F.lit(1)).alias("_n"))
    return days.agg(F.percentile(_day(), F.lit(q), F.col("_n")).alias("split_day"))


def temporal_split(df: DataFrame, q: float = 0.75) -> DataFrame:
    """``split`` = train before the quantile day, test from it on."""
    return one_row(df, split_day(df, q)).withColumn(
        "split", F.when(_day() < F.col("split_day"), "train").otherwise("test")
    ).drop("split_day")


def split_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.min("FlightDate").alias("first_date"),
        F.max("FlightDate").alias("last_date"),
        F.count(F.lit(1)).alias("legs"),
        round_to(F.avg("CausedCascade") * 100, 2).alias("cascade_pct"),
    )


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows per label and the share of each in percent."""
    counts = df.groupBy("CausedCascade").agg(F.count(F.lit(1)).alias("legs"))
    total = counts.agg(F.sum("legs").alias("_total"))
    return one_row(counts, total).select(
        "CausedCascade", "legs",
        round_to(ratio(F.col("legs"), F.col("_total")) * 100, 2).alias("pct"),
    )


def with_time_index(
    df: DataFrame, name: str = "TimeIndex", parts: int | None = None
) -> DataFrame:
    """Position of each row in date, clock, id order, from 0.

    The rows are stored in this order in ``parts`` ranges, so this runs a job. The splitters of
    the ranges are sampled from all three columns: a minute with many legs is cut between ids.
    """
    return with_position(df, ["FlightDate", "CRSDepTime", "FlightId"], name, parts)


def time_series_folds(df: DataFrame, k: int = 5, index: str = "TimeIndex") -> DataFrame:
    """``ValFold``: the fold a row validates, 0 for rows that only train.

    The last ``k`` blocks of ``n // (k + 1)`` rows are the validation parts; fold f
    trains on all rows with a smaller ``ValFold``. No row is copied.
    """
    size = df.agg(F.count(F.lit(1)).alias("_n")).select(
        "_n", F.floor(F.col("_n") / (k + 1)).alias("_size")
    )
    start = F.col("_n") - k * F.col("_size")
    block = F.floor(ratio(F.col(index) - start, F.col("_size"))).cast("int") + 1
    return one_row(df, size).withColumn(
        "ValFold", F.when((F.col(index) >= start) & (F.col("_size") > 0), block).otherwise(0)
    ).drop("_n", "_size")


def fold_profile(folds: DataFrame, index: str = "TimeIndex") -> DataFrame:
    """Rows and index range of every validation part, and the rows it trains on."""
    parts = folds.groupBy("ValFold").agg(
        F.count(F.lit(1)).alias("val_rows"),
        F.min(index).alias("first_index"),
        F.max(index).alias("last_index"),
    )
    before = Window.orderBy("ValFold").rowsBetween(Window.unboundedPreceding, -1)  # k + 1 rows
    return parts.withColumn(
        "train_rows", F.coalesce(F.sum("val_rows").over(before), F.lit(0))
    ).filter(F.col("ValFold") > 0)
