"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightops.session import session_folder, staged

# fixed: the characters that separate words
SPACES = " \t\n\x0b\f\r"
WORD = r"[^ \t\n\x0B\f\r]+"
# stored frames whose plans the driver keeps, about 0.3 MB each; changes no result
RECENT = 16


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back."""
    return staged(df.sparkSession, name, lambda: df, recent=RECENT)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files of this session."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def number_of_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows in the order of ``keys``, range-partitioned, written and read back.

    ``row`` ascends in that order and is without gaps inside each ``part``. Rows of equal keys
    may be cut between parts, so that no key makes a large task.
    """
    fixed = stored(rows.withColumn("tie", F.monotonically_increasing_id()), name)
    order = [*keys, "tie"]
    ranged = fixed.repartitionByRange(number_of_tasks(rows.sparkSession), *order)
    return stored(ranged.sortWithinPartitions(*order).drop("tie").withColumns({
        "part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        f"{name}-dealt")


def without_gaps(dealt: DataFrame) -> DataFrame:
    """Rows as dealt in order, with ``row`` as the position among all of them, without ``part``."""
    # one row per part
    counted = dealt.groupBy("part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(F.col("part").alias("in_part"), (
        F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    joined = dealt.join(starts, F.col("part") == F.col("in_part"))
    return joined.withColumn("row", F.col("row") + F.col("shift")).drop("part", "in_part", "shift")


def placed(rows: DataFrame, group: str, keys: list[str], name: str) -> DataFrame:
    """``place`` (from 0) of each row in its group by ``keys``, and the ``total`` of the group.

    The parts of the order give the places: no group is numbered in one task.
    """
    dealt = dealt_in_order(rows, [group, *keys], name)
    # one row per group and part
    counted = dealt.groupBy(group, "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        F.col(group).alias("of"), F.col("part").alias("in_part"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(of_group).alias("total"))
    joined = dealt.join(starts, (F.col(group) == F.col("of")) & (F.col("part") == F.col("in_part")))
    return joined.withColumn("place", F.col("row") + F.col("shift")).drop(
        "of", "in_part", "part", "row", "shift")
