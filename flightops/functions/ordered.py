"""Positions, running totals and exact quantiles over many rows or distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightops.functions.columns import one_row
from flightops.session import staged

CELL_ROWS = 1 << 17  # rows of a cell, about; a cell is one task


def with_position(
    df: DataFrame, keys: list[str], name: str, parts: int | None = None
) -> DataFrame:
    """Add the position of each row in the order of ``keys``, from 0.

    No row is numbered in one task: the rows are range-partitioned by splitters that Spark
    samples, sorted and stored with their place in the range, and the counts of the ranges
    before it (one row per range) are added. ``keys`` should be unique; rows of equal keys
    stay in one range.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = staged(spark, "ordered", lambda: df.repartitionByRange(
        parts, *keys).sortWithinPartitions(*keys).withColumns({
            "_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = stored.groupBy("_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return stored.join(shifts, "_part").withColumn(
        name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def running_totals(
    df: DataFrame, by: str, sums: list[str], cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Add ``<name>_before``: the total of each column over rows with a smaller ``by``.

    ``by`` must be distinct. A window over all rows would run in one task, so the values are cut
    into cells by quantiles that Spark samples: equal shares of the rows, however close their
    values lie. A window runs inside each cell, one over the totals of the cells. Runs jobs: one
    counts the rows, one stores them if there is more than one cell.
    """
    earlier = (Window.unboundedPreceding, -1)

    def before(window: Window, name: str):
        return F.coalesce(F.sum(name).over(window.rowsBetween(*earlier)), F.lit(0))

    # half as many rows on average, so that uneven samples stay below the size
    cells = -(-2 * df.count() // cell_rows)
    if cells <= 2:
        return df.withColumns({f"{c}_before": before(Window.orderBy(by), c) for c in sums})
    cut = staged(df.sparkSession, "cells", lambda: df.repartitionByRange(cells, by).withColumn(
        "_cell", F.spark_partition_id()))
    totals = cut.groupBy("_cell").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select("_cell", *[
        before(Window.orderBy("_cell"), c).alias(f"_o_{c}") for c in sums])
    in_cell = Window.partitionBy("_cell").orderBy(by)
    local = cut.withColumns({f"_r_{c}": before(in_cell, c) for c in sums})
    return local.join(offsets, "_cell").select(
        *df.columns, *[(F.col(f"_r_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums]
    )


def exact_quantiles(df: DataFrame, col: str, quantiles: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles of a column.

    Works on counts of distinct values and never gathers the values in one task.
    """
    # several steps read the counts: stored, so that the rows are scanned once
    counts = staged(
        df.sparkSession, "values",
        lambda: df.filter(F.col(col).isNotNull()).groupBy(col)
        .agg(F.count(F.lit(1)).alias("_n")),
    )
    ranked = running_totals(counts, col, ["_n"])
    total = counts.agg(F.sum("_n").alias("_total"))
    picked = one_row(ranked, total)

    def at(rank):
        hit = (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(hit, F.col(col)))

    found = []
    for name, q in quantiles.items():
        place = (F.col("_total") - 1) * F.lit(float(q))
        found += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_part_{name}"),
        ]
    return picked.agg(*found).select(*[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
        for n in quantiles
    ])
