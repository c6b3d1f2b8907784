"""Flights and carriers derived from order-line tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.session import remembered, size_shuffles, staged, stored_bytes

SMALL_BYTES = 128 << 20
# what a flight is made of
LINE_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity",
    "l_discount", "l_tax", "l_shipdate",
)


def _clock(minutes: Column) -> Column:
    return (F.floor(minutes / 60) * 100 + minutes % 60).cast("int")


def flights_from_lines(lines: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One flight per order line; the supplier is the aircraft.

    ``FlightId`` is text built from the whole line key, so it stays unique at any
    table size.
    """
    base = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "s_nationkey",
        F.col("l_linenumber").alias("ln"),
        F.col("l_quantity").cast("int").alias("q"),
        F.round(F.col("l_discount") * 100).cast("int").alias("dc"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tx"),
        (F.col("l_partkey") % 10).cast("int").alias("o"),
        (F.col("l_orderkey") % 10).cast("int").alias("d"),
        F.expr("(l_partkey * 7 + l_orderkey * 13 + l_linenumber * 131) % 1080 + 300")
        .cast("int").alias("dep_min"),
        F.expr(
            "date_add(DATE'2008-01-01', datediff(l_shipdate, DATE'1992-01-01') % 120)"
        ).alias("FlightDate"),
    )
    base = base.select(
        "*",
        (150 + 97 * F.col("o") + 61 * F.col("d")).alias("dist"),
        F.when((F.col("ln") == 7) & (F.col("q") < 5), 1).otherwise(0).alias("canc"),
        F.when((F.col("ln") == 5) & (F.col("q") == 1), 1).otherwise(0).alias("divr"),
        (F.col("q") - 15 + F.when(F.col("l_returnflag") == "R", 30).otherwise(0)).alias("dd0"),
    ).select(
        "*",
        (F.floor(F.col("dist") * 2 / 15) + 4 * F.col("d")).cast("int").alias("crs_el"),
        F.when((F.col("ln") == 2) & (F.col("q") == 49), 650)
        .otherwise(F.col("dd0") + F.col("dc") - 5).alias("ad0"),
    )
    flown = (F.col("canc") == 0) & (F.col("divr") == 0)
    departed = F.col("canc") == 0
    arrival = F.col("dep_min") + F.col("crs_el")
    return base.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q")
        .alias("FlightId"),
        (F.col("l_orderkey") * 8 + F.col("ln")).alias("FlightNum"),
        "FlightDate",
        F.year("FlightDate").alias("Year"),
        F.month("FlightDate").alias("Month"),
        F.dayofmonth("FlightDate").alias("DayofMonth"),
        F.when(~((F.col("ln") == 6) & (F.col("q") > 45)),
               F.concat(F.lit("N"), F.col("l_suppkey").cast("string"))).alias("TailNum"),
        F.col("s_nationkey").cast("string").alias("UniqueCarrier"),
        F.concat(F.lit("A"), F.col("o").cast("string")).alias("Origin"),
        F.concat(F.lit("B"), F.col("d").cast("string")).alias("Dest"),
        _clock(F.col("dep_min")).alias("CRSDepTime"),
        _clock(arrival % 1440).alias("CRSArrTime"),
        F.when(flown, _clock((arrival + F.col("ad0") + 1440) % 1440)).alias("ArrTime"),
        F.col("crs_el").alias("CRSElapsedTime"),
        F.when(flown, F.col("crs_el") + F.col("ad0") - F.col("dd0")).alias("ActualElapsedTime"),
        F.when(flown, F.col("ad0")).alias("ArrDelay"),
        F.when(departed, F.col("dd0")).alias("DepDelay"),
        F.when(departed, F.when((F.col("ln") == 1) & (F.col("q") == 50), 0)
               .otherwise(8 + F.col("o") + F.col("tx"))).alias("TaxiOut"),
        F.when(flown, 3 + F.col("d") + F.col("ln") % 3).alias("TaxiIn"),
        F.col("dist").alias("Distance"),
        F.col("canc").alias("Cancelled"),
        F.col("divr").alias("Diverted"),
    )


def table_flights(spark: SparkSession, folder: str) -> DataFrame:
    """The derived flights as a stored table, written once per session."""
    lines, suppliers = f"{folder}/lineitem.parquet", f"{folder}/supplier.parquet"

    def derive() -> DataFrame:
        size_shuffles(spark, (lines,))
        read = spark.read.parquet(lines)
        # a small table may be one file, which would keep all later scans on one core; of a larger
        # one the scan is cut by bytes, and the flights are written as they are read. The lines
        # are spread before they widen, and by key: spreading by turns would sort them first
        if stored_bytes(spark, (lines,)) <= SMALL_BYTES:
            read = read.select(*LINE_COLUMNS).repartition(
                spark.sparkContext.defaultParallelism, "l_orderkey", "l_linenumber")
        return flights_from_lines(read, spark.read.parquet(suppliers))

    sources = (lines, suppliers)
    return remembered(spark, "flights", sources, lambda: staged(spark, "flights", derive, sources))


def table_carriers(spark: SparkSession, folder: str) -> DataFrame:
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    return nation.select(
        F.col("n_nationkey").cast("string").alias("Code"), F.col("n_name").alias("Description")
    )
