"""Aggregates by route, carrier and airport.

Each table is one ``groupBy().agg()``: a partial aggregate before the shuffle
reduces any hot key to one row per task. Rounding happens here, so that scores,
flags and filters downstream see the rounded figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions import as_flag, clip, one_row, ratio, round_to
from flightops.schema import LIMITS


def _mean(col: str, digits: int = 2) -> Column:
    return round_to(F.avg(col), digits)


def _std(col: str, digits: int = 2) -> Column:
    return round_to(F.stddev_samp(col), digits)


def _percentile(col: str, q: float, approx: bool) -> Column:
    if approx:
        return round_to(F.percentile_approx(col, q, 10_000).cast("double"), 2)
    return round_to(F.percentile(col, F.lit(q)), 2)


def _share(condition: Column, digits: int) -> Column:
    return round_to(F.avg(as_flag(condition).cast("double")), digits)


def _first_distance() -> Column:
    """Distance of the first leg in aircraft order (unknown aircraft last)."""
    order = F.struct(F.col("TailNum").isNull(), "TailNum", "FlightDate", "CRSDepTime", "FlightId")
    return F.min_by("Distance", F.when(F.col("Distance").isNotNull(), order))


def _on_time() -> Column:
    return _share(F.col("ArrDelay") <= LIMITS.late, 3)


def _cancelled() -> Column:
    return _share(F.col("Cancelled").cast("string").isin("YES", "1"), 4)


def _route_aggregates(approx: bool) -> list[Column]:
    return [
        _mean("ArrDelay").alias("AvgArrDelay"),
        _std("ArrDelay").alias("StdArrDelay"),
        _mean("DepDelay").alias("AvgDepDelay"),
        _std("DepDelay").alias("StdDepDelay"),
        _mean("TaxiOut").alias("AvgTaxiOut"),
        _std("TaxiOut").alias("StdTaxiOut"),
        _mean("TaxiIn").alias("AvgTaxiIn"),
        _std("TaxiIn").alias("StdTaxiIn"),
        _mean("AirTimeDeviation").alias("AvgAirTimeDeviation"),
        _std("AirTimeDeviation").alias("StdAirTimeDeviation"),
        _mean("AirTimeDeviationPct").alias("AvgAirTimeDeviationPct"),
        _first_distance().alias("Distance"),
        _mean("ActualElapsedTime").alias("AvgElapsedTime"),
        F.count("FlightNum").alias("FlightCount"),
        _on_time().alias("OnTimeRate"),
        _percentile("TaxiOut", 0.9, approx).alias("P90TaxiOut"),
        _percentile("TaxiIn", 0.9, approx).alias("P90TaxiIn"),
        _cancelled().alias("CancelRate"),
    ]


def route_stats(
    df: DataFrame, min_flights: int = LIMITS.min_route_flights, approx: bool = False
) -> DataFrame:
    """Delay, taxi and air-time statistics by route; ``approx`` for approximate P90."""
    return df.filter(F.col("Route").isNotNull()).groupBy("Route").agg(
        *_route_aggregates(approx)
    ).filter(F.col("FlightCount") >= min_flights)


def route_stats_with_propagation(
    legs: DataFrame, min_flights: int = LIMITS.min_route_flights, approx: bool = False
) -> DataFrame:
    """Statistics and propagation by route, side by side.

    The conditions of the propagation are inside its aggregates, so both families share one
    exchange of the walked legs, and no join aligns them.
    """
    both = legs.filter(F.col("Route").isNotNull()).groupBy("Route").agg(
        *_route_aggregates(approx), *_propagation_aggregates()
    ).filter(F.col("FlightCount") >= min_flights)
    return _propagation_rates(both)


def carrier_stats(df: DataFrame) -> DataFrame:
    return df.filter(F.col("UniqueCarrier").isNotNull()).groupBy("UniqueCarrier").agg(
        _mean("ArrDelay").alias("AvgArrDelay"),
        _std("ArrDelay").alias("StdArrDelay"),
        _mean("DepDelay").alias("AvgDepDelay"),
        _std("DepDelay").alias("StdDepDelay"),
        _mean("TaxiOut").alias("AvgTaxiOut"),
        _mean("TaxiIn").alias("AvgTaxiIn"),
        _mean("AirTimeDeviation").alias("AvgAirTimeDeviation"),
        _mean("AirTimeDeviationPct").alias("AvgAirTimeDeviationPct"),
        F.count("FlightNum").alias("FlightCount"),
        _on_time().alias("OnTimeRate"),
        _cancelled().alias("CancelRate"),
    )


def on_time_rate(df: DataFrame, key: str) -> DataFrame:
    """Share of flights arriving at most 15 minutes late."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(_on_time().alias("OnTimeRate"))


def taxi_p90(df: DataFrame, key: str = "Route", approx: bool = False) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        _percentile("TaxiOut", 0.9, approx).alias("P90TaxiOut"),
        _percentile("TaxiIn", 0.9, approx).alias("P90TaxiIn"),
    )


def cancel_rate(df: DataFrame, key: str) -> DataFrame:
    """Share of cancelled flights.

    After cleaning no cancelled flight is left and the rate is 0; pass the raw
    table (``Cancelled`` 0/1) for the true rate.
    """
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(_cancelled().alias("CancelRate"))


def with_cancel_rate(stats: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Replace ``CancelRate`` by the rate before cleaning."""
    return stats.drop("CancelRate").join(cancel_rate(raw, key), key, "left")


def with_carrier_name(df: DataFrame, carriers: DataFrame, key: str = "UniqueCarrier") -> DataFrame:
    """Carrier name; unknown codes keep a null name.

    No hint: the planner broadcasts the names when their file is small enough.
    """
    names = carriers.select(F.col("Code").alias(key), "Description")
    return df.join(names, key, "left")


# -- propagation ---------------------------------------------------------------

def _propagation_aggregates() -> list[Column]:
    incoming = F.count_if(F.col("PrevFlightDelay") > LIMITS.late)
    return [
        F.sum("DelayPropagated").alias("_passed"),
        F.when(incoming > 0, incoming).alias("FlightsWithIncomingDelay"),
        F.count(F.lit(1)).alias("TotalFlights"),
    ]


def _propagation_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "PropagationRate": round_to(ratio(F.col("_passed"), F.col("TotalFlights") + 1), 3),
        "ConditionalRate": round_to(
            ratio(F.col("_passed"), F.col("FlightsWithIncomingDelay")), 3),
    }).drop("_passed")


def propagation(df: DataFrame, key: str, min_incoming: int | None = None) -> DataFrame:
    """Delay passed on by group: per flight, and per flight with an incoming delay.

    A group without any incoming delay has a null count, not 0.
    """
    stats = _propagation_rates(df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *_propagation_aggregates()))
    stats = stats.select(key, "PropagationRate", "FlightsWithIncomingDelay", "TotalFlights",
                         "ConditionalRate")
    if min_incoming is None:
        return stats
    return stats.filter(F.col("FlightsWithIncomingDelay") >= min_incoming)


def propagation_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        round_to(F.avg("DelayPropagated") * 100, 1).alias("PropagationPct"),
        F.count_if(F.col("PrevFlightDelay") > LIMITS.late).alias("FlightsWithIncomingDelay"),
        F.sum("DelayPropagated").alias("PropagatedDelays"),
        F.count(F.lit(1)).alias("TotalFlights"),
    )


# -- airports ------------------------------------------------------------------

def taxi_out_by_origin(
    df: DataFrame, min_flights: int = LIMITS.min_airport_flights, approx: bool = False
) -> DataFrame:
    return df.filter(F.col("Origin").isNotNull()).groupBy("Origin").agg(
        _mean("TaxiOut").alias("AvgTaxiOut"),
        _std("TaxiOut").alias("StdTaxiOut"),
        _mean("DepDelay").alias("AvgDepDelay"),
        F.count("FlightNum").alias("FlightCount"),
        _percentile("TaxiOut", 0.9, approx).alias("P90TaxiOut"),
        _percentile("TaxiOut", 0.95, approx).alias("P95TaxiOut"),
    ).filter(F.col("FlightCount") >= min_flights)


def taxi_in_by_dest(
    df: DataFrame, min_flights: int = LIMITS.min_airport_flights, approx: bool = False
) -> DataFrame:
    return df.filter(F.col("Dest").isNotNull()).groupBy("Dest").agg(
        _mean("TaxiIn").alias("AvgTaxiIn"),
        _std("TaxiIn").alias("StdTaxiIn"),
        _mean("ArrDelay").alias("AvgArrDelay"),
        F.count("FlightNum").alias("FlightCount"),
        _percentile("TaxiIn", 0.9, approx).alias("P90TaxiIn"),
        _percentile("TaxiIn", 0.95, approx).alias("P95TaxiIn"),
    ).filter(F.col("FlightCount") >= min_flights)


def airtime_by_route(df: DataFrame, min_flights: int = LIMITS.min_route_flights) -> DataFrame:
    """Air time against expectation, with the issue flag (mean or spread too high)."""
    stats = df.filter(F.col("Route").isNotNull()).groupBy("Route").agg(
        _mean("AirTimeDeviation").alias("AvgAirTimeDeviation"),
        _std("AirTimeDeviation").alias("StdAirTimeDeviation"),
        _mean("AirTimeDeviationPct").alias("AvgAirTimeDeviationPct"),
        _std("AirTimeDeviationPct").alias("StdAirTimeDeviationPct"),
        _first_distance().alias("Distance"),
        _mean("ActualElapsedTime").alias("AvgActualTime"),
        _mean("ExpectedAirTime").alias("AvgExpectedTime"),
        F.count("FlightNum").alias("FlightCount"),
    ).filter(F.col("FlightCount") >= min_flights)
    issue = (F.col("AvgAirTimeDeviationPct") > LIMITS.air_time_bottleneck_pct) | (
        F.col("StdAirTimeDeviationPct") > LIMITS.air_time_spread_pct
    )
    return stats.withColumn("HasAirTimeIssue", as_flag(issue))


def turnaround_by_origin(
    df: DataFrame, min_flights: int = LIMITS.min_turnaround_flights, approx: bool = False
) -> DataFrame:
    """Turnaround statistics of legs with a turnaround below 24 hours."""
    hours = F.col("TurnaroundTime")
    usable = df.filter((hours < LIMITS.day_hours) & F.col("Origin").isNotNull())
    tight = F.count(F.when(hours < 1.0, F.col("FlightNum")))
    return usable.groupBy("Origin").agg(
        _mean("TurnaroundTime").alias("AvgTurnaround"),
        _std("TurnaroundTime").alias("StdTurnaround"),
        _mean("TurnaroundInefficiency").alias("AvgInefficiency"),
        _mean("DepDelay").alias("AvgDepDelay"),
        F.count("FlightNum").alias("FlightCount"),
        _percentile("TurnaroundTime", 0.1, approx).alias("P10Turnaround"),
        F.coalesce(round_to(ratio(tight, F.count("FlightNum")), 3), F.lit(0.0))
        .alias("TightTurnaroundRate"),
    ).filter(F.col("FlightCount") >= min_flights)


def turnaround_counts(df: DataFrame) -> DataFrame:
    hours = F.col("TurnaroundTime")
    return df.agg(
        F.count_if(hours < LIMITS.day_hours).alias("turnarounds_under_24h"),
        F.count_if((hours > 0) & (hours < LIMITS.day_hours)).alias("valid_turnarounds"),
        F.count_if(F.col("TurnaroundInefficiency") > 0).alias("tight_turnarounds"),
    )


# -- summaries over the aggregate tables ---------------------------------------

def bottleneck_summary(routes: DataFrame) -> DataFrame:
    flags = {"TaxiOut": "TaxiOutBottleneck", "TaxiIn": "TaxiInBottleneck",
             "AirTime": "AirTimeBottleneck"}
    counted = [F.sum(c).alias(f"{n}Routes") for n, c in flags.items()]
    shares = [round_to(F.avg(c) * 100, 1).alias(f"{n}Pct") for n, c in flags.items()]
    return routes.agg(
        *counted, *shares,
        _mean("AvgTaxiOut", 1).alias("MeanTaxiOut"),
        _mean("AvgTaxiIn", 1).alias("MeanTaxiIn"),
        _mean("AvgAirTimeDeviationPct", 1).alias("MeanAirTimeDeviationPct"),
        F.count_if(F.col("TotalBottlenecks") >= 2).alias("MultipleBottleneckRoutes"),
    )


def bottleneck_by_type(routes: DataFrame) -> DataFrame:
    """Routes hit by each bottleneck, one row per type."""
    sums = routes.agg(
        F.sum("TaxiOutBottleneck").alias("TaxiOut"),
        F.sum("TaxiInBottleneck").alias("TaxiIn"),
        F.sum("AirTimeBottleneck").alias("AirTime"),
    )
    return sums.unpivot([], ["TaxiOut", "TaxiIn", "AirTime"], "Bottleneck", "Routes")


def _mean_excess(df: DataFrame, col: str, name: str) -> DataFrame:
    """Mean of what lies above the lower quartile."""
    quartile = df.agg(F.percentile(col, F.lit(0.25)).alias("_p25"))
    return one_row(df, quartile).agg(
        F.avg(clip(F.col(col) - F.col("_p25"), low=0)).alias(name)
    )


def excess_ground_cost(
    out: DataFrame, inn: DataFrame, flights: int = 10_000_000, per_min: float = 50
) -> DataFrame:
    """Excess taxi minutes per flight and their cost per year in millions."""
    both = one_row(
        _mean_excess(out, "AvgTaxiOut", "_out"), _mean_excess(inn, "AvgTaxiIn", "_in")
    )
    total = F.col("_out") + F.col("_in")
    return both.select(
        round_to(F.col("_out"), 1).alias("ExcessTaxiOut"),
        round_to(F.col("_in"), 1).alias("ExcessTaxiIn"),
        round_to(total, 1).alias("ExcessGroundTime"),
        round_to(total * float(flights) * float(per_min) / 1e6, 1).alias("AnnualCostMillions"),
    )


def bottleneck_category_counts(
    out: DataFrame, inn: DataFrame, air: DataFrame, turn: DataFrame
) -> DataFrame:
    """How many airports or routes are over each limit."""
    def count(df: DataFrame, name: str, condition: Column) -> DataFrame:
        return df.agg(F.count_if(condition).alias("Count")).select(
            F.lit(name).alias("Category"), "Count"
        )

    return (
        count(out, "taxi_out_airports", F.col("AvgTaxiOut") > LIMITS.taxi_out_bottleneck)
        .unionByName(count(inn, "taxi_in_airports",
                           F.col("AvgTaxiIn") > LIMITS.taxi_in_bottleneck))
        .unionByName(count(air, "air_time_routes", F.col("HasAirTimeIssue") == 1))
        .unionByName(count(turn, "tight_turnaround_airports",
                           F.col("TightTurnaroundRate") > LIMITS.tight_rate))
    )


def median_delay(df: DataFrame, key: str, n: int | None = None, approx: bool = False) -> DataFrame:
    """Median arrival delay by group, highest first."""
    median = (
        F.percentile_approx("ArrDelay", 0.5, 10_000).cast("double")
        if approx else F.percentile("ArrDelay", F.lit(0.5))
    )
    stats = df.filter(F.col(key).isNotNull()).groupBy(key).agg(median.alias("MedianArrDelay"))
    ranked = stats.orderBy(F.desc_nulls_last("MedianArrDelay"), key)
    return ranked if n is None else ranked.limit(n)
