"""Every registered query: name -> function of (spark, folder of the tables).

the limits (100 flights per route and so on) are the defaults of the operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.functions import one_row, round_to
from flightops.operators import clean as C
from flightops.operators import evaluate as E
from flightops.operators import features as X
from flightops.operators import metrics as M
from flightops.operators import rotation as R
from flightops.operators import scores as S
from flightops.operators import serving as V
from flightops.operators import split as P
from flightops.operators import tiers as T
from flightops.operators import training as L
from flightops.plans import descriptive as D
from flightops.plans import predictive as Q
from flightops.schema import FEATURES, HISTORY, LIMITS
from flightops.session import remembered, session_folder, source_key, staged
from flightops.sources import read_carriers, read_flight_rejects, read_flights
from flightops.sources import requests as I
from flightops.sources import sinks as K
from flightops.sources.sinks import load_model, save_model
from flightops.sources.tables import table_carriers, table_flights
from flightops.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        return function
    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- inputs --------------------------------------------------------------------

def _sources(folder: str) -> tuple[str, ...]:
    return f"{folder}/lineitem.parquet", f"{folder}/supplier.parquet"


def _once(build):
    """``build(spark, folder)``, planned once per session and state of the tables."""
    @wraps(build)
    def found(spark, folder):
        sources = (*_sources(folder), f"{folder}/nation.parquet")
        return remembered(spark, build.__name__, sources, lambda: build(spark, folder))
    return found


def _measured(spark, folder) -> DataFrame:
    return D.measured(table_flights(spark, folder))


def _rotated(spark, folder, **options) -> DataFrame:
    return D.rotated(table_flights(spark, folder), **options)


@_once
def _walked(spark, folder) -> DataFrame:
    """Rotated legs, walked once per session."""
    return D.rotated_legs(table_flights(spark, folder), sources=_sources(folder))


@_once
def _routes(spark, folder) -> DataFrame:
    return D.route_table(_measured(spark, folder), sources=_sources(folder))


@_once
def _carriers(spark, folder) -> DataFrame:
    return D.carrier_table(
        _measured(spark, folder), table_carriers(spark, folder), sources=_sources(folder)
    )


@_once
def _taxi(spark, folder) -> tuple[DataFrame, DataFrame]:
    return D.taxi_tables(_measured(spark, folder), sources=_sources(folder))


def _cascade(spark, folder) -> DataFrame:
    return C.clean_cascade(table_flights(spark, folder))


@_once
def _legs(spark, folder) -> DataFrame:
    return Q.labelled_legs(table_flights(spark, folder), sources=_sources(folder))


def _engineered(spark, folder) -> DataFrame:
    return X.engineer(_legs(spark, folder))


def _train(spark, folder) -> DataFrame:
    return _legs(spark, folder).filter(F.col("split") == "train")


def _timed(legs: DataFrame, *cols: str) -> DataFrame:
    """What a time index orders by, and ``cols``: all columns would be shuffled and stored."""
    return legs.select("FlightDate", "CRSDepTime", "FlightId", *cols)


@_once
def _prepared(spark, folder) -> Q.Prepared:
    return Q.prepare(table_flights(spark, folder), sources=_sources(folder))


def _six(df: DataFrame, *cols: str) -> DataFrame:
    """Round sums whose last digits depend on the order of addition."""
    return df.withColumns({c: round_to(F.col(c), 6) for c in cols})


def _plain_score() -> Column:
    """A fixed score, so that the evaluation does not depend on a trained model."""
    z = (F.lit(0.05) * F.col("IncomingDelay") + F.lit(0.5) * F.col("TightTurnaround")
         - F.lit(0.1) * F.col("PositionInRotation") - F.lit(0.5))
    return round_to(1 / (1 + F.exp(-z)), 4)


def _scored(spark, folder, part: str = "test") -> DataFrame:
    rows = _prepared(spark, folder).unfilled.filter(F.col("split") == part)
    return rows.withColumn(E.SCORE, _plain_score()).withColumn(
        E.PRED, (F.col(E.SCORE) >= 0.5).cast("int")
    )


# -- cleaning ------------------------------------------------------------------

@query("cln01_split_cancelled")
def _(spark, folder):
    kept, cancelled = C.split_cancelled(table_flights(spark, folder))
    return kept.select("FlightId", F.lit("kept").alias("part")).unionByName(
        cancelled.select("FlightId", F.lit("cancelled").alias("part"))
    )


@query("cln02_drop_diverted")
def _(spark, folder):
    return C.drop_diverted(table_flights(spark, folder)).select("FlightId")


@query("cln03_require_tail")
def _(spark, folder):
    return C.require_tail(table_flights(spark, folder)).select("FlightId", "TailNum")


@query("cln04_required_fields_ops")
def _(spark, folder):
    return table_flights(spark, folder).dropna(subset=list(C.REQUIRED_OPS)).select("FlightId")


@query("cln05_required_fields_cascade")
def _(spark, folder):
    return table_flights(spark, folder).dropna(subset=list(C.REQUIRED_CASCADE)).select("FlightId")


@query("cln06_clean_ops")
def _(spark, folder):
    return C.clean_ops(table_flights(spark, folder)).select(
        "FlightId", "TaxiOut", "TaxiIn", "ArrDelay", "DepDelay", "Distance", "ActualElapsedTime"
    )


@query("cln07_clean_cascade")
def _(spark, folder):
    return _cascade(spark, folder).select(
        "FlightId", "TailNum", "ArrDelay", "DepDelay", "CRSDepTime", "CRSArrTime", "Distance"
    )


@query("cln08_flight_date")
def _(spark, folder):
    # a day of 31 in every month, so that bad dates occur
    flights = table_flights(spark, folder).withColumn(
        "DayofMonth", F.when(F.col("DayofMonth") > 28, 31).otherwise(F.col("DayofMonth"))
    )
    return C.with_flight_date(flights, replace=True).select("FlightId", "FlightDate")


@query("cln09_day_number")
def _(spark, folder):
    return C.with_day_number(table_flights(spark, folder)).select("FlightId", "FlightDate_Numeric")


@query("cln10_coerce_numeric")
def _(spark, folder):
    text = table_flights(spark, folder).withColumn(
        "ArrDelay", F.coalesce(F.col("ArrDelay").cast("string"), F.lit("NA"))
    )
    return C.coerce_numeric(text, ("ArrDelay", "TaxiOut")).select("FlightId", "ArrDelay", "TaxiOut")


@query("cln11_cleaning_report_ops")
def _(spark, folder):
    return C.cleaning_report(table_flights(spark, folder))


@query("cln11_cleaning_report_cascade")
def _(spark, folder):
    return C.cleaning_report(table_flights(spark, folder), "cascade")


@query("cln12_survivor_label")
def _(spark, folder):
    return C.clean_ops(table_flights(spark, folder)).groupBy("Cancelled").agg(
        F.count(F.lit(1)).alias("flights")
    )


# -- row projections -----------------------------------------------------------

@query("prj01_03_airtime")
def _(spark, folder):
    return _measured(spark, folder).select(
        "FlightId", "ExpectedAirTime", "AirTimeDeviation", "AirTimeDeviationPct"
    )


@query("prj04_route")
def _(spark, folder):
    return C.with_route(table_flights(spark, folder)).groupBy("Route").agg(
        F.count(F.lit(1)).alias("flights")
    )


@query("prj05_turnaround_penalty")
def _(spark, folder):
    return _rotated(spark, folder).select("FlightId", "TurnaroundInefficiency")


@query("prj06_temporal_features")
def _(spark, folder):
    return X.temporal_features(_cascade(spark, folder)).select(
        "FlightId", "Hour", "DayOfWeek", "Month", "IsWeekend", "IsRushHour", "IsEarlyMorning",
        "IsLateNight",
    )


@query("prj07_flight_features")
def _(spark, folder):
    return X.flight_features(_cascade(spark, folder)).select(
        "FlightId", "Distance", "CRSElapsedTime", "IsShortHaul", "IsMediumHaul", "IsLongHaul"
    )


@query("prj08_09_incoming_and_buffer")
def _(spark, folder):
    return _engineered(spark, folder).select(
        "FlightId", "HasIncomingDelay", "TurnaroundMinutes", "TightTurnaround",
        "CriticalTurnaround", "InsufficientBuffer",
    )


@query("prj10_rotation_flags")
def _(spark, folder):
    return _engineered(spark, folder).select(
        "FlightId", "IsFirstFlight", "IsEarlyRotation", "IsLateRotation"
    )


@query("prj11_select_features")
def _(spark, folder):
    unfilled = _prepared(spark, folder).unfilled
    return _six(
        X.select_features(unfilled, keep=("FlightId", "split")),
        "RouteStdDelay", "RouteRobustnessScore", *[h for h in HISTORY if "Route" not in h],
        "RouteAvgDelay",
    )


@query("prj12_fill_features")
def _(spark, folder):
    # hide some values so that the fill has something to do
    holes = _prepared(spark, folder).unfilled.withColumns({
        "CRSElapsedTime": F.when(F.col("Distance") % 7 != 0, F.col("CRSElapsedTime")),
        "OriginCongestion": F.when(F.col("Hour") != 12, F.col("OriginCongestion")),
    })
    medians = X.train_medians(holes.filter(F.col("split") == "train"))
    return _six(X.fill_features(holes, medians), "OriginCongestion").select(
        "FlightId", "CRSElapsedTime", "OriginCongestion"
    )


# -- rotation windows ----------------------------------------------------------

@query("win01_prev_leg")
def _(spark, folder):
    return R.with_prev_leg(_measured(spark, folder)).select(
        "FlightId", "PrevArrTime", "PrevFlightDate", "PrevFlightDelay"
    )


@query("win01_prev_leg_split_runs")
def _(spark, folder):
    # every tail walked in runs of one minute, as for a tail that fills a table
    return R.with_prev_leg(_measured(spark, folder), hot_rows=0).select(
        "FlightId", "PrevArrTime", "PrevFlightDate", "PrevFlightDelay"
    )


@query("win02_turnaround")
def _(spark, folder):
    return _rotated(spark, folder).select("FlightId", "TurnaroundTime")


@query("win02_turnaround_minutes")
def _(spark, folder):
    return _rotated(spark, folder, clock="minutes").select("FlightId", "TurnaroundTime")


@query("win03_propagation")
def _(spark, folder):
    return _rotated(spark, folder).select("FlightId", "PrevFlightDelay", "DelayPropagated")


@query("win04_next_leg")
def _(spark, folder):
    return R.with_next_leg(_cascade(spark, folder)).select(
        "FlightId", "NextFlight_DepDelay", "NextFlight_ArrDelay", "NextFlight_Date",
        "NextFlight_CRSDepTime",
    )


@query("win05_sched_turnaround")
def _(spark, folder):
    return R.with_sched_turnaround(R.with_next_leg(_cascade(spark, folder))).select(
        "FlightId", "TurnaroundTime"
    )


@query("win06_07_cascade_label")
def _(spark, folder):
    return R.cascade_label(_cascade(spark, folder)).select("FlightId", "CausedCascade")


@query("win08_incoming_delay")
def _(spark, folder):
    return X.rotation_features(_legs(spark, folder)).select(
        "FlightId", "IncomingDelay", "IncomingDepDelay"
    )


@query("win09_position_in_rotation")
def _(spark, folder):
    return X.rotation_features(_legs(spark, folder), hot_rows=0).select(
        "FlightId", "PositionInRotation"
    )


@query("win10_time_index_split_minutes")
def _(spark, folder):
    # more ranges than minutes of a day, so that many a minute is cut
    return P.with_time_index(_timed(_train(spark, folder)), parts=256).select("FlightId", "TimeIndex")


@query("win10_time_index")
def _(spark, folder):
    return P.with_time_index(_timed(_train(spark, folder))).select("FlightId", "TimeIndex")


# -- aggregates ----------------------------------------------------------------

@query("agg01_route_stats")
def _(spark, folder):
    return M.route_stats(_measured(spark, folder))


@query("agg02_on_time_rate_by_route")
def _(spark, folder):
    return M.on_time_rate(_measured(spark, folder), "Route")


@query("agg02_on_time_rate_by_carrier")
def _(spark, folder):
    return M.on_time_rate(_measured(spark, folder), "UniqueCarrier")


@query("agg03_taxi_p90_by_route")
def _(spark, folder):
    return M.taxi_p90(_measured(spark, folder))


@query("agg04_cancel_rate_clean")
def _(spark, folder):
    return M.cancel_rate(_measured(spark, folder), "Route")


@query("agg04_cancel_rate_raw")
def _(spark, folder):
    return M.cancel_rate(table_flights(spark, folder), "UniqueCarrier")


@query("agg05_min_group_size")
def _(spark, folder):
    # a limit inside the range of group sizes, so that some groups drop out
    df = _measured(spark, folder)
    mean = df.agg((F.count(F.lit(1)) / F.count_distinct("Route")).alias("_mean"))
    stats = M.route_stats(df, min_flights=0).select("Route", "FlightCount")
    return one_row(stats, mean).filter("FlightCount >= _mean").drop("_mean")


@query("agg06_carrier_stats")
def _(spark, folder):
    return M.carrier_stats(_measured(spark, folder))


@query("agg07_propagation_by_route")
def _(spark, folder):
    return M.propagation(_walked(spark, folder), "Route", LIMITS.min_incoming)


@query("agg08_propagation_by_carrier")
def _(spark, folder):
    return M.with_carrier_name(
        M.propagation(_walked(spark, folder), "UniqueCarrier"), table_carriers(spark, folder)
    )


@query("agg09_propagation_summary")
def _(spark, folder):
    return M.propagation_summary(_walked(spark, folder))


@query("agg10_taxi_out_by_origin")
def _(spark, folder):
    return M.taxi_out_by_origin(_measured(spark, folder))


@query("agg11_taxi_in_by_dest")
def _(spark, folder):
    return M.taxi_in_by_dest(_measured(spark, folder))


@query("agg12_airtime_by_route")
def _(spark, folder):
    return M.airtime_by_route(_measured(spark, folder))


@query("agg13_turnaround_by_origin")
def _(spark, folder):
    return M.turnaround_by_origin(_walked(spark, folder))


@query("agg14_bottleneck_summary")
def _(spark, folder):
    return M.bottleneck_summary(_routes(spark, folder))


@query("agg15_excess_ground_cost")
def _(spark, folder):
    return M.excess_ground_cost(*_taxi(spark, folder))


@query("agg16_bottleneck_category_counts")
def _(spark, folder):
    return M.bottleneck_category_counts(
        *_taxi(spark, folder), M.airtime_by_route(_measured(spark, folder)),
        M.turnaround_by_origin(_walked(spark, folder)),
    )


@query("agg17_median_delay_by_route")
def _(spark, folder):
    return M.median_delay(_measured(spark, folder), "Route", 20)


@query("agg18_median_delay_by_carrier")
def _(spark, folder):
    return M.median_delay(_measured(spark, folder), "UniqueCarrier")


@query("agg19_quadrant_distribution")
def _(spark, folder):
    return S.quadrant_distribution(_routes(spark, folder))


@query("agg20_label_distribution")
def _(spark, folder):
    return P.label_distribution(_legs(spark, folder))


@query("agg21_history_route")
def _(spark, folder):
    return _six(X.history_table(_train(spark, folder), "route"), "RouteAvgDelay", "RouteStdDelay",
                "RouteAvgDepDelay", "RouteRobustnessScore")


@query("agg22_history_origin")
def _(spark, folder):
    return _six(X.history_table(_train(spark, folder), "origin"), "Origin_AvgDepDelay", "OriginCongestion")


@query("agg23_history_dest")
def _(spark, folder):
    return _six(X.history_table(_train(spark, folder), "dest"), "Dest_AvgArrDelay", "DestCongestion")


@query("agg24_history_carrier")
def _(spark, folder):
    return _six(X.history_table(_train(spark, folder), "carrier"), "CarrierAvgDelay")


@query("agg25_train_medians")
def _(spark, folder):
    return _six(_prepared(spark, folder).medians, *HISTORY)


@query("agg26_class_weight")
def _(spark, folder):
    return _six(L.class_weight(_train(spark, folder)), "weight")


@query("agg27_turnaround_counts")
def _(spark, folder):
    return M.turnaround_counts(_walked(spark, folder))


@query("agg28_bottleneck_by_type")
def _(spark, folder):
    return M.bottleneck_by_type(_routes(spark, folder))


@query("agg29_split_profile")
def _(spark, folder):
    return P.split_profile(_legs(spark, folder))


# -- scores and segments -------------------------------------------------------

@query("scr01_efficiency_routes")
def _(spark, folder):
    return _six(
        S.efficiency_score(M.route_stats(_measured(spark, folder))),
        "OnTimeComponent", "ReliabilityComponent", "DelayComponent", "SmoothComponent",
    ).select("Route", "OnTimeComponent", "ReliabilityComponent", "DelayComponent",
             "SmoothComponent", "EfficiencyScore")


@query("scr01_efficiency_carriers")
def _(spark, folder):
    return S.efficiency_score(M.carrier_stats(_measured(spark, folder))).select(
        "UniqueCarrier", "EfficiencyScore"
    )


@query("scr01_efficiency_raw_cancel_rate")
def _(spark, folder):
    raw = table_flights(spark, folder)
    return D.route_table(D.measured(raw), raw=raw).select("Route", "CancelRate", "EfficiencyScore")


@query("scr02_03_bottleneck_flags")
def _(spark, folder):
    return _routes(spark, folder).select(
        "Route", "TaxiOutBottleneck", "TaxiInBottleneck", "AirTimeBottleneck", "TotalBottlenecks",
        "PrimaryBottleneck",
    )


@query("scr04_06_robustness_routes")
def _(spark, folder):
    return _routes(spark, folder).select(
        "Route", "RobustnessScore", "DelayCV", "RecoveryCapability"
    )


@query("scr04_05_robustness_carriers")
def _(spark, folder):
    return _carriers(spark, folder).select("UniqueCarrier", "RobustnessScore", "DelayCV")


@query("scr07_taxi_out_inefficiency")
def _(spark, folder):
    return S.taxi_inefficiency(M.taxi_out_by_origin(_measured(spark, folder)), "Out").select(
        "Origin", "TaxiOutInefficiency"
    )


@query("scr07_taxi_in_inefficiency")
def _(spark, folder):
    return S.taxi_inefficiency(M.taxi_in_by_dest(_measured(spark, folder)), "In").select(
        "Dest", "TaxiInInefficiency"
    )


@query("scr08_air_time_issue")
def _(spark, folder):
    return M.airtime_by_route(_measured(spark, folder)).select("Route", "HasAirTimeIssue")


@query("scr09_quadrants")
def _(spark, folder):
    return _routes(spark, folder).select(
        "Route", "EfficiencyScore", "RobustnessScore", "Category"
    )


@query("scr10_tight_turnaround_rate")
def _(spark, folder):
    return M.turnaround_by_origin(_walked(spark, folder)).select("Origin", "TightTurnaroundRate")


@query("scr11_score_bands")
def _(spark, folder):
    return S.score_band(_routes(spark, folder)).select("Route", "EfficiencyBand", "RobustnessBand")


# -- joins ---------------------------------------------------------------------

@query("jon01_carrier_name")
def _(spark, folder):
    # a few flights have an unknown code, so that the left join has misses
    flights = _measured(spark, folder).withColumn("UniqueCarrier", F.when(
        F.col("FlightNum") % 10 == 0, F.concat(F.lit("?"), "UniqueCarrier")
    ).otherwise(F.col("UniqueCarrier")))
    return M.with_carrier_name(
        M.carrier_stats(flights), table_carriers(spark, folder)
    ).select(
        "UniqueCarrier", "Description", "FlightCount"
    )


@query("jon02_03_route_and_propagation")
def _(spark, folder):
    return M.route_stats_with_propagation(_rotated(spark, folder)).select(
        "Route", "OnTimeRate", "P90TaxiOut", "CancelRate", "PropagationRate",
        "FlightsWithIncomingDelay", "TotalFlights", "ConditionalRate",
    )


@query("jon04_apply_history")
def _(spark, folder):
    prepared = _prepared(spark, folder)
    cols = [*HISTORY, "RouteMedianDelay", "RouteAvgDepDelay", "CarrierAvgDelay"]
    return _six(X.apply_history(prepared.labelled, prepared.history), *cols).select(
        "FlightId", *cols
    )


@query("jon05_lookup_history")
def _(spark, folder):
    # one flight in five asks for an airport without history
    prepared = _prepared(spark, folder)
    asked = table_flights(spark, folder).select(
        "FlightId", "Origin",
        F.when(F.col("FlightNum") % 5 == 0, F.lit("ZZZ")).otherwise(F.col("Dest")).alias("Dest"),
    )
    return _six(V.lookup_history(asked, prepared.history), *HISTORY)


# -- ranked reports ------------------------------------------------------------

_ROUTE_COLS = ("EfficiencyScore", "OnTimeRate", "AvgArrDelay", "AvgTaxiOut", "AvgTaxiIn",
               "AvgAirTimeDeviationPct")
_ROBUST_COLS = ("RobustnessScore", "StdArrDelay", "AvgArrDelay", "DelayCV", "OnTimeRate")
_CARRIER_COLS = ("Description", *_ROUTE_COLS, "FlightCount")


def _report(name, table, key, by, n, cols, ascending=False):
    @query(name)
    def _(spark, folder):
        return S.top_k(table(spark, folder), by, n, key, ascending, tuple(cols))


def _taxi_out(spark, folder):
    return _taxi(spark, folder)[0]


def _taxi_in(spark, folder):
    return _taxi(spark, folder)[1]


def _air_time_issues(spark, folder):
    return M.airtime_by_route(_measured(spark, folder)).filter("HasAirTimeIssue = 1")


def _route_propagation(spark, folder):
    return M.propagation(_walked(spark, folder), "Route", LIMITS.min_incoming)


def _carrier_propagation(spark, folder):
    return M.with_carrier_name(
        M.propagation(_walked(spark, folder), "UniqueCarrier"), table_carriers(spark, folder)
    )


def _turnaround(spark, folder):
    return M.turnaround_by_origin(_walked(spark, folder))


def _weak_routes(spark, folder):
    return _routes(spark, folder).filter(F.col("Category") == "LOW_EFF_LOW_ROB")


_report("top01_best_routes", _routes, "Route", "EfficiencyScore", 10,
        [*_ROUTE_COLS, "TotalBottlenecks", "FlightCount"])
_report("top02_worst_routes", _routes, "Route", "EfficiencyScore", 10,
        [*_ROUTE_COLS, "PrimaryBottleneck", "TotalBottlenecks", "FlightCount"], True)
_report("top03_bottleneck_routes", _routes, "Route", "TotalBottlenecks", 15,
        ["TotalBottlenecks", "PrimaryBottleneck", "EfficiencyScore", "AvgTaxiOut", "AvgTaxiIn",
         "AvgAirTimeDeviationPct", "FlightCount"])
_report("top04_best_carriers", _carriers, "UniqueCarrier", "EfficiencyScore", 10, _CARRIER_COLS)
_report("top05_worst_carriers", _carriers, "UniqueCarrier", "EfficiencyScore", 10, _CARRIER_COLS,
        True)
_report("top06_most_robust_routes", _routes, "Route", "RobustnessScore", 10,
        [*_ROBUST_COLS, "RecoveryCapability", "FlightCount"])
_report("top07_least_robust_routes", _routes, "Route", "RobustnessScore", 10,
        [*_ROBUST_COLS, "RecoveryCapability", "FlightCount"], True)
_report("top08_most_robust_carriers", _carriers, "UniqueCarrier", "RobustnessScore", 10,
        ["Description", *_ROBUST_COLS, "FlightCount"])
_report("top09_least_robust_carriers", _carriers, "UniqueCarrier", "RobustnessScore", 10,
        ["Description", *_ROBUST_COLS, "FlightCount"], True)
_report("top10_route_propagation", _route_propagation, "Route", "PropagationRate", 15,
        ["PropagationRate", "FlightsWithIncomingDelay", "TotalFlights"])
_report("top11_carrier_propagation", _carrier_propagation, "UniqueCarrier", "PropagationRate", 10,
        ["Description", "PropagationRate", "FlightsWithIncomingDelay", "TotalFlights"])
_report("top12_priority_routes", _weak_routes, "Route", "EfficiencyScore", 20,
        ["EfficiencyScore", "RobustnessScore", "AvgArrDelay", "StdArrDelay", "PrimaryBottleneck",
         "TotalBottlenecks", "FlightCount"], True)
_report("top13_taxi_out_airports", _taxi_out, "Origin", "TaxiOutInefficiency", 15,
        ["AvgTaxiOut", "P90TaxiOut", "P95TaxiOut", "StdTaxiOut", "TaxiOutInefficiency",
         "AvgDepDelay", "FlightCount"])
_report("top14_taxi_in_airports", _taxi_in, "Dest", "TaxiInInefficiency", 15,
        ["AvgTaxiIn", "P90TaxiIn", "P95TaxiIn", "StdTaxiIn", "TaxiInInefficiency", "AvgArrDelay",
         "FlightCount"])
_report("top15_air_time_routes", _air_time_issues, "Route", "AvgAirTimeDeviationPct", 15,
        ["AvgAirTimeDeviationPct", "StdAirTimeDeviationPct", "AvgAirTimeDeviation", "Distance",
         "AvgActualTime", "AvgExpectedTime", "FlightCount"])
_report("top16_turnaround_airports", _turnaround, "Origin", "AvgInefficiency", 15,
        ["AvgTurnaround", "P10Turnaround", "TightTurnaroundRate", "AvgInefficiency", "AvgDepDelay",
         "FlightCount"])


@query("top17_chart_taxi_out")
def _(spark, folder):
    return S.chart_frame(_taxi_out(spark, folder), "AvgTaxiOut", "Origin", 10,
                         "TaxiOutInefficiency")


@query("top17_chart_taxi_in")
def _(spark, folder):
    return S.chart_frame(_taxi_in(spark, folder), "AvgTaxiIn", "Dest", 10, "TaxiInInefficiency")


@query("top17_chart_air_time")
def _(spark, folder):
    return S.chart_frame(_air_time_issues(spark, folder), "AvgAirTimeDeviationPct", "Route", 10)


@query("top17_chart_carrier_efficiency")
def _(spark, folder):
    return S.top_k(_carriers(spark, folder), "EfficiencyScore", 10, "UniqueCarrier",
                   cols=("Description", "EfficiencyScore"))


@query("top17_chart_carrier_robustness")
def _(spark, folder):
    return S.top_k(_carriers(spark, folder), "RobustnessScore", 10, "UniqueCarrier",
                   cols=("Description", "RobustnessScore"))


@query("top17_chart_carrier_propagation")
def _(spark, folder):
    top = S.chart_frame(_carrier_propagation(spark, folder), "PropagationRate", "UniqueCarrier", 10,
                        scale=100.0)
    return _six(top, "PropagationRate")


# -- split, folds and evaluation -----------------------------------------------

@query("ml01_temporal_split")
def _(spark, folder):
    return _legs(spark, folder).select("FlightId", "split")


@query("ml02_time_series_folds")
def _(spark, folder):
    return P.fold_profile(P.time_series_folds(P.with_time_index(_timed(_train(spark, folder)))))


@query("ml03_cv_summary")
def _(spark, folder):
    scored = _timed(_scored(spark, folder, "train"), E.LABEL, E.PRED, E.SCORE)
    folds = P.time_series_folds(P.with_time_index(scored))
    summary = E.cv_summary(E.fold_metrics(folds))
    return _six(summary, *summary.columns)


@query("ml06_confusion_matrix")
def _(spark, folder):
    return E.confusion_matrix(_scored(spark, folder))


@query("ml07_binary_metrics")
def _(spark, folder):
    metrics = E.binary_metrics(_scored(spark, folder))
    return _six(metrics, *metrics.columns)


@query("ml08_roc_auc")
def _(spark, folder):
    return _six(E.roc_auc(_scored(spark, folder)), "auc")


@query("ml09_classification_report")
def _(spark, folder):
    return _six(E.classification_report(_scored(spark, folder)), "precision", "recall", "f1")


@query("ml10_roc_curve")
def _(spark, folder):
    return _six(E.roc_curve(_scored(spark, folder)), "fpr", "tpr")


@query("ml11_pr_curve")
def _(spark, folder):
    return _six(E.pr_curve(_scored(spark, folder)), "precision", "recall", "base_rate")


@query("ml13_risk_tiers")
def _(spark, folder):
    return T.risk_tiers(_scored(spark, folder)).select("FlightId", "RiskTier")


@query("ml13_tier_thresholds")
def _(spark, folder):
    thresholds = T.tier_thresholds(_scored(spark, folder))
    return _six(thresholds, *thresholds.columns)


@query("ml14_tier_distribution")
def _(spark, folder):
    return T.tier_distribution(T.risk_tiers(_scored(spark, folder)))


@query("ml15_tier_rates")
def _(spark, folder):
    return T.tier_rates(T.risk_tiers(_scored(spark, folder)))


@query("ml16_score_histogram")
def _(spark, folder):
    return _six(E.score_histogram(_scored(spark, folder)), "low", "density")


@query("ml17_leakage_checks")
def _(spark, folder):
    prepared = _prepared(spark, folder)
    return T.leakage_checks(
        prepared.unfilled, prepared.history,
        _six(E.binary_metrics(_scored(spark, folder)), "recall"),
    )


# -- scoring requests ----------------------------------------------------------

def _raw_requests(spark, folder) -> DataFrame:
    """One raw-flight request per flight, with fields left out in a fixed pattern."""
    n = F.col("FlightNum")
    clock = F.concat(
        F.lpad(F.floor(F.col("CRSDepTime") / 100).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.col("CRSDepTime") % 100).cast("string"), 2, "0"),
    )
    body = F.struct(
        F.lower("Origin").alias("origin"),
        F.when(n % 5 == 0, F.lit("zzz")).otherwise(F.col("Dest")).alias("dest"),
        F.when(n % 2 == 0, clock).alias("scheduled_departure_time"),
        F.when(n % 4 == 1, F.floor(F.col("CRSDepTime") / 100)).alias("hour"),
        F.when(n % 3 != 0, F.weekday("FlightDate")).alias("day_of_week"),
        F.when(n % 3 != 1, F.col("Month")).alias("month"),
        F.when(n % 7 != 0, F.col("Distance")).alias("distance"),
        F.when(n % 7 != 1, F.col("CRSElapsedTime")).alias("crs_elapsed_time"),
        F.col("ArrDelay").alias("incoming_delay"),
        F.col("DepDelay").alias("incoming_dep_delay"),
        F.when(n % 11 != 0, F.col("TaxiOut") * 3).alias("turnaround_time"),
        F.when(n % 11 != 1, n % 7).alias("position_in_rotation"),
    )
    return table_flights(spark, folder).select(
        F.col("FlightId").alias("RequestId"), F.to_json(body).alias("value")
    )


def _numbers() -> list[Column]:
    """28 numbers out of one flight."""
    base = ("CRSDepTime", "Distance", "Cancelled", "CRSElapsedTime")
    return [(F.col(base[i % 4]) + i).cast("string") for i in range(len(FEATURES))]


def _feature_columns(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "RequestId", *[F.col("features")[i].alias(f) for i, f in enumerate(FEATURES)]
    )


# -- files ----------------------------------------------------------------------

@_once
def _file_folder(spark, folder) -> str:
    """Flights and carriers as CSV files; each tenth flight stands in a line without an end."""
    base = f"{session_folder(spark)}/files-{uuid.uuid4().hex}"
    columns = [f.name for f in table_flights(spark, folder).schema if f.name != "FlightDate"]
    text = table_flights(spark, folder).select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in columns])
    header = {"header": True, "encoding": "ISO-8859-1"}
    whole, path = F.col("FlightNum").cast("long") % 10 != 0, f"{base}/airline.csv"
    text.filter(whole).write.options(**header).csv(path)

    def headed(batches):  # as in every file of the CSV writer
        yield pa.RecordBatch.from_pydict({"value": [",".join(columns)]})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    cut = text.filter(~whole).select(F.concat_ws(",", *columns[:3]).alias("value"))
    cut.mapInArrow(headed, "value string").write.mode("append").text(path)
    table_carriers(spark, folder).write.options(**header).csv(f"{base}/carriers.csv")
    return base


@query("src01_flight_csv")
def _(spark, folder):
    read = read_flights(spark, _file_folder(spark, folder))
    return C.with_flight_date(read).select(*table_flights(spark, folder).columns)


@query("src01_rejected_lines")
def _(spark, folder):
    return read_flight_rejects(spark, _file_folder(spark, folder)).select(
        F.split("line", ",")[0].alias("FlightId"), "line", "reason")


@query("src02_row_limit")
def _(spark, folder):
    read = read_flights(spark, _file_folder(spark, folder), limit=1000)
    return read.agg(F.count(F.lit(1)).alias("flights"))


@query("src03_carrier_csv")
def _(spark, folder):
    return read_carriers(spark, _file_folder(spark, folder))


@query("cln11_cleaning_report_rejects")
def _(spark, folder):
    path = _file_folder(spark, folder)
    return C.cleaning_report(
        read_flights(spark, path), "cascade", read_flight_rejects(spark, path)
    ).select("initial_rows", "cleaned_rows", "rejected_lines")


@_once
def _result_set(spark, folder) -> str:
    """Result tables of the descriptive run and histories, published as one version."""
    base = f"{session_folder(spark)}/set-{uuid.uuid4().hex}"
    history = {f"history_{n}": t for n, t in _prepared(spark, folder).history.items()}
    K.write_set({
        "carriers": _carriers(spark, folder), "taxi_out": _taxi(spark, folder)[0],
        "features": K.feature_list(spark), **history,
    }, base, {"taxi_out": "csv", "features": "json"})
    return base


@query("snk01_result_tables")
def _(spark, folder):
    return K.read_set(spark, _result_set(spark, folder))["carriers"].select(
        "UniqueCarrier", "Description", "EfficiencyScore", "RobustnessScore", "FlightCount")


@query("snk01_result_tables_csv")
def _(spark, folder):
    return K.read_set(spark, _result_set(spark, folder))["taxi_out"].select(
        "Origin", "AvgTaxiOut", "P90TaxiOut", "FlightCount", "TaxiOutInefficiency")


@query("snk02_history_tables")
def _(spark, folder):
    tables = K.read_set(spark, _result_set(spark, folder))
    return _six(tables["history_origin"], "Origin_AvgDepDelay", "OriginCongestion").select(
        "Origin", "Origin_AvgDepDelay", "OriginCongestion", "SourceLegs")


@query("snk03_feature_list")
def _(spark, folder):
    return K.read_set(spark, _result_set(spark, folder))["features"]


@_once
def _model_set(spark, folder) -> str:
    """The model with its importance table, published as one version."""
    base = f"{session_folder(spark)}/set-{uuid.uuid4().hex}"
    model = _model(spark, folder)
    K.write_set({"importance": L.feature_importance(model)}, base, {"importance": "csv"}, model)
    return base


@query("snk04_importance_csv")
def _(spark, folder):
    read = K.read_set(spark, _model_set(spark, folder))["importance"]
    return read.select("Feature", F.col("Importance").between(0, 1).alias("InRange"))


@query("snk05_saved_model")
def _(spark, folder):
    # the scores of the model that was saved and loaded are those of the one in use
    test = _filled(spark, folder).filter(F.col("split") == "test")
    again = L.score(test, K.read_set_model(spark, _model_set(spark, folder))).select(
        "FlightId", F.col(E.SCORE).alias("again"))
    return _model_scores(spark, folder).join(again, "FlightId").select(
        "FlightId", (F.col("again") == F.col(E.SCORE)).alias("Same"))


@query("src04_csv_requests")
def _(spark, folder):
    lines = table_flights(spark, folder).select(
        F.col("FlightId").alias("RequestId"), F.concat_ws(" , ", *_numbers()).alias("value")
    )
    return _feature_columns(I.parse_csv_requests(lines))


@query("src05_json_feature_requests")
def _(spark, folder):
    bodies = table_flights(spark, folder).select(
        F.col("FlightId").alias("RequestId"),
        F.concat(F.lit('{"features": ['), F.concat_ws(", ", *_numbers()), F.lit("]}"))
        .alias("value"),
    )
    return _feature_columns(I.parse_json_requests(bodies))


@query("src06_json_raw_requests")
def _(spark, folder):
    return I.parse_json_requests(_raw_requests(spark, folder)).select(
        "RequestId", "flight.origin", "flight.dest", "flight.distance", "flight.incoming_delay"
    )


@query("src07_bad_requests")
def _(spark, folder):
    # requests for the unknown airport lose their destination, those with an hour are cut,
    # and of the others each third one has a numeric field that is no number
    flight = F.split("RequestId", "-")[0].cast("long")
    unread = F.get(F.array(*[F.lit(n) for n in I.RAW_FIELDS[3:]]),
                   (F.floor(flight / 3) % 9).cast("int"))
    given = F.from_json("value", "map<string,string>")
    spoiled = F.to_json(F.map_concat(
        F.map_filter(given, lambda k, v: k != unread), F.create_map(unread, F.lit("1h"))))
    broken = _raw_requests(spark, folder).withColumn(
        "value",
        F.when(F.col("value").contains('"zzz"'), F.regexp_replace("value", '"dest"', '"to"'))
        .when(F.col("value").contains('"hour"'), F.lit("{broken"))
        .when(flight % 3 == 0, spoiled)
        .otherwise(F.col("value")),
    )
    _, bad = I.split_bad_requests(I.parse_json_requests(broken))
    return bad.groupBy("_error").agg(F.count(F.lit(1)).alias("requests"))


@query("srv01_features_from_raw")
def _(spark, folder):
    parsed = I.parse_json_requests(_raw_requests(spark, folder))
    stats = _prepared(spark, folder).history
    return _six(V.features_from_raw(parsed, stats), *HISTORY).select("RequestId", *FEATURES)


def _stream_folder(spark) -> str:
    return f"{session_folder(spark)}/stream-{uuid.uuid4().hex}"


def _deliver(requests: DataFrame, path: str) -> None:
    """Requests as the JSON lines files that a stream finds.

    The text of a request is many times the flight it is made of, so the files are compressed.
    One task reads such a file whole, so its rows are bounded.
    """
    requests.write.options(compression="gzip", maxRecordsPerFile=500_000).json(path)


@query("srv04_feature_stream")
def _(spark, folder):
    # all requests written as files, then read as a stream until none is left
    base = _stream_folder(spark)
    _deliver(_raw_requests(spark, folder), f"{base}/in")
    stream = J.request_stream(spark, f"{base}/in", max_files=1000)
    features = J.feature_stream(stream, _prepared(spark, folder).history)
    (features.writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
     .start(f"{base}/out").awaitTermination())
    return _six(spark.read.parquet(f"{base}/out"), *HISTORY)


@query("srv05_incoming_delay_stream")
def _(spark, folder):
    # a month of legs arrives after the other, each is streamed when it is there; the stream goes
    # on from its state each time. The first month is then delivered again, too late
    base = _stream_folder(spark)
    legs = _cascade(spark, folder).select(
        "FlightId", "TailNum", "FlightDate", "CRSDepTime", "ArrDelay", "DepDelay")
    month = F.floor((F.dayofyear("FlightDate") - 1) / 30)
    for part in (0, 1, 2, 3, 0):
        legs.filter(month == part).write.mode("append").parquet(f"{base}/in")
        J.incoming_delay_stream(
            J.leg_stream(spark, f"{base}/in", max_files=1000), f"{base}/out", f"{base}/checkpoint",
            once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "FlightId", "IncomingDelay", "IncomingDepDelay", "Late")


@query("srv02_fixed_tiers")
def _(spark, folder):
    return T.risk_tiers(_scored(spark, folder), mode="fixed").select(
        "FlightId", "RiskTier", "CascadePrediction", "RecommendedAction"
    )


# -- trained model (rows only) -------------------------------------------------

_MODELS: dict[tuple, str] = {}


def _filled(spark, folder) -> DataFrame:
    prepared = _prepared(spark, folder)
    return staged(spark, "filled", lambda: prepared.features, _sources(folder))


def _model(spark, folder) -> PipelineModel:
    """The model, fitted once per session and source and kept in the shared folder."""
    key = source_key(spark, "model", _sources(folder))
    if key not in _MODELS:
        path = f"{session_folder(spark)}/model-{uuid.uuid4().hex}"
        train = _filled(spark, folder).filter(F.col("split") == "train")
        save_model(L.train_cascade(train), path)
        _MODELS[key] = path
    return load_model(_MODELS[key])


def _model_scores(spark, folder) -> DataFrame:
    """Scored test legs, read by several evaluations."""
    def build() -> DataFrame:
        test = _filled(spark, folder).filter(F.col("split") == "test")
        return L.score(test, _model(spark, folder))

    return staged(spark, "model-scores", build, _sources(folder))


@query("ml04_train_cascade")
def _(spark, folder):
    scored = _model_scores(spark, folder)
    return one_row(E.binary_metrics(scored), E.roc_auc(scored))


@query("ml05_score")
def _(spark, folder):
    return _model_scores(spark, folder).select("FlightId", E.SCORE, E.PRED)


@query("ml12_top18_feature_importance")
def _(spark, folder):
    return S.top_k(L.feature_importance(_model(spark, folder)), "Importance", 20, "Feature")


def _folds(spark, folder) -> DataFrame:
    """The filled training part with its folds, stored."""
    train = _filled(spark, folder).filter(F.col("split") == "train")
    return staged(spark, "folds", lambda: P.time_series_folds(P.with_time_index(train)),
                  _sources(folder))


@_once
def _cross_validated(spark, folder) -> DataFrame:
    """Metrics of the model on each fold, fitted with the defaults on the folds before it."""
    return staged(spark, "fold-metrics", lambda: L.cross_validate(_folds(spark, folder)),
                  _sources(folder))


@query("ml03_cross_validation")
def _(spark, folder):
    return _cross_validated(spark, folder)


@query("ml03_cross_validation_rules")
def _(spark, folder):
    # what holds for each fold whatever the model says: its rows, and metrics from 0 to 1
    profile = P.fold_profile(_folds(spark, folder))
    bounded = F.lit(True)
    for name in ("f1", "recall", "precision", "accuracy"):
        bounded = bounded & F.col(name).between(0, 1)
    return profile.join(_cross_validated(spark, folder), "ValFold").select(
        "ValFold", "train_rows", "val_rows", bounded.alias("Bounded"))


def _metadata(spark, folder) -> DataFrame:
    prepared, scored = _prepared(spark, folder), _model_scores(spark, folder)
    return Q.model_metadata(
        prepared, one_row(E.binary_metrics(scored), E.roc_auc(scored)),
        E.cv_summary(_cross_validated(spark, folder)), T.tier_thresholds(scored),
    )


@query("ml18_model_metadata")
def _(spark, folder):
    return _metadata(spark, folder)


@query("ml18_metadata_rules")
def _(spark, folder):
    # the parts that do not depend on the model
    return _metadata(spark, folder).select(
        "model_version", F.col("training_period.start").alias("train_start"),
        F.col("training_period.end").alias("train_end"), F.col("test_period.start").alias("test_start"),
        F.col("test_period.end").alias("test_end"),
        F.col("data_leakage_checks.temporal_split").alias("temporal_split"),
        F.col("data_leakage_checks.statistics_source").alias("statistics_source"),
        F.array_join("features", ",").alias("features"),
        (F.col("risk_tiers.critical_threshold") >= F.col("risk_tiers.elevated_threshold"))
        .alias("tiers_ordered"))


def _broken_requests(spark, folder) -> DataFrame:
    """The raw requests; those for the unknown airport have lost their destination."""
    return _raw_requests(spark, folder).withColumn("value", F.when(
        F.col("value").contains('"zzz"'), F.regexp_replace("value", '"dest"', '"to"')
    ).otherwise(F.col("value")))


@query("srv03_score_batch")
def _(spark, folder):
    good, _ = I.split_bad_requests(I.parse_json_requests(_broken_requests(spark, folder)))
    responses = V.score_batch(good, _model(spark, folder), _prepared(spark, folder).history)
    return V.read_responses(responses)


def _streamed(spark, folder) -> DataFrame:
    """All requests, answered as a stream: responses and rejects with their kind."""
    def build() -> DataFrame:
        base = _stream_folder(spark)
        _deliver(_broken_requests(spark, folder), f"{base}/in")
        started = J.score_stream(
            J.request_stream(spark, f"{base}/in", max_files=1000), _model(spark, folder),
            _prepared(spark, folder).history, f"{base}/out", f"{base}/progress", once=True)
        for running in started:
            running.awaitTermination()
        return spark.read.schema(
            "RequestId string, response string, value string, _error string, kind string"
        ).json(f"{base}/out")

    return remembered(spark, "streamed-responses", _sources(folder), build)


@query("srv04_score_stream")
def _(spark, folder):
    return V.read_responses(_streamed(spark, folder).filter("kind = 'responses'"))


@query("snk06_responses")
def _(spark, folder):
    # what a response must hold whatever the model says; rejects have their reason
    streamed = _streamed(spark, folder)
    read = V.read_responses(streamed.filter("kind = 'responses'"))
    p = F.col("CascadeProbability")
    said = T.risk_tiers(read.select("RequestId", p.alias(E.SCORE)), mode="fixed")
    said = said.select(F.col("RequestId").alias("id"), *[F.col(c).alias(f"want{c}") for c in (
        "CascadePrediction", "RiskTier", "RecommendedAction")])
    fits = [F.col(c) == F.col(f"want{c}") for c in
            ("CascadePrediction", "RiskTier", "RecommendedAction")]
    answered = read.join(said, F.col("RequestId") == F.col("id")).select(
        "RequestId", "ModelVersion", p.between(0, 1).alias("ScoreInRange"),
        fits[0].alias("PredictionFits"), fits[1].alias("TierFits"), fits[2].alias("ActionFits"),
        F.lit(None).cast("string").alias("Error"))
    nothing = F.lit(None).cast("boolean")
    return answered.unionByName(streamed.filter("kind = 'rejected'").select(
        "RequestId", F.lit(None).cast("string").alias("ModelVersion"),
        *[nothing.alias(c) for c in ("ScoreInRange", "PredictionFits", "TierFits", "ActionFits")],
        F.col("_error").alias("Error")))


@query("ml05_score_rules")
def _(spark, folder):
    return _model_scores(spark, folder).select(
        "FlightId", F.col(E.SCORE).between(0, 1).alias("ScoreInRange"),
        (F.col(E.PRED) == (F.col(E.SCORE) > 0.5).cast("int")).alias("ClassFits"))


@query("ml04_scored_legs")
def _(spark, folder):
    return E.confusion_matrix(_model_scores(spark, folder)).select(
        (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"))


@query("ml12_importance_rules")
def _(spark, folder):
    importance = L.feature_importance(_model(spark, folder))
    total = importance.agg(round_to(F.sum("Importance"), 6).alias("Total"))
    return one_row(importance, total).select(
        "Feature", F.col("Importance").between(0, 1).alias("InRange"), "Total")
