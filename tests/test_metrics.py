import pytest
from pyspark.sql import functions as F

from flightops.operators import metrics as M
from flightops.operators import scores as S
from flightops.plans import descriptive
from flightops.sources.tables import table_flights
from tests.conftest import day, rows

SCHEMA = ("Route string, UniqueCarrier string, Origin string, TailNum string, FlightDate date, "
          "CRSDepTime int, FlightId string, FlightNum int, Distance int, ArrDelay int, DepDelay int, "
          "TaxiOut int, TaxiIn int, AirTimeDeviation double, AirTimeDeviationPct double, "
          "ActualElapsedTime int, Cancelled string")


def flight(i, route="A-B", tail="N1", distance=100, arr=0, num=1, taxi=10, carrier="X"):
    return (route, carrier, route and route[0], tail, day(1), 900, f"f{i}", num, distance, arr, 3,
            taxi, 5, 1.0, 2.0, 60, "NO")


def test_route_stats(spark):
    df = spark.createDataFrame([
        flight(1, arr=15, taxi=10, tail=None, distance=999),
        flight(2, arr=16, taxi=20, tail="N2", distance=200),
        flight(3, arr=15, taxi=30, num=None, tail="N1", distance=300),
        flight(4, "C-D", arr=7),
        flight(5, None),
    ], SCHEMA)
    got = {r.Route: r for r in M.route_stats(df, min_flights=1).collect()}
    assert set(got) == {"A-B", "C-D"}
    ab, cd = got["A-B"], got["C-D"]
    assert ab.AvgArrDelay == 15.33 and ab.StdArrDelay == 0.58 and ab.OnTimeRate == 0.667
    assert ab.FlightCount == 2 and ab.P90TaxiOut == 28.0 and ab.CancelRate == 0.0
    assert ab.Distance == 300  # first aircraft in order; unknown aircraft come last
    assert cd.StdArrDelay is None and cd.FlightCount == 1
    assert rows(M.route_stats(df, min_flights=2), "Route") == [("A-B",)]


def test_mean_rounds_half_to_even(spark):
    df = spark.createDataFrame([flight(i, arr=a) for i, a in enumerate([0] * 7 + [1])], SCHEMA)
    assert M.carrier_stats(df).first().AvgArrDelay == 0.12  # 0.125


def test_propagation_counts(spark):
    df = spark.createDataFrame(
        [("A", 16, 1), ("A", 15, 0), ("A", None, 0), ("B", 3, 0), ("B", None, 0), (None, 99, 1)],
        "Route string, PrevFlightDelay int, DelayPropagated int",
    )
    assert rows(M.propagation(df, "Route")) == [("A", 0.25, 1, 3, 1.0), ("B", 0.0, None, 2, None)]
    assert rows(M.propagation(df, "Route", 1), "Route") == [("A",)]
    s = M.propagation_summary(df).first()
    assert (s.FlightsWithIncomingDelay, s.PropagatedDelays, s.PropagationPct) == (2, 2, 33.3)


def test_carrier_name_keeps_unknown(spark):
    stats = spark.createDataFrame([("X", 1), ("Y", 2)], "UniqueCarrier string, n int")
    names = spark.createDataFrame([("X", "Ex")], "Code string, Description string")
    assert rows(M.with_carrier_name(stats, names)) == [("X", 1, "Ex"), ("Y", 2, None)]


def test_turnaround_by_origin(spark):
    df = spark.createDataFrame(
        [("A", h, p, 2, n) for h, p, n in
         [(0.5, 75, 1), (2.0, 0, 1), (-1.0, 0, None), (999.0, 0, 1), (24.0, 0, 1)]],
        "Origin string, TurnaroundTime double, TurnaroundInefficiency int, DepDelay int, FlightNum int",
    )
    r = M.turnaround_by_origin(df, min_flights=1).first()
    assert r.FlightCount == 2 and r.AvgTurnaround == 0.5 and r.TightTurnaroundRate == 0.5
    c = M.turnaround_counts(df).first()
    assert tuple(c) == (3, 2, 1)


def test_excess_ground_cost(spark):
    out = spark.createDataFrame([(10.0,), (10.0,), (20.0,)], "AvgTaxiOut double")
    inn = spark.createDataFrame([(5.0,)], "AvgTaxiIn double")
    r = M.excess_ground_cost(out, inn, flights=1_000_000, per_min=10).first()
    assert tuple(r) == (3.3, 0.0, 3.3, 33.3)


def test_median_delay(spark):
    df = spark.createDataFrame([("A", 1), ("A", 4), ("B", 9), ("C", 9), (None, 50)],
                               "Route string, ArrDelay int")
    assert [tuple(r) for r in M.median_delay(df, "Route", 2).collect()] == [("B", 9.0), ("C", 9.0)]
    assert M.median_delay(df, "Route").count() == 3


STATS = "Route string, OnTimeRate double, CancelRate double, AvgArrDelay double, StdArrDelay double"


def stats(spark, *data):
    return spark.createDataFrame([(f"R{i}", *d) for i, d in enumerate(data)], STATS)


def test_efficiency_score(spark):
    df = stats(spark, (1.0, 0.0, -5.0, 0.0), (0.5, 0.1, 75.0, 75.0), (0.5, 0.0, 30.0, None))
    assert [r.EfficiencyScore for r in S.efficiency_score(df).orderBy("Route").collect()] == [
        100.0, 38.0, None]


def test_robustness_and_recovery(spark):
    df = stats(spark, (0.9, 0.0, -3.0, 10.0), (0.9, 0.0, 59.0, 20.0), (0.9, 0.0, 90.0, None))
    got = S.recovery_capability(S.robustness_score(df)).orderBy("Route").collect()
    assert [r.RobustnessScore for r in got] == [48.7, 0.0, None]
    assert [r.DelayCV for r in got] == [2.5, 0.33, None]
    assert [r.RecoveryCapability for r in got] == [0.82, 2.0, 2.0]
    none = S.robustness_score(stats(spark, (1.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 0.0)))
    assert [r.RobustnessScore for r in none.collect()] == [None, None]


def test_flags(spark):
    df = spark.createDataFrame(
        [("a", 15.0, 10.0, 10.0), ("b", 15.01, 9.0, 11.0), ("c", None, 11.0, None)],
        "Route string, AvgTaxiOut double, AvgTaxiIn double, AvgAirTimeDeviationPct double",
    )
    flagged = S.bottleneck_flags(df)
    assert rows(flagged, "Route", "TotalBottlenecks", "PrimaryBottleneck") == [
        ("a", 0, "None"), ("b", 2, "TaxiOut, AirTime"), ("c", 1, "TaxiIn")]
    s = M.bottleneck_summary(flagged).first()
    assert (s.TaxiOutRoutes, s.TaxiInRoutes, s.AirTimeRoutes, s.MultipleBottleneckRoutes) == (
        1, 1, 1, 1)
    assert rows(M.bottleneck_by_type(flagged)) == [("AirTime", 1), ("TaxiIn", 1), ("TaxiOut", 1)]


def test_quadrants_put_the_median_high(spark):
    df = spark.createDataFrame(
        [("a", 50.0, 50.0), ("b", 60.0, 40.0), ("c", 40.0, 60.0), ("d", None, 50.0)],
        "Route string, EfficiencyScore double, RobustnessScore double",
    )
    segmented = S.quadrants(df)
    assert dict(rows(segmented, "Route", "Category")) == {
        "a": "HIGH_EFF_HIGH_ROB", "b": "HIGH_EFF_LOW_ROB", "c": "LOW_EFF_HIGH_ROB",
        "d": "LOW_EFF_LOW_ROB"}
    spread = S.quadrant_distribution(segmented)
    assert spread.agg(F.sum("Routes")).first()[0] == 4
    assert {r.Pct for r in spread.collect()} == {25.0}


def test_score_bands(spark):
    df = spark.createDataFrame(
        [("a", 85.1, 60.1), ("b", 85.0, 60.0), ("c", 70.0, 40.0), ("d", 55.0, 39.9), ("e", 54.9, None)],
        "Route string, EfficiencyScore double, RobustnessScore double",
    )
    assert [r[1:] for r in rows(S.score_band(df), "Route", "EfficiencyBand", "RobustnessBand")] == [
        ("EXCELLENT", "PREDICTABLE"), ("GOOD", "MODERATE"), ("GOOD", "MODERATE"),
        ("NEEDS_IMPROVEMENT", "UNPREDICTABLE"), ("CRITICAL", None)]


@pytest.mark.parametrize("ascending, want", [(False, ["b", "c", "a"]), (True, ["a", "b", "c"])])
def test_top_k_nulls_last_ties_by_key(spark, ascending, want):
    df = spark.createDataFrame([("c", 2.0), ("b", 2.0), ("a", 1.0), ("z", None)], "k string, v double")
    assert [r.k for r in S.top_k(df, "v", 3, "k", ascending).collect()] == want
    assert [r.k for r in S.top_k(df, "v", 4, "k", ascending).collect()][-1] == "z"


def test_chart_frame(spark):
    df = spark.createDataFrame([("a", 1.0, 9.0), ("b", 3.0, 8.0), ("c", 2.0, 1.0)],
                               "k string, v double, w double")
    got = S.chart_frame(df, "v", "k", 2, ranked_by="w", scale=100.0).collect()
    assert [tuple(r) for r in got] == [("a", 100.0), ("b", 300.0)]


def test_statistics_and_propagation_share_one_aggregate(spark):
    legs = descriptive.rotated(table_flights(spark, "/root/testdata/sf0.001"))
    both = M.route_stats_with_propagation(legs, 30)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Aggregate") == 1
    apart = M.route_stats(legs, 30).join(M.propagation(legs, "Route"), "Route", "left")
    assert rows(both.select(apart.columns)) == rows(apart) and both.count() > 0
