import math
import random

import pytest
from pyspark.sql import functions as F

from flightops.operators import features as X
from flightops.operators import split as P
from flightops.schema import FEATURES
from tests.conftest import day, rows


def test_feature_list():
    assert len(FEATURES) == 28 and len(set(FEATURES)) == 28


def test_temporal_and_flight_features(spark):
    df = spark.createDataFrame(
        [("a", day(5), 559, 499, 60), ("b", day(7), 2100, 500, None), ("c", day(40), 30, 1500, 5)],
        "FlightId string, FlightDate date, CRSDepTime int, Distance int, CRSElapsedTime int",
    )
    got = X.flight_features(X.temporal_features(df))
    assert rows(got, "FlightId", "Hour", "DayOfWeek", "Month", "IsWeekend", "IsRushHour",
                "IsEarlyMorning", "IsLateNight") == [
        ("a", 5, 5, 1, 1, 0, 1, 0), ("b", 21, 0, 1, 0, 0, 0, 1), ("c", 0, 5, 2, 1, 0, 0, 1)]
    assert rows(got, "FlightId", "IsShortHaul", "IsMediumHaul", "IsLongHaul") == [
        ("a", 1, 0, 0), ("b", 0, 1, 0), ("c", 0, 0, 1)]


def test_incoming_delay_stays_inside_the_split(spark):
    df = spark.createDataFrame(
        [("a", "N1", day(1), 900, 30, 20, "train", 0.9), ("b", "N1", day(1), 1200, 5, 4, "train", 0.74),
         ("c", "N1", day(2), 900, 7, 6, "test", 2.0)],
        "FlightId string, TailNum string, FlightDate date, CRSDepTime int, ArrDelay int, DepDelay int,"
        " split string, TurnaroundTime double",
    )
    got = X.utilization_features(
        X.turnaround_features(X.incoming_features(X.rotation_features(df))))
    assert rows(got, "FlightId", "IncomingDelay", "IncomingDepDelay", "HasIncomingDelay",
                "PositionInRotation", "IsFirstFlight") == [
        ("a", 0.0, 0.0, 0, 1, 1), ("b", 30.0, 20.0, 1, 2, 0), ("c", 0.0, 0.0, 0, 1, 1)]
    assert rows(got, "FlightId", "TightTurnaround", "CriticalTurnaround", "InsufficientBuffer") == [
        ("a", 1, 0, 0), ("b", 1, 1, 1), ("c", 0, 0, 0)]


def test_history_and_fill(spark):
    train = spark.createDataFrame(
        [("A", "B", "X", 10, 1, 8, 4), ("A", "B", "X", 20, 3, 10, 6), ("A", "C", "Y", 90, 5, 12, 8)],
        "Origin string, Dest string, UniqueCarrier string, ArrDelay int, DepDelay int, TaxiOut int,"
        " TaxiIn int",
    )
    stats = X.history_tables(X.history_cells(train))
    route = {(r.Origin, r.Dest): r for r in stats["route"].collect()}
    ab, ac = route["A", "B"], route["A", "C"]
    assert ab.RouteAvgDelay == 15.0 and math.isclose(ab.RouteStdDelay, 50 ** 0.5)
    assert math.isclose(ab.RouteRobustnessScore, 100 - 50 ** 0.5) and ab.RouteMedianDelay == 15.0
    assert ac.RouteStdDelay is None and ac.RouteRobustnessScore == 70.0
    joined = X.apply_history(
        spark.createDataFrame([("A", "B", "X"), ("Z", "C", None)],
                              "Origin string, Dest string, UniqueCarrier string"), stats)
    assert rows(joined, "Origin", "RouteAvgDelay", "OriginCongestion", "DestCongestion",
                "CarrierAvgDelay") == [("A", 15.0, 10.0, 5.0, 15.0), ("Z", None, None, 8.0, None)]
    no_carrier = X.apply_history(train.select("Origin", "Dest"),
                                 {k: v for k, v in stats.items() if k != "carrier"})
    assert "CarrierAvgDelay" not in no_carrier.columns

    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)],
                               "Distance double, OriginCongestion double")
    filled = X.fill_features(df, X.train_medians(df))
    assert rows(filled) == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]


def test_select_features_warns(spark):
    df = spark.createDataFrame([(1, 2)], "Hour int, other int")
    with pytest.warns(UserWarning, match="missing features"):
        assert X.select_features(df).columns == ["Hour"]


def test_temporal_split_uses_the_interpolated_day(spark):
    df = spark.createDataFrame([(day(d),) for d in (1, 2, 3, 6)], "FlightDate date")
    # quantile day is 3.75: day 3 trains, day 6 tests
    assert rows(P.temporal_split(df).groupBy("split").count()) == [("test", 1), ("train", 3)]
    parts = P.temporal_split(df).groupBy("split").agg(
        F.min("FlightDate").alias("a"), F.max("FlightDate").alias("b")).collect()
    by = {r.split: r for r in parts}
    assert by["train"].b < by["test"].a


@pytest.mark.parametrize("parts, minutes", [(None, [5, 600, 601, 2300]), (64, [600])])
def test_time_index_matches_sort(spark, parts, minutes):
    rng = random.Random(3)
    data = [(f"f{i:03d}", day(rng.randint(1, 5) if parts is None else 1), rng.choice(minutes))
            for i in range(200)]
    df = spark.createDataFrame(data, "FlightId string, FlightDate date, CRSDepTime int")
    want = {r[0]: i for i, r in enumerate(sorted(data, key=lambda r: (r[1], r[2], r[0])))}
    got = P.with_time_index(df, parts=parts)
    assert dict(rows(got, "FlightId", "TimeIndex")) == want
    if parts:  # all legs are of one minute, which is cut into ranges
        assert len(got.inputFiles()) > 32


@pytest.mark.parametrize("n", [4, 13, 60])
def test_folds(spark, n):
    folds = P.time_series_folds(spark.range(n).withColumnRenamed("id", "TimeIndex"))
    size, got = n // 6, dict(rows(folds, "TimeIndex", "ValFold"))
    for i in range(n):
        before = n - 5 * size
        assert got[i] == ((i - before) // size + 1 if size and i >= before else 0)
    if n == 13:
        assert rows(P.fold_profile(folds)) == [
            (f, 2, 1 + 2 * f, 2 + 2 * f, 1 + 2 * f) for f in range(1, 6)]


def test_label_distribution(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "CausedCascade int")
    assert rows(P.label_distribution(df)) == [(0, 2, 66.67), (1, 1, 33.33)]
