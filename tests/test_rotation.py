import random

import pytest
from pyspark.sql import functions as F

from flightops.operators import rotation as R
from flightops.operators.clean import clean_ops
from flightops.sources.tables import table_flights
from tests.conftest import day, rows

SCHEMA = ("FlightId string, TailNum string, FlightDate date, FlightDate_Numeric int, "
          "CRSDepTime int, CRSArrTime int, ArrTime int, ArrDelay int, DepDelay int")


def legs(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def leg(i, tail, d, dep, arr, arr_delay=0, dep_delay=0, crs_arr=None):
    return (i, tail, day(d), d, dep, crs_arr or arr, arr, arr_delay, dep_delay)


ROTATION = [
    leg("a", "N1", 1, 600, 700),          # first leg
    leg("b", "N1", 1, 730, 900, 20, 16),  # same day, 30 "minutes"
    leg("c", "N1", 1, 845, 1000, 15, 20),  # overlaps: no usable gap
    leg("d", "N1", 2, 600, 2350, 16, 30),  # next day
    leg("e", "N1", 3, 500, 600, 0, 0),    # next day, negative under the clock integers
    leg("f", "N1", 6, 500, 600),          # later
    leg("g", None, 1, 600, 700),
    leg("h", None, 1, 800, 900),
]


@pytest.mark.parametrize("hot", [{}, {"hot_rows": 0}])
def test_turnaround(spark, hot):
    got = R.with_turnaround(R.with_prev_leg(legs(spark, ROTATION), **hot))
    assert dict(rows(got, "FlightId", "TurnaroundTime")) == {
        "a": 999.0, "b": 0.5, "c": 999.0, "d": (1440 - 1000 + 600) / 60, "e": (1440 - 2350 + 500) / 60,
        "f": 999.0, "g": 999.0, "h": 999.0,
    }
    minutes = R.with_turnaround(R.with_prev_leg(legs(spark, ROTATION), **hot), clock="minutes")
    got = dict(rows(minutes, "FlightId", "TurnaroundTime"))
    assert got["e"] == (1440 - (23 * 60 + 50) + 300) / 60 and got["b"] == 0.5
    with pytest.raises(ValueError):
        R.with_turnaround(minutes, clock="other")


def test_missing_arrival_time_gives_no_turnaround(spark):
    df = legs(spark, [leg("a", "N1", 1, 600, None), leg("b", "N1", 1, 800, 900)])
    assert dict(rows(R.with_turnaround(R.with_prev_leg(df)), "FlightId", "TurnaroundTime"))[
        "b"] == 999.0


@pytest.mark.parametrize("hot", [{}, {"hot_rows": 0}])
def test_propagation_thresholds(spark, hot):
    got = R.with_propagation(R.with_prev_leg(legs(spark, ROTATION), **hot))
    assert dict((r[0], r[1:]) for r in rows(got, "FlightId", "PrevFlightDelay", "DelayPropagated"))\
        == {"a": (None, 0), "b": (0, 0), "c": (20, 1), "d": (15, 0), "e": (16, 0), "f": (0, 0),
            "g": (None, 0), "h": (None, 0)}


def test_cascade_label(spark):
    df = legs(spark, [
        leg("a", "N1", 1, 600, 700, 16, 0),
        leg("b", "N1", 1, 730, 900, 16, 16),   # a caused it
        leg("c", "N1", 1, 1000, 1100, 16, 15),  # next departs at the limit: no cascade
        leg("d", "N1", 2, 600, 700, 0, 50),    # other day: c caused nothing
        leg("e", "N2", 1, 2300, 2330, 99, 0),
        leg("f", "N2", 1, 2330, 100, 0, 99),   # gap of exactly 0
    ])
    got = R.cascade_label(df)
    assert rows(got, "FlightId", "CausedCascade", "TurnaroundTime") == [
        ("a", 1, 0.3), ("b", 0, 1.0), ("c", 0, 19.0), ("e", 0, 0.0)]
    minutes = R.cascade_label(df, clock="minutes")
    assert dict(rows(minutes, "FlightId", "TurnaroundTime"))["a"] == 0.5


def brute(data, within):
    groups, out = {}, {}
    for r in data:
        groups.setdefault((r[within] if within is not None else 0, r[1] or f"#{r[0]}"), []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r[3] if r[3] is not None else 10**9,
                                  r[4] if r[4] is not None else 10**6, r[0]))
        seen = {}
        for i, r in enumerate(group):
            seen[r[3]] = seen.get(r[3], 0) + 1
            prev, nxt = (group[i - 1] if i else None), (group[i + 1] if i + 1 < len(group) else None)
            out[r[0]] = (prev and prev[7], nxt and nxt[7], seen[r[3]])
    return out


@pytest.mark.parametrize("hot_rows", [0, 30, 10**9])
@pytest.mark.parametrize("within", [None, "DepDelay"])
def test_walk_matches_brute_force(spark, hot_rows, within):
    rng = random.Random(7)
    data = []
    for i in range(400):
        d = rng.choice([None, 1, 2, 3, 5, 5, 5])
        tail = rng.choice([None, "A", "A", "A", "B", "C", f"T{i % 9}"])
        data.append((f"f{i:03d}", tail, d and day(d), d and 2921 + d,
                     rng.choice([None, 5, 630, 645, 659, 700, 2359]), 0, 0, rng.randint(-5, 50),
                     rng.randint(0, 1)))
    walked = R.walk_rotation(
        legs(spark, data), previous=["ArrDelay"], following=["ArrDelay"], position="place",
        within=(within,) if within else (), hot_rows=hot_rows,
    ).select("FlightId", F.col("_prev.ArrDelay").alias("p"), F.col("_next.ArrDelay").alias("n"),
             "place")
    got = {r[0]: tuple(r[1:]) for r in walked.collect()}
    assert len(got) == len(data) and walked.count() == len(data)
    assert got == brute(data, 8 if within else None)


def test_heavy_tails_are_those_with_many_legs(spark):
    df = legs(spark, [leg(f"{t}{i}", t, 1, i, i) for t, n in (("A", 5), ("B", 2), (None, 9))
                      for i in range(n)])
    assert R.heavy_tails(df, 2) == ["A"]
    assert sorted(R.heavy_tails(df, 1)) == ["A", "B"]
    assert R.heavy_tails(df, 5) == [] == R.heavy_tails(df.limit(0), 5)
    assert R.heavy_tails(df, 0) is None  # every tail is walked in runs


def test_more_heavy_tails_than_a_plan_names(spark, monkeypatch):
    monkeypatch.setattr(R, "LISTED", 4)
    df = legs(spark, [leg(f"{t}{i}", f"T{t}", 1, i, i) for t in range(6) for i in range(3)])
    assert R.heavy_tails(df, 1) is None and R.heavy_tails(df, 3) == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot_rows, scans", [(10**6, 1), (300, 2), (0, 2)])
def test_scans_of_a_walk(spark, hot_rows, scans):
    """One scan, one exchange and no join without heavy tails; one more scan for run edges."""
    flights = table_flights(spark, "/root/testdata/sf0.001")
    walked = R.with_turnaround(R.with_prev_leg(clean_ops(flights), hot_rows=hot_rows))
    plan = plan_of(walked)
    assert plan.count("parquet") == scans and plan.count("Join") == scans - 1
    if scans == 1:
        assert walked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_spread_legs_carry_no_copies(spark):
    """The exchange of a walk takes the legs as they are: no keys, no structs of neighbours."""
    legs = spark.createDataFrame(
        [(1, "N1", day(1), 600, 5, 6), (2, "N1", day(1), 700, 7, 8), (3, None, day(1), 600, 1, 1)],
        "FlightId long, TailNum string, FlightDate date, CRSDepTime int, ArrDelay int, DepDelay int")
    walked = R.walk_rotation(legs, previous=["ArrDelay", "DepDelay"], following=["CRSDepTime"],
                             position="Place")
    plan = walked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    below = plan.split("RepartitionByExpression")[1]
    assert "_lone" in below and not any(s in below for s in ("struct", "_day", "_clock", "_tail"))
    executed = walked._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1
    found = rows(walked, "FlightId", "_prev.ArrDelay", "_next.CRSDepTime", "Place")
    assert found == [(1, None, 700, 1), (2, 5, None, 2), (3, None, None, 1)]
