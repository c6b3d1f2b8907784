import json

import pytest

from flightops.operators import serving as V
from flightops.schema import FEATURES
from flightops.sources import parse_csv_requests, parse_json_requests, split_bad_requests
from tests.conftest import rows

LINE = ",".join(str(x) for x in [*range(101, 121), *(n + 0.25 for n in range(201, 209))])


def requests(spark, *values):
    return spark.createDataFrame(
        [(f"r{i}", v if isinstance(v, str) or v is None else json.dumps(v))
         for i, v in enumerate(values)], "RequestId string, value string")


@pytest.fixture
def stats(spark):
    return {
        "route": spark.createDataFrame(
            [("LAX", "JFK", 1.0, 2.0, 3.0), ("LAX", "SFO", 4.0, None, 70.0)],
            "Origin string, Dest string, RouteAvgDelay double, RouteStdDelay double,"
            " RouteRobustnessScore double"),
        "origin": spark.createDataFrame(
            [("LAX", 5.5, 6.5)], "Origin string, Origin_AvgDepDelay double, OriginCongestion double"),
        "dest": spark.createDataFrame(
            [("JFK", 7.5, 8.5)], "Dest string, Dest_AvgArrDelay double, DestCongestion double"),
    }


def test_csv_requests(spark):
    df = requests(spark, LINE, " " + LINE.replace(",", " , ") + "\n", "1,2", LINE.replace("108", "x"),
                  None)
    got = parse_csv_requests(df).orderBy("RequestId").collect()
    want = [float(x) for x in LINE.split(",")]
    assert got[0].features == want and got[1].features == want
    assert [r._error is None for r in got] == [True, True, False, False, False]


def test_json_requests(spark):
    numbers = [float(x) for x in LINE.split(",")]
    df = requests(
        spark, {"features": numbers}, {"features": numbers[:5]}, {"origin": "LAX", "dest": "JFK"},
        {"origin": "LAX"}, {}, "{broken", None,
        {"origin": "a", "dest": "b", "scheduled_departure_time": "noon"},
        {"origin": "a", "dest": "b", "distance": "abc", "incoming_delay": "1h"},
        {"origin": "a", "dest": "b", "distance": "12.5", "incoming_delay": "1h"},
    )
    good, bad = split_bad_requests(parse_json_requests(df))
    assert {r.RequestId for r in good.collect()} == {"r0", "r2"}
    assert dict(rows(bad, "RequestId", "_error")) == {
        "r1": "features must have 28 numbers",
        **{r: "JSON must have features or a raw flight" for r in ("r3", "r4", "r5", "r6")},
        "r7": "bad scheduled_departure_time", "r8": "bad distance", "r9": "bad incoming_delay",
    }


def features(spark, stats, *values):
    good, _ = split_bad_requests(parse_json_requests(requests(spark, *values)))
    return [r.asDict() for r in V.request_features(good, stats).orderBy("RequestId").collect()]


def test_raw_defaults(spark, stats):
    r, = features(spark, stats, {"origin": "aaa", "dest": "bbb"})
    assert [r[f] for f in FEATURES] == [
        12, 2, 6, 0, 0, 0, 0, 800, 120, 0, 0, 0, 0, 120, 0, 0, 0, 1, 1, 1, 0,
        5, 15, 70, 8, 15, 6, 12]


def test_raw_fields(spark, stats):
    full = {"origin": "lax", "dest": "jfk", "scheduled_departure_time": "19:05", "day_of_week": 5,
            "month": 11, "distance": 231, "crs_elapsed_time": 77, "incoming_delay": 33,
            "incoming_dep_delay": 41, "turnaround_time": 58, "position_in_rotation": 6}
    r, = features(spark, stats, full)
    assert [r[f] for f in FEATURES] == [
        19, 5, 11, 1, 0, 0, 0, 231, 77, 1, 33, 1, 41, 58, 1, 0, 1, 6, 0, 0, 1,
        1, 2, 3, 5.5, 6.5, 7.5, 8.5]
    hours = [x["Hour"] for x in features(
        spark, stats, full | {"scheduled_departure_time": 18}, full | {"scheduled_departure_time": "7"},
        full | {"scheduled_departure_time": 1430},
        {"origin": "a", "dest": "b", "hour": 3})]
    assert hours == [18, 7, 1430, 3]


def test_known_route_keeps_null_and_unknown_gets_default(spark, stats):
    known, unknown = features(spark, stats, {"origin": "LAX", "dest": "SFO"},
                              {"origin": "LAX", "dest": "XXX"})
    assert known["RouteStdDelay"] is None and known["RouteAvgDelay"] == 4.0
    assert unknown["RouteStdDelay"] == 15.0 and unknown["OriginCongestion"] == 6.5


def test_feature_and_raw_requests_mix(spark, stats):
    numbers = [float(x) for x in LINE.split(",")]
    a, b = features(spark, stats, {"features": numbers}, {"origin": "LAX", "dest": "JFK"})
    assert [a[f] for f in FEATURES] == numbers and b["RouteAvgDelay"] == 1.0


def test_response_shape(spark):
    scored = spark.createDataFrame(
        [("r", 0.6, 1, "CRITICAL", "do")],
        "RequestId string, CascadeProbability double, CascadePrediction int, RiskTier string,"
        " RecommendedAction string")
    body = json.loads(V.format_response(scored).first().response)
    assert body["predictions"] == [{
        "cascade_probability": 0.6, "cascade_prediction": 1, "risk_tier": "CRITICAL",
        "recommended_action": "do"}]
    assert body["model_version"] == "2.0" and body["timestamp"].endswith("Z")


def test_bodies_are_parsed_once(spark):
    """A filter on the error does not repeat the parser for the fields it reads."""
    _, bad = split_bad_requests(parse_json_requests(requests(spark, "{", {"origin": "a"}, None)))
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert rows(bad, "RequestId") == [("r0",), ("r1",), ("r2",)]
