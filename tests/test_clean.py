from pyspark.sql import functions as F

from flightops.operators import clean as C
from tests.conftest import day

SCHEMA = ("FlightId string, TailNum string, FlightDate date, CRSDepTime int, CRSArrTime int, "
          "Origin string, Dest string, TaxiOut int, TaxiIn int, ArrDelay int, DepDelay int, "
          "Distance int, ActualElapsedTime int, Cancelled int, Diverted int")
GOOD = dict(FlightId="good", TailNum="N1", FlightDate=day(1), CRSDepTime=900, CRSArrTime=1000,
            Origin="A", Dest="B", TaxiOut=10, TaxiIn=5, ArrDelay=0, DepDelay=0, Distance=300,
            ActualElapsedTime=60, Cancelled=0, Diverted=0)


def frame(spark, *changes):
    data = [GOOD] + [GOOD | {"FlightId": f"r{i}"} | c for i, c in enumerate(changes)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], SCHEMA)


def kept(df):
    return {r.FlightId for r in df.select("FlightId").collect()}


def test_split_cancelled(spark):
    df = frame(spark, dict(Cancelled=1), dict(Cancelled=None))
    flown, cancelled = C.split_cancelled(df)
    assert kept(flown) == {"good"} and kept(cancelled) == {"r0"}


def test_clean_ops_rules(spark):
    df = frame(
        spark, dict(Cancelled=1), dict(TaxiIn=None), dict(TaxiOut=0), dict(TaxiOut=200),
        dict(TaxiOut=199), dict(Distance=0), dict(ActualElapsedTime=0), dict(Diverted=1),
    )
    cleaned = C.clean_ops(df)
    assert kept(cleaned) == {"good", "r4", "r7"}
    assert {r.Cancelled for r in cleaned.collect()} == {"NO"}


def test_clean_cascade_rules(spark):
    df = frame(
        spark, dict(Cancelled=1), dict(Diverted=1), dict(TailNum=None), dict(CRSArrTime=None),
        dict(ArrDelay=601), dict(ArrDelay=600), dict(ArrDelay=-61), dict(ArrDelay=-60),
        dict(Distance=0), dict(TaxiOut=None),
    )
    assert kept(C.clean_cascade(df)) == {"good", "r5", "r7", "r9"}
    assert kept(C.clean_cascade(df.drop("Diverted"))) == {"good", "r1", "r5", "r7", "r9"}


def test_cleaning_report(spark):
    df = frame(spark, dict(Cancelled=1), dict(TaxiIn=None), dict(TaxiOut=0), dict(TailNum="N2"))
    r = C.cleaning_report(df).first()
    assert (r.initial_rows, r.cancelled_rows, r.missing_field_rows, r.invalid_value_rows) == (
        5, 1, 1, 1)
    assert (r.cleaned_rows, r.removed_rows, r.aircraft, r.retention_pct) == (2, 3, 2, 40.0)
    r = C.cleaning_report(df.filter("1 = 0"), "cascade").first()
    assert r.initial_rows == 0 and r.retention_pct is None


def test_airtime_and_route(spark):
    df = frame(spark, dict(ActualElapsedTime=1000), dict(ActualElapsedTime=1), dict(Dest=None))
    got = C.with_route(C.with_airtime(df)).orderBy("FlightId")
    good, long, short, nowhere = got.collect()
    assert good.ExpectedAirTime == 40.0 and good.AirTimeDeviation == 20.0
    assert (good.AirTimeDeviationPct, long.AirTimeDeviationPct, short.AirTimeDeviationPct) == (
        50.0, 200.0, -50.0)
    assert good.Route == "A-B" and nowhere.Route is None


def test_turnaround_penalty(spark):
    hours = [0.0, 0.5, 1.0, 1.49, 1.5, 23.9, 24.0, 999.0, -2.0]
    df = spark.createDataFrame([(h,) for h in hours], "TurnaroundTime double")
    got = C.with_turnaround_penalty(df).orderBy(F.monotonically_increasing_id()).collect()
    assert [r.TurnaroundInefficiency for r in got] == [0, 75, 25, 25, 0, 0, 0, 0, 0]
