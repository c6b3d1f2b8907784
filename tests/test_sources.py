import pytest

from flightops.operators.clean import coerce_numeric, with_flight_date
from flightops.sources import read_carriers, read_flight_rejects, read_flights, tables
from tests.conftest import day, rows

HEADER = ("Month,Year,DayofMonth,CRSDepTime,UniqueCarrier,FlightNum,TailNum,Origin,Dest,ArrDelay,"
          "DepDelay,Cancelled,Note\n")


@pytest.fixture
def folder(tmp_path):
    text = HEADER + (
        "1,2008,3,900,WN,1,N1,LAX,JFK,12,NA,0,caf\xe9\n"
        "2,2008,31,1000,WN,2,NA,LAX,JFK,x,5,0,plain\n"
        "1,2008,4,1100,AA,3,N2,SFO,JFK,-4,0,1,plain\n"
    )
    (tmp_path / "airline.csv").write_bytes(text.encode("latin-1"))
    (tmp_path / "carriers.csv").write_text('Code,Description\nWN,"Southwest, Inc."\nNA,North\n')
    return str(tmp_path)


def test_read_flights_by_header(spark, folder):
    df = read_flights(spark, folder)
    assert dict(df.dtypes)["ArrDelay"] == "int" and dict(df.dtypes)["Note"] == "string"
    assert rows(df, "FlightNum", "ArrDelay", "DepDelay", "TailNum", "Note") == [
        (1, 12, None, "N1", "caf\xe9"), (2, None, 5, None, "plain"), (3, -4, 0, "N2", "plain"),
    ]
    assert df.select("FlightId").distinct().count() == 3


def test_first_name_wins_and_limit(spark, folder, tmp_path):
    (tmp_path / "airline.csv.shuffle").write_text(HEADER + "1,2008,3,9,WN,7,N1,A,B,1,1,0,\n" * 3)
    assert read_flights(spark, folder).count() == 3
    assert read_flights(spark, folder, limit=2).count() == 2


def test_missing_files_give_empty_frames(spark, tmp_path):
    flights = read_flights(spark, str(tmp_path / "none"))
    assert flights.count() == 0 and "FlightId" in flights.columns
    assert read_carriers(spark, str(tmp_path / "none")).count() == 0


def test_carriers(spark, folder):
    assert rows(read_carriers(spark, folder)) == [("NA", "North"), ("WN", "Southwest, Inc.")]


def test_flight_date(spark, folder):
    dated = with_flight_date(read_flights(spark, folder))
    assert rows(dated, "FlightNum", "FlightDate") == [(1, day(3)), (2, None), (3, day(4))]
    with pytest.raises(Exception):
        with_flight_date(read_flights(spark, folder), strict=True).collect()
    other = read_flights(spark, folder).withColumnRenamed("DayofMonth", "DayOfMonth")
    assert rows(with_flight_date(other), "FlightDate")[1] == (day(3),)


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1",), ("NA",), (None,), ("2.5",)], "a string")
    assert rows(coerce_numeric(df, ("a",))) == [(None,), (None,), (1.0,), (2.5,)]


def test_malformed_lines_are_rejected(spark, folder, tmp_path):
    """Lines cut short or with a field too many go to the rejects; bad numbers stay, as nulls."""
    path = tmp_path / "airline.csv"
    path.write_bytes(path.read_bytes() + b"1,2008,5\n1,2008,5,9,WN,8,N1,A,B,1,1,0,note,more\n")
    flights, rejects = read_flights(spark, folder), read_flight_rejects(spark, folder)
    assert rows(flights, "FlightNum", "ArrDelay") == [(1, 12), (2, None), (3, -4)]
    assert flights.count() == 3 and rejects.count() == 2
    assert rows(rejects, "line", "reason") == [
        ("1,2008,5", "not 13 fields"), ("1,2008,5,9,WN,8,N1,A,B,1,1,0,note,more", "not 13 fields")]
    assert all(r.file.endswith("airline.csv") for r in rejects.collect())
    assert read_flight_rejects(spark, str(tmp_path / "none")).count() == 0


def test_lines_are_spread_before_they_widen(spark, monkeypatch):
    """What is shuffled of a small table is the line, by its key and not by turns, which sorts."""
    monkeypatch.setattr(tables, "remembered", lambda spark, name, sources, build: build())
    monkeypatch.setattr(tables, "staged", lambda spark, name, build, sources: build())
    flights = tables.table_flights(spark, "/root/testdata/sf0.001")
    plan = flights._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Repartition")  # below the join
    assert "RepartitionByExpression [l_orderkey" in plan
    assert flights.count() == spark.read.parquet(
        "/root/testdata/sf0.001/lineitem.parquet").count()
