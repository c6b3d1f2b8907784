"""Whole runs on the small tables: descriptive tables, training, artifacts."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flightops.operators import serving as V
from flightops.operators import training as L
from flightops.operators.evaluate import SCORE
from flightops.plans import descriptive, predictive
from flightops.schema import FEATURES
from flightops.session import drop_staged, remembered, staged
from flightops.sources import parse_json_requests, sinks, split_bad_requests
from flightops.sources.tables import table_carriers, table_flights
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    return path, predictive.run_training(
        table_flights(spark, SMALL), path, k=2, maxIter=3, maxDepth=4)


def test_descriptive_tables(spark, tmp_path):
    tables = descriptive.descriptive_tables(table_flights(spark, SMALL), table_carriers(spark, SMALL))
    sinks.write_results({n: tables[n] for n in ("carriers", "cleaning")}, f"{tmp_path}/p")
    sinks.write_results({"carriers": tables["carriers"]}, f"{tmp_path}/c", "csv")
    back = spark.read.parquet(f"{tmp_path}/p/carriers")
    assert back.count() == 10 and back.filter("Description IS NULL").count() == 0
    text = spark.read.option("header", True).csv(f"{tmp_path}/c/carriers")
    assert set(text.columns) == set(back.columns) and text.count() == 10


def test_split_has_no_overlap(run):
    parts = run[1].prepared.labelled.groupBy("split").agg(
        F.min("FlightDate").alias("a"), F.max("FlightDate").alias("b")).collect()
    by = {r.split: r for r in parts}
    assert by["train"].b < by["test"].a


def test_features_are_complete(run):
    features = run[1].prepared.features
    holes = features.select([F.count_if(F.col(f).isNull()).alias(f) for f in FEATURES]).first()
    assert set(holes) == {0}


def test_metrics_and_checks(run):
    result = run[1]
    m = result.metrics.first()
    assert 0.5 < m.auc <= 1 and 0 <= m.f1 <= 1
    checks = {r.check: r.status for r in result.checks.collect()}
    assert checks["temporal_order"] == "PASS" and "recall_sanity" in checks
    assert result.cv.count() == 1


def test_artifacts(spark, run):
    path, result = run
    model = sinks.load_model(path)
    test = result.prepared.features.filter("split = 'test'")
    assert rows(L.score(test, model), "FlightId", SCORE) == rows(result.scored, "FlightId", SCORE)
    history = sinks.read_history(spark, path)
    assert set(history) == {"route", "origin", "dest", "carrier"}
    assert rows(history["route"]) == rows(result.prepared.history["route"])
    importance = spark.read.option("header", True).csv(f"{path}/feature_importance")
    assert importance.count() == 28
    part = next(Path(path, "metadata").glob("part-*.json"))
    record = json.loads(part.read_text())
    assert record["performance"]["auc_roc"] == result.metrics.first().auc
    assert record["data_leakage_checks"]["temporal_split"] == "PASS"
    assert record["features"] == list(FEATURES)
    assert record["risk_tiers"]["critical_threshold"] >= record["risk_tiers"]["high_threshold"]


def test_training_run_is_a_set(spark, run):
    path, result = run
    back = sinks.read_set(spark, path)
    assert set(back) == {*(f"history_{n}" for n in result.prepared.history), "metadata", "features",
                         "importance"}
    assert [r.feature for r in back["features"].orderBy("position").collect()] == list(FEATURES)
    test = result.prepared.features.filter("split = 'test'")
    model = sinks.read_set_model(spark, path)
    assert rows(L.score(test, model), "FlightId", SCORE) == rows(result.scored, "FlightId", SCORE)


def test_class_weight_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "CausedCascade int")
    assert L.class_weight(df).first().weight is None
    assert {r.ClassWeight for r in L.with_class_weight(df).collect()} == {1.0}


def test_batch_scoring(spark, run):
    path, _ = run
    df = spark.createDataFrame(
        [("a", '{"origin": "A1", "dest": "B2", "incoming_delay": 60}'), ("b", "nope")],
        "RequestId string, value string")
    good, bad = split_bad_requests(parse_json_requests(df))
    response = V.score_batch(good, sinks.load_model(path), sinks.read_history(spark, path)).collect()
    body = json.loads(response[0].response)
    assert len(response) == 1 and 0 <= body["predictions"][0]["cascade_probability"] <= 1
    assert bad.count() == 1


def test_staged_tables_follow_their_sources(spark, tmp_path):
    source = f"{tmp_path}/in"

    def table(n=1):
        return staged(spark, "t", lambda: spark.read.parquet(source).selectExpr(
            f"id + {n} AS id"), (source,))

    spark.range(3).write.parquet(source)
    first = table()
    assert rows(first) == [(1,), (2,), (3,)]
    assert table() is first  # the same table again, without reading its folder
    assert rows(table(5)) == [(5,), (6,), (7,)]  # another plan over the same files
    spark.range(5).write.mode("append").parquet(source)
    assert table().count() == 8


def test_stored_tables_leave_no_shuffle_files(spark):
    """What a write shuffled is not kept beside the table; other jobs keep theirs as set."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        names = {files.apply(i).getName() for i in range(files.size())}
        return {n for n in names if n.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    known, setting = shuffled(), spark.conf.get(name)
    counts = staged(spark, "counts", lambda: spark.range(0, 10_000, 1, 4).groupBy(
        (F.col("id") % 1000).alias("key")).agg(F.sum("id").alias("total")))
    end = time.time() + 10
    while (left := shuffled() - known) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(name) == setting
    assert rows(counts)[7] == (7, sum(range(7, 10_000, 1000))) and counts.count() == 1000


def test_remembered_results_follow_their_sources(spark, tmp_path, monkeypatch):
    source, built = f"{tmp_path}/in", []

    def build():
        built.append(spark.read.parquet(source))
        return built[-1]

    spark.range(3).write.parquet(source)
    first = remembered(spark, "r", (source,), build)
    monkeypatch.setattr(type(spark), "read", None)  # a hit plans and lists nothing
    assert remembered(spark, "r", (source,), build) is first and len(built) == 1
    monkeypatch.undo()
    spark.range(5).write.mode("append").parquet(source)
    assert remembered(spark, "r", (source,), build).count() == 8 and len(built) == 2


def test_staged_tables_follow_their_plan(spark):
    folder = "/root/testdata/sf0.001"
    flights = table_flights(spark, folder)
    sources = (f"{folder}/lineitem.parquet",)
    count = lambda df: descriptive.carrier_table(
        descriptive.measured(df), table_carriers(spark, folder), sources=sources
    ).agg(F.sum("FlightCount")).first()[0]
    assert count(flights.filter("Month = 1")) == 1524
    assert count(flights) == 5875


def test_drop_staged(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(3).write.parquet(source)
    first = staged(spark, "d", lambda: spark.read.parquet(source), (source,))
    path = Path(first.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists()
    drop_staged(spark)
    assert not path.exists()
    assert staged(spark, "d", lambda: spark.read.parquet(source), (source,)).count() == 3


@pytest.fixture
def tables(spark):
    return {"one": spark.createDataFrame([(1, "a", 0.1), (2, None, None)], "n int, t string, x double"),
            "two": spark.range(5), "none": spark.range(0)}


def test_sets_are_read_as_written(spark, tmp_path, tables):
    path = str(tmp_path)
    first = sinks.write_set(tables, path, {"one": "csv", "two": "json"})
    back = sinks.read_set(spark, path)
    assert {n: rows(back[n]) for n in back} == {n: rows(t) for n, t in tables.items()}
    assert {n: back[n].dtypes for n in back} == {n: t.dtypes for n, t in tables.items()}
    second = sinks.write_set({"two": spark.range(3)}, path)
    assert sinks.read_set(spark, path)["two"].count() == 3  # the last version
    assert sinks.read_set(spark, path, first)["two"].count() == 5  # the older one is still there
    assert [v.rpartition("/")[2] for v in sinks.published(spark, path)] == [
        v.rpartition("/")[2] for v in (first, second)]


def test_broken_sets_are_refused(spark, tmp_path, tables):
    path = str(tmp_path)
    with pytest.raises(sinks.BrokenSet):
        sinks.read_set(spark, path)
    first, second = (sinks.write_set({"two": spark.range(n)}, path) for n in (5, 6))
    # a version that was not finished is not read; the one before it is
    half = sinks.write_set({"two": spark.range(9)}, path)
    Path(half, "manifest", "_SUCCESS").unlink()
    assert sinks.read_set(spark, path)["two"].count() == 6
    with pytest.raises(sinks.BrokenSet):
        sinks.read_set(spark, path, half)
    # a member of another version, with as many rows, and one that is gone
    spark.range(1, 7).write.mode("overwrite").parquet(f"{second}/two")
    with pytest.raises(sinks.BrokenSet):
        sinks.read_set(spark, path, second)
    assert sinks.read_set(spark, path, first)["two"].count() == 5
    for part in Path(first, "two").glob("*"):
        part.unlink()
    with pytest.raises(sinks.BrokenSet):
        sinks.read_set(spark, path, first)


def test_legs_carry_only_what_is_read(spark):
    """Every walk shuffles the legs, so columns that nothing reads are left behind."""
    legs = predictive.labelled_legs(table_flights(spark, SMALL))
    assert set(legs.columns) == {*predictive.LEG_COLUMNS, "split"}
