import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightops import session
from flightops.functions import clip, hhmm_to_minutes, ratio, round_to
from flightops.functions.ordered import exact_quantiles, running_totals
from tests.conftest import rows


def one(spark, column, **values):
    names = ", ".join(f"{'NULL' if v is None else v} AS {k}" for k, v in values.items())
    return spark.sql(f"SELECT {names}").select(column.alias("x")).first().x


def test_clip_keeps_null(spark):
    assert one(spark, clip(F.col("a").cast("double"), 0, 60), a=None) is None
    assert one(spark, clip(F.col("a"), 0, 60), a=-5) == 0.0
    assert one(spark, clip(F.col("a"), 0, 60), a=75) == 60.0
    assert one(spark, clip(F.col("a"), low=0), a=75) == 75.0


def test_round_half_even(spark):
    assert one(spark, round_to(F.col("a"), 0), a="2.5D") == 2.0
    assert one(spark, round_to(F.col("a"), 1), a="0.25D") == 0.2
    assert one(spark, round_to(F.col("a"), 1), a="0.35D") == np.round(0.35, 1)
    assert one(spark, round_to(F.col("a").cast("double"), 2), a=None) is None


def test_ratio_and_clock(spark):
    assert one(spark, ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, ratio(F.col("a"), F.col("b")), a=1, b=4) == 0.25
    assert one(spark, hhmm_to_minutes(F.col("a")), a=1430) == 870
    assert one(spark, hhmm_to_minutes(F.col("a")), a=5) == 5


@pytest.mark.parametrize("seed, cell_rows", [(1, 1 << 17), (2, 40), (3, 40)])
def test_running_totals_match_brute_force(spark, seed, cell_rows):
    rng = random.Random(seed)
    values = sorted({rng.random() ** 6 for _ in range(300)} | {0.0, 1.0})
    if seed == 3:  # all within 1e-9 of each other
        values = [0.5 + i * 2e-12 for i in range(300)]
    data = [(v, rng.randint(0, 9)) for v in values]
    totals = running_totals(spark.createDataFrame(data, "x double, n long"), "x", ["n"], cell_rows)
    got = rows(totals)
    if cell_rows < 300:
        cells = spark.read.parquet(*{f.rpartition("/")[0] for f in totals.inputFiles()})
        sizes = [r["count"] for r in cells.groupBy("_cell").count().collect()]
        assert len(sizes) > 5 and max(sizes) <= cell_rows
    total, want = 0, []
    for v, n in data:
        want.append((v, n, total))
        total += n
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 7, 101])
def test_exact_quantiles_match_numpy(spark, n):
    rng = random.Random(n)
    values = [round(rng.random(), 2) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", {"a": 0.95, "b": 0.9, "c": 0.8, "d": 0.0, "e": 1.0}).first()
    want = np.percentile(values, [95, 90, 80, 0, 100])
    assert [got[c] for c in "abcde"] == pytest.approx(list(want), abs=1e-12)


def test_size_shuffles_only_raises(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session.size_shuffles(spark, (f"{tmp_path}/t",))
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        monkeypatch.setattr(session, "_PARTITION_BYTES", 100)
        session.size_shuffles(spark, (f"{tmp_path}/t",))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > int(before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffles_are_sized_for_rows_in_memory(spark, monkeypatch):
    """A leg takes about 250 bytes in a sort, its line under 18 in a file."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session, "stored_bytes", lambda spark, sources: 1 << 30)
    try:
        session.size_shuffles(spark, ("any",))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert (1 << 30) / 18 * 250 / parts <= 128 << 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
