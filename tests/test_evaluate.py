import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightops.operators import evaluate as E
from flightops.operators import features as X
from flightops.operators import tiers as T
from flightops.operators import training as L
from tests.conftest import day, rows

SCHEMA = f"{E.LABEL} int, {E.PRED} int, {E.SCORE} double"


def sample(spark, n=200, seed=1):
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        s = round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)
        data.append((y, int(s >= 0.5), s))
    return data, spark.createDataFrame(data, SCHEMA)


def test_counts_and_metrics(spark):
    data, df = sample(spark)
    cell = lambda y, p: sum(1 for r in data if r[:2] == (y, p))
    tn, fp, fn, tp = cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1)
    assert tuple(E.confusion_matrix(df).first()) == (tn, fp, fn, tp)
    m = E.binary_metrics(df).first()
    assert m.precision == tp / (tp + fp) and m.recall == tp / (tp + fn)
    assert m.f1 == 2 * tp / (2 * tp + fp + fn) and m.accuracy == (tp + tn) / len(data)
    report = {r["class"]: r for r in E.classification_report(df).collect()}
    assert report["Cascade"].support == tp + fn and report["Cascade"].f1 == m.f1
    assert report["accuracy"].f1 == m.accuracy and report["accuracy"].precision is None
    assert report["weighted avg"].recall == pytest.approx(m.accuracy)
    assert report["macro avg"].precision == pytest.approx(
        (tp / (tp + fp) + tn / (tn + fn)) / 2)


def test_undefined_metrics_are_zero(spark):
    m = E.binary_metrics(spark.createDataFrame([(0, 0, 0.1)], SCHEMA)).first()
    assert (m.f1, m.recall, m.precision, m.accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert E.roc_auc(spark.createDataFrame([(0, 0, 0.1)], SCHEMA)).first().auc is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_counts_pairs(spark, seed):
    data, df = sample(spark, 120, seed)
    pos = [s for y, _, s in data if y]
    neg = [s for y, _, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(df).first().auc == pytest.approx(want, abs=1e-12)


def test_curves(spark):
    data, df = sample(spark, 80)
    p, n = sum(r[0] for r in data), sum(1 - r[0] for r in data)
    points = set(rows(E.roc_curve(df)))
    want = {(None, 0.0, 0.0)}
    pr = {(None, 1.0, 0.0, p / (p + n))}
    for t in {r[2] for r in data}:
        tp = sum(1 for y, _, s in data if y and s >= t)
        fp = sum(1 for y, _, s in data if not y and s >= t)
        want.add((t, fp / n, tp / p))
        pr.add((t, tp / (tp + fp), tp / p, p / (p + n)))
    assert points == want and set(rows(E.pr_curve(df))) == pr


def test_histogram_matches_numpy(spark):
    data, df = sample(spark, 150)
    got = E.score_histogram(df, bins=10).collect()
    for label in (0, 1):
        density, edges = np.histogram([s for y, _, s in data if y == label], 10, density=True)
        mine = sorted((r for r in got if r.label == label), key=lambda r: r.bin)
        assert [r.low for r in mine] == pytest.approx(list(edges[:-1]))
        assert sum(r.legs for r in mine) == sum(1 for r in data if r[0] == label)
        assert sum(r.density for r in mine) == pytest.approx(sum(density))
    single = E.score_histogram(spark.createDataFrame([(1, 1, 0.5)], SCHEMA), bins=2).collect()
    assert [(r.bin, r.legs, r.low, r.density) for r in single] == [(0, 0, 0.0, 0.0), (1, 1, 0.5, 2.0)]


def test_cv_summary(spark):
    df = spark.createDataFrame([(1, 0.5, 0.4, 0.6), (2, 0.7, 0.4, 0.8)],
                               "ValFold int, f1 double, recall double, precision double")
    r = E.cv_summary(df).first()
    assert r.mean_f1 == pytest.approx(0.6) and r.std_f1 == pytest.approx(0.02 ** 0.5)
    assert r.std_recall == 0.0


def test_percentile_tiers_nest(spark):
    data, df = sample(spark, 400)
    tiered = T.risk_tiers(df)
    c, h, e = np.percentile([r[2] for r in data], [95, 90, 80])
    want = lambda s: ("CRITICAL" if s >= c else "HIGH" if s >= h
                      else "ELEVATED" if s >= e else "NORMAL")
    assert all(r.RiskTier == want(r[E.SCORE]) for r in tiered.collect())
    assert tuple(T.tier_thresholds(df).first()) == pytest.approx((c, h, e))
    counts = {r.RiskTier: r.legs for r in T.tier_distribution(tiered).collect()}
    assert sum(counts.values()) == 400 and set(counts) == set(T.TIERS)


def test_fixed_tiers_at_the_limits(spark):
    df = spark.createDataFrame([(s,) for s in (0.5, 0.3, 0.15, 0.1499)], f"{E.SCORE} double")
    got = rows(T.risk_tiers(df, mode="fixed"), E.SCORE, "RiskTier", "CascadePrediction")
    assert got == [(0.1499, "NORMAL", 0), (0.15, "ELEVATED", 0), (0.3, "HIGH", 1),
                   (0.5, "CRITICAL", 1)]
    empty = {r.RiskTier: r.pct for r in T.tier_distribution(
        T.risk_tiers(df.filter(f"{E.SCORE} > 0.4"), mode="fixed")).collect()}
    assert empty == {"CRITICAL": 100.0, "HIGH": 0.0, "ELEVATED": 0.0, "NORMAL": 0.0}
    with pytest.raises(ValueError):
        T.risk_tiers(df, mode="other")


def test_leakage_checks(spark):
    df = spark.createDataFrame(
        [("a", "train", day(1), 10.0), ("b", "train", day(2), 10.0), ("c", "test", day(3), 10.1)],
        "FlightId string, split string, FlightDate date, RouteAvgDelay double")
    legs = df.select("*", *[F.lit(1).alias(c) for c in (
        "Origin", "Dest", "UniqueCarrier", "ArrDelay", "DepDelay", "TaxiOut", "TaxiIn")])
    recall = spark.createDataFrame([(0.97,)], "recall double")

    def checks(source):
        stats = X.history_tables(X.history_cells(source))
        return {(r.check, r.measure.split()[0]): (r.value, r.status)
                for r in T.leakage_checks(df, {"route": stats["route"]}, recall).collect()}

    assert checks(legs.filter("split = 'train'")) == {
        ("temporal_order", "days"): (1.0, "PASS"),
        ("feature_drift", "RouteAvgDelay"): (1.0, "WARNING"),
        ("statistics_source", "route"): (1.0, "PASS"),
        ("recall_sanity", "test"): (0.97, "WARNING")}
    # test legs in the statistics, a missing leg, and as many legs that are others
    for source in (legs, legs.filter("FlightId = 'a'"), legs.filter("FlightId <> 'a'"),
                   legs.limit(0)):
        assert checks(source)["statistics_source", "route"][1] == "FAIL"
    same_day = spark.createDataFrame([("a", "train", day(3), 1.0), ("b", "test", day(3), 2.0)],
                                     df.schema)
    assert T.leakage_checks(same_day, {}).filter("check = 'temporal_order'").first().status == "FAIL"


def test_trees_do_not_depend_on_cached_node_ids(spark):
    df = sample(spark, 400)[1].withColumns({"Hour": F.col(E.SCORE) * 10, "Month": F.col(E.PRED)}).cache()
    small = {"maxIter": 3, "maxDepth": 4}
    plain, cached = (L.train_cascade(df, ("Hour", "Month"), **small, **o).stages[1]
                     for o in ({}, {"cacheNodeIds": True}))
    assert not plain.getCacheNodeIds()  # an id per row at every level of every tree
    assert plain.toDebugString.split("\n")[1:] == cached.toDebugString.split("\n")[1:]
