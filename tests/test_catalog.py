"""Registered queries against their SQL.

A part runs by default; ``FLIGHTOPS_ALL=1`` runs every query.
"""

import os

import pytest

from __spark_entry__ import entry
from flightops.plans.catalog import queries
from flightops.plans.oracle import oracle_sql
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.01"
ROWS_ONLY = {"ml04_train_cascade", "ml05_score", "ml12_top18_feature_importance",
             "ml18_model_metadata", "ml03_cross_validation", "srv03_score_batch", "srv04_score_stream"}
DEFAULT = """
    cln08_flight_date cln11_cleaning_report_ops cln11_cleaning_report_cascade prj01_03_airtime
    win01_prev_leg_split_runs win02_turnaround win02_turnaround_minutes win06_07_cascade_label
    win09_position_in_rotation agg01_route_stats agg08_propagation_by_carrier
    agg13_turnaround_by_origin agg16_bottleneck_category_counts agg25_train_medians
    scr04_06_robustness_routes scr09_quadrants jon05_lookup_history top02_worst_routes
    top09_least_robust_carriers ml02_time_series_folds ml08_roc_auc ml13_risk_tiers
    ml16_score_histogram ml17_leakage_checks srv01_features_from_raw srv04_feature_stream
    srv05_incoming_delay_stream jon02_03_route_and_propagation win10_time_index_split_minutes
""".split()
CHOSEN = sorted(oracle_sql()) if os.environ.get("FLIGHTOPS_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert difference(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


def test_every_query_has_sql_or_is_a_model():
    assert set(queries()) - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    first, second = entry(spark).collect(), entry(spark).collect()
    assert len(first) == 20 and first == second


def test_model_queries_fit_with_the_defaults(monkeypatch):
    from flightops.plans import catalog

    seen = []
    monkeypatch.setattr(catalog.L, "train_cascade", lambda train, **params: seen.append(params))
    monkeypatch.setattr(catalog, "save_model", lambda model, path: None)
    monkeypatch.setattr(catalog, "load_model", lambda path: None)
    monkeypatch.setattr(catalog, "session_folder", lambda spark: "")
    monkeypatch.setattr(catalog, "source_key", lambda *parts: parts)
    monkeypatch.setattr(catalog, "_MODELS", {})
    monkeypatch.setattr(catalog, "_filled", lambda *args: type(
        "Rows", (), {"filter": lambda self, where: self})())
    monkeypatch.setattr(catalog.F, "col", lambda name: name)
    catalog._model(None, "folder")
    assert seen == [{}]


@pytest.mark.parametrize("name", ["ml02_time_series_folds", "ml03_cv_summary", "win10_time_index",
                                  "win10_time_index_split_minutes"])
def test_time_index_orders_no_other_columns(spark, con, monkeypatch, name):
    from flightops.plans import catalog

    seen, index = [], catalog.P.with_time_index
    monkeypatch.setattr(catalog.P, "with_time_index",
                        lambda df, **given: seen.append(df.columns) or index(df, **given))
    assert difference(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None
    assert len(seen) == 1 and len(seen[0]) <= 6
