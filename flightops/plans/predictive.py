"""The training run: clean flights to features, model, evaluation and artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightops.functions import one_row
from flightops.operators import evaluate as E
from flightops.operators import features as X
from flightops.operators import rotation as R
from flightops.operators import split as P
from flightops.operators import tiers as T
from flightops.operators import training as M
from flightops.operators.clean import clean_cascade
from flightops.schema import FEATURES
from flightops.session import staged
from flightops.sources import sinks

# what labels, history and features read of a leg; the others would go through every walk
LEG_COLUMNS = (
    "FlightId", "FlightDate", "CRSDepTime", "TailNum", "UniqueCarrier", "Origin", "Dest",
    "ArrDelay", "DepDelay", "TaxiOut", "TaxiIn", "Distance", "CRSElapsedTime", "TurnaroundTime",
    "CausedCascade",
)
ID_COLUMNS = ("FlightId", "FlightDate", "CRSDepTime", "split", "CausedCascade")


@dataclass
class Prepared:
    """Frames of a training run, all read from stored tables."""

    labelled: DataFrame
    history: dict[str, DataFrame]
    unfilled: DataFrame
    medians: DataFrame

    @property
    def features(self) -> DataFrame:
        return X.fill_features(self.unfilled, self.medians)


def labelled_legs(
    flights: DataFrame, q: float = 0.75, clock: str = "hhmm",
    sources: tuple[str, ...] = (), **hot
) -> DataFrame:
    """Labelled legs with their split.

    The label needs a walk of every aircraft and feeds the split date, the history and
    the features, so it is stored first.
    """
    def build() -> DataFrame:
        legs = R.cascade_label(clean_cascade(flights), clock, **hot)
        return legs.select([c for c in LEG_COLUMNS if c in legs.columns])

    legs = staged(flights.sparkSession, f"legs-{clock}", build, sources)
    return P.temporal_split(legs, q)


def prepare(
    flights: DataFrame, q: float = 0.75, clock: str = "hhmm",
    sources: tuple[str, ...] = (), **hot
) -> Prepared:
    """Label, split, history from the training part, and the 28 features."""
    spark = flights.sparkSession
    legs = labelled_legs(flights, q, clock, sources, **hot)
    train = legs.filter(F.col("split") == "train")
    cells = staged(spark, f"cells-{clock}-{q}", lambda: X.history_cells(train), sources)
    history = {
        name: staged(spark, f"history-{name}-{clock}-{q}", lambda t=table: t, sources)
        for name, table in X.history_tables(cells).items()
    }

    def build() -> DataFrame:
        joined = X.apply_history(X.engineer(legs, **hot), history)
        return X.select_features(joined, keep=ID_COLUMNS)

    unfilled = staged(spark, f"features-{clock}-{q}", build, sources)
    medians = X.train_medians(unfilled.filter(F.col("split") == "train"))
    return Prepared(legs, history, unfilled, medians)


def model_metadata(
    prepared: Prepared, metrics: DataFrame, cv: DataFrame, thresholds: DataFrame,
    version: str = "2.0",
) -> DataFrame:
    """One nested row: version, periods, metrics, CV means, checks and tier limits.

    ``metrics`` has f1, recall, precision, accuracy and auc; ``cv`` comes from
    ``cv_summary`` and ``thresholds`` from ``tier_thresholds``; one row each.
    """
    def period(name: str):
        inside = F.when(F.col("split") == name, F.col("FlightDate"))
        return F.struct(
            F.min(inside).cast("string").alias("start"), F.max(inside).cast("string").alias("end")
        )

    periods = prepared.labelled.agg(
        period("train").alias("training_period"), period("test").alias("test_period"),
        F.when(
            F.max(F.when(F.col("split") == "train", F.col("FlightDate")))
            < F.min(F.when(F.col("split") == "test", F.col("FlightDate"))), "PASS",
        ).otherwise("FAIL").alias("_order"),
    )
    statistics = T.source_checks(prepared.unfilled, prepared.history).agg(
        F.when(F.bool_and(F.col("status") == "PASS"), "training_only").otherwise("FAIL")
        .alias("_statistics"))
    row = one_row(one_row(one_row(one_row(periods, metrics), cv), thresholds), statistics)
    return row.select(
        F.lit(version).alias("model_version"),
        F.lit("CascadePrediction_GBT").alias("model_type"),
        F.current_date().cast("string").alias("training_date"),
        "training_period", "test_period",
        F.struct(
            F.col("f1").alias("f1_score"), "recall", "precision", "accuracy",
            F.col("auc").alias("auc_roc"),
        ).alias("performance"),
        F.struct("mean_f1", "mean_recall", "mean_precision").alias("cross_validation"),
        F.struct(
            F.col("_order").alias("temporal_split"),
            F.col("_statistics").alias("statistics_source"),
            F.when(F.col("_statistics") == "FAIL", "FAIL").otherwise(F.col("_order"))
            .alias("validation_status"),
        ).alias("data_leakage_checks"),
        F.struct(
            F.col("critical").alias("critical_threshold"), F.col("high").alias("high_threshold"),
            F.col("elevated").alias("elevated_threshold"),
        ).alias("risk_tiers"),
        F.array(*[F.lit(f) for f in FEATURES]).alias("features"),
    )


@dataclass
class TrainingRun:
    prepared: Prepared
    model: PipelineModel
    scored: DataFrame
    metrics: DataFrame
    cv: DataFrame
    thresholds: DataFrame
    checks: DataFrame
    metadata: DataFrame


def run_training(flights: DataFrame, path: str, k: int = 5, **params) -> TrainingRun:
    """Prepare, cross-validate, fit, evaluate and store everything under ``path``."""
    spark = flights.sparkSession
    prepared = prepare(flights)
    features = staged(spark, "filled", lambda: prepared.features)
    train = features.filter(F.col("split") == "train")
    folds = staged(
        spark, "folds", lambda: P.time_series_folds(P.with_time_index(train), k)
    )
    # each of these is one row that several later steps read: stored, not recomputed
    cv = staged(spark, "cv", lambda: E.cv_summary(M.cross_validate(folds, k, **params)))
    model = M.train_cascade(train, **params)
    scored = staged(
        spark, "scored", lambda: M.score(features.filter(F.col("split") == "test"), model)
    )
    metrics = staged(
        spark, "metrics", lambda: one_row(E.binary_metrics(scored), E.roc_auc(scored))
    )
    thresholds = staged(spark, "thresholds", lambda: T.tier_thresholds(scored))
    checks = T.leakage_checks(features, prepared.history, metrics)
    metadata = staged(
        spark, "metadata", lambda: model_metadata(prepared, metrics, cv, thresholds)
    )
    sinks.save_model(model, path)
    sinks.write_history(prepared.history, path)
    sinks.write_importance(M.feature_importance(model), path)
    sinks.write_metadata(metadata, path)
    # the same as a version of its own, which readers get whole or not at all
    sinks.write_set(
        {**{f"history_{n}": t for n, t in prepared.history.items()}, "metadata": metadata,
         "features": sinks.feature_list(spark), "importance": M.feature_importance(model)},
        path, {"metadata": "json", "importance": "csv"}, model)
    return TrainingRun(prepared, model, scored, metrics, cv, thresholds, checks, metadata)
