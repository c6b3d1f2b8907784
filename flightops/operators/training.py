"""Gradient-boosted trees for the cascade label."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.functions import ratio
from flightops.operators.evaluate import LABEL, PRED, SCORE, fold_metrics
from flightops.schema import FEATURES
from flightops.session import shared_folder

# 200 trees of depth 8 at rate 0.05 on 80 % of rows and columns; node ids are not cached: at this
# depth a walk from the root costs less than storing an id per row at every level
DEFAULT_PARAMS = {
    "maxIter": 200, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8", "seed": 42, "cacheNodeIds": False, "checkpointInterval": 10,
}


def class_weight(train: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: negatives, positives and their ratio (null without positives)."""
    return train.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    ).withColumn("weight", ratio(F.col("negatives"), F.col("positives")))


def with_class_weight(
    train: DataFrame, label: str = LABEL, weight: float | None = None
) -> DataFrame:
    """Weigh positives by ``weight``; without it by the ratio in ``train``."""
    if weight is None:
        weight = class_weight(train, label).first()["weight"]
    value = F.lit(1.0 if weight is None else float(weight))
    return train.withColumn("ClassWeight", F.when(F.col(label) == 1, value).otherwise(1.0))


def train_cascade(
    train: DataFrame, features: tuple[str, ...] = FEATURES, label: str = LABEL,
    weight: float | None = None, **params
) -> PipelineModel:
    """Fit on filled features; rare positives weigh negatives / positives, or ``weight``.

    Give a frame read from files: every tree makes several passes over it.
    """
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # residuals are checkpointed
        context.setCheckpointDir(shared_folder(train.sparkSession))
    present = [f for f in features if f in train.columns]
    assembler = VectorAssembler(inputCols=present, outputCol="_features")
    trees = GBTClassifier(
        featuresCol="_features", labelCol=label, weightCol="ClassWeight",
        **(DEFAULT_PARAMS | params),
    )
    return Pipeline(stages=[assembler, trees]).fit(
        with_class_weight(train.select(label, *present), label, weight)
    )


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the probability of a cascade and the predicted class at 0.5."""
    made = ("_features", "rawPrediction", "probability", "prediction")
    return model.transform(df).withColumns({
        SCORE: vector_to_array("probability")[1],
        PRED: F.col("prediction").cast("int"),
    }).drop(*made)


def cross_validate(
    folds: DataFrame, k: int = 5, label: str = LABEL, **params
) -> DataFrame:
    """Metrics per fold: fit on the rows before it, test on its own rows.

    All fits take the class weight of the whole training part. They are submitted
    together, so that their small jobs share the cluster.
    """
    weight = class_weight(folds, label).first()["weight"]

    def fit(fold: int) -> PipelineModel:
        return train_cascade(
            folds.filter(F.col("ValFold") < fold), label=label, weight=weight, **params)

    with ThreadPoolExecutor(k) as pool:
        models = list(pool.map(fit, range(1, k + 1)))
    results = None
    for fold, model in enumerate(models, 1):
        part = fold_metrics(score(folds.filter(F.col("ValFold") == fold), model), label)
        results = part if results is None else results.unionByName(part)
    return results


def feature_importance(model: PipelineModel) -> DataFrame:
    """One row per model input, highest first."""
    assembler, trees = model.stages
    values = [float(v) for v in trees.featureImportances.toArray()]
    return SparkSession.active().createDataFrame(
        list(zip(assembler.getInputCols(), values)), "Feature string, Importance double"
    ).orderBy(F.desc("Importance"), "Feature")
