"""Evaluation of 0/1 predictions and of scores in [0, 1].

Curves and AUC work on one row per distinct score, so their size follows the
number of distinct scores and not the number of flights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions import one_row, ratio
from flightops.functions.ordered import running_totals
from flightops.session import staged

LABEL, PRED, SCORE = "CausedCascade", "PredictedCascade", "CascadeProbability"


def confusion_matrix(
    df: DataFrame, label: str = LABEL, pred: str = PRED, by: tuple[str, ...] = ()
) -> DataFrame:
    """Counts ``tn fp fn tp`` over all rows, or for each group in ``by``."""
    def cell(actual: int, guessed: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(pred) == guessed))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    )


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "f1": _or_zero(2 * tp, 2 * tp + fp + fn),
        "recall": _or_zero(tp, tp + fn),
        "precision": _or_zero(tp, tp + fp),
        "accuracy": _or_zero(tp + tn, tp + tn + fp + fn),
    }).drop("tn", "fp", "fn", "tp")


def binary_metrics(
    df: DataFrame, label: str = LABEL, pred: str = PRED, by: tuple[str, ...] = ()
) -> DataFrame:
    """F1, recall, precision and accuracy; 0 where undefined."""
    return metrics_from_counts(confusion_matrix(df, label, pred, by))


def fold_metrics(folds: DataFrame, label: str = LABEL, pred: str = PRED) -> DataFrame:
    """Metrics of each validation part of ``time_series_folds``."""
    return binary_metrics(folds.filter(F.col("ValFold") > 0), label, pred, ("ValFold",))


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """Mean and sample deviation of F1, recall and precision over the folds."""
    names = ("f1", "recall", "precision")
    return fold_scores.agg(
        *[F.avg(n).alias(f"mean_{n}") for n in names],
        *[F.stddev_samp(n).alias(f"std_{n}") for n in names],
    )


def classification_report(
    df: DataFrame, label: str = LABEL, pred: str = PRED,
    names: tuple[str, str] = ("No Cascade", "Cascade"),
) -> DataFrame:
    """Precision, recall, F1 and support by class, accuracy, macro and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    scored = confusion_matrix(df, label, pred).select(
        "*",
        _or_zero(tn, tn + fn).alias("p0"), _or_zero(tn, tn + fp).alias("r0"),
        _or_zero(2 * tn, 2 * tn + fp + fn).alias("f0"), (tn + fp).alias("s0"),
        _or_zero(tp, tp + fp).alias("p1"), _or_zero(tp, tp + fn).alias("r1"),
        _or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("s1"),
        (tn + fp + fn + tp).alias("n"),
    )

    def mean(m: str, weighted: bool) -> Column:
        if weighted:
            return ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), F.col("n"))
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def row(name: str, precision, recall, f1, support) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )

    nothing = F.lit(None).cast("double")
    rows = [
        row(names[i], *(F.col(f"{m}{i}") for m in "prfs")) for i in (0, 1)
    ]
    rows.append(row("accuracy", nothing, nothing, _or_zero(tp + tn, F.col("n")), F.col("n")))
    for name, weighted in (("macro avg", False), ("weighted avg", True)):
        rows.append(row(name, *(mean(m, weighted) for m in "prf"), F.col("n")))
    return scored.select(F.inline(F.array(*rows)))


# -- scores --------------------------------------------------------------------

def _by_score(df: DataFrame, score: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(positives and negatives per distinct score with running totals, their sums)."""
    # several steps read the counts: stored, so that the flights are scanned once
    counts = staged(
        df.sparkSession, "scores",
        lambda: df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
        ),
    )
    totals = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return running_totals(counts, "threshold", ["pos", "neg"]), totals


def roc_auc(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Exact area under the ROC curve; ties count one half, null with one class only."""
    ranked, totals = _by_score(df, score, label)
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    return one_row(ranked.agg(won.alias("_won")), totals).select(
        ratio(F.col("_won"), F.col("all_pos").cast("double") * F.col("all_neg")).alias("auc")
    )


def _at_or_above(name: str) -> Column:
    return F.col(f"all_{name}") - F.col(f"{name}_before")


def roc_curve(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """One point per distinct score, and the start (0, 0) without a threshold."""
    ranked, totals = _by_score(df, score, label)
    points = one_row(ranked, totals).select(
        "threshold",
        ratio(_at_or_above("neg"), F.col("all_neg")).alias("fpr"),
        ratio(_at_or_above("pos"), F.col("all_pos")).alias("tpr"),
    )
    start = totals.select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(start)


def pr_curve(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Precision and recall at each distinct score, the end (recall 0), the base rate."""
    ranked, totals = _by_score(df, score, label)
    base = ratio(F.col("all_pos"), F.col("all_pos") + F.col("all_neg")).alias("base_rate")
    points = one_row(ranked, totals).select(
        "threshold",
        ratio(_at_or_above("pos"), _at_or_above("pos") + _at_or_above("neg")).alias("precision"),
        ratio(_at_or_above("pos"), F.col("all_pos")).alias("recall"),
        base,
    )
    end = totals.select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"), base,
    )
    return points.unionByName(end)


def score_histogram(
    df: DataFrame, score: str = SCORE, label: str = LABEL, bins: int = 50
) -> DataFrame:
    """Density of the score by outcome, over each outcome's own range; empty bins are 0."""
    counts = staged(
        df.sparkSession, "outcome-scores",
        lambda: df.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(
            F.col(label).alias("label"), F.col(score).alias("_x")
        ).agg(F.count(F.lit(1)).alias("_n")),
    )
    one_value = F.min("_x") == F.max("_x")  # a single value gets a range of width 1
    ranges = counts.groupBy("label").agg(
        F.when(one_value, F.min("_x") - 0.5).otherwise(F.min("_x")).alias("_low"),
        F.when(one_value, F.max("_x") + 0.5).otherwise(F.max("_x")).alias("_high"),
        F.sum("_n").alias("_total"),
    ).withColumn("_width", (F.col("_high") - F.col("_low")) / bins)
    # two outcomes: `ranges` has at most two rows and `grid` two times `bins`
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    place = F.floor((F.col("_x") - F.col("_low")) / F.col("_width")).cast("int")
    filled = (
        counts.join(F.broadcast(ranges), "label")
        .groupBy("label", F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.sum("_n").alias("_n"))
    )
    return grid.join(filled, ["label", "bin"], "left").select(
        "label", "bin",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"),
        F.coalesce("_n", F.lit(0)).alias("legs"),
        (F.coalesce("_n", F.lit(0)) / (F.col("_total") * F.col("_width"))).alias("density"),
    )
