"""Scores, flags, segments and ranked reports on the aggregate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions import as_flag, clip, one_row, ratio, round_to
from flightops.schema import LIMITS

SEGMENTS = ("HIGH_EFF_HIGH_ROB", "HIGH_EFF_LOW_ROB", "LOW_EFF_HIGH_ROB", "LOW_EFF_LOW_ROB")


def efficiency_score(stats: DataFrame) -> DataFrame:
    """On-time 40, reliability 20, mean delay 20, delay spread 20; and the total in 0..100."""
    def calm(col: str) -> Column:
        return (1 - clip(F.col(col), 0, 60) / 60) * 20

    parts = stats.withColumns({
        "OnTimeComponent": F.col("OnTimeRate") * 40,
        "ReliabilityComponent": (1 - F.col("CancelRate")) * 20,
        "DelayComponent": calm("AvgArrDelay"),
        "SmoothComponent": calm("StdArrDelay"),
    })
    total = (
        F.col("OnTimeComponent") + F.col("ReliabilityComponent")
        + F.col("DelayComponent") + F.col("SmoothComponent")
    )
    return parts.withColumn("EfficiencyScore", round_to(clip(total, 0, 100), 1))


def bottleneck_flags(routes: DataFrame) -> DataFrame:
    """Flags over the limits, their number, and their names in one text."""
    flagged = routes.withColumns({
        "TaxiOutBottleneck": as_flag(F.col("AvgTaxiOut") > LIMITS.taxi_out_bottleneck),
        "TaxiInBottleneck": as_flag(F.col("AvgTaxiIn") > LIMITS.taxi_in_bottleneck),
        "AirTimeBottleneck": as_flag(
            F.col("AvgAirTimeDeviationPct") > LIMITS.air_time_bottleneck_pct
        ),
    })
    names = F.concat_ws(", ", *[
        F.when(F.col(f"{n}Bottleneck") == 1, F.lit(n)) for n in ("TaxiOut", "TaxiIn", "AirTime")
    ])
    return flagged.withColumns({
        "TotalBottlenecks": F.col("TaxiOutBottleneck") + F.col("TaxiInBottleneck")
        + F.col("AirTimeBottleneck"),
        "PrimaryBottleneck": F.when(names == "", F.lit("None")).otherwise(names),
    })


def robustness_score(stats: DataFrame) -> DataFrame:
    """Delay spread against its P95 over all rows, and relative to the mean delay.

    Without any spread at all the score is null, like a division by zero.
    """
    top = stats.agg(F.percentile("StdArrDelay", F.lit(0.95)).alias("_p95"))
    spread = F.col("StdArrDelay")
    return one_row(stats, top).withColumns({
        "RobustnessScore": round_to(100 * (1 - clip(ratio(spread, F.col("_p95")), 0, 1)), 1),
        "DelayCV": round_to(spread / (F.abs("AvgArrDelay") + 1), 2),
    }).drop("_p95")


def recovery_capability(routes: DataFrame) -> DataFrame:
    """On-time share against the mean delay, in 0..2."""
    return routes.withColumn(
        "RecoveryCapability",
        round_to(
            clip(F.col("OnTimeRate") / (1 - clip(F.col("AvgArrDelay"), 0, 60) / 60 + 0.1), 0, 2), 2
        ),
    )


def taxi_inefficiency(stats: DataFrame, way: str) -> DataFrame:
    """Weighted mean, P90 and spread of taxi time; ``way`` is ``Out`` or ``In``."""
    mean, high, spread = (F.col(f"{p}Taxi{way}") for p in ("Avg", "P90", "Std"))
    return stats.withColumn(
        f"Taxi{way}Inefficiency", round_to(mean * 0.6 + high * 0.3 + spread * 0.1, 1)
    )


def quadrants(routes: DataFrame) -> DataFrame:
    """Segment by median efficiency and median robustness; the median itself is HIGH."""
    medians = routes.agg(
        F.percentile("EfficiencyScore", F.lit(0.5)).alias("_eff"),
        F.percentile("RobustnessScore", F.lit(0.5)).alias("_rob"),
    )
    high_eff = F.col("EfficiencyScore") >= F.col("_eff")
    low_eff = F.col("EfficiencyScore") < F.col("_eff")
    high_rob = F.col("RobustnessScore") >= F.col("_rob")
    low_rob = F.col("RobustnessScore") < F.col("_rob")
    return one_row(routes, medians).withColumn(
        "Category",
        F.when(high_eff & high_rob, SEGMENTS[0])
        .when(high_eff & low_rob, SEGMENTS[1])
        .when(low_eff & high_rob, SEGMENTS[2])
        .otherwise(SEGMENTS[3]),
    ).drop("_eff", "_rob")


def quadrant_distribution(segmented: DataFrame) -> DataFrame:
    counts = segmented.groupBy("Category").agg(F.count(F.lit(1)).alias("Routes"))
    total = segmented.agg(F.count(F.lit(1)).alias("_total"))
    return one_row(counts, total).select(
        "Category", "Routes",
        round_to(ratio(F.col("Routes"), F.col("_total")) * 100, 1).alias("Pct"),
    )


def score_band(df: DataFrame) -> DataFrame:
    """Published reading of the two scores; a boundary value goes to the higher band."""
    eff, rob = F.col("EfficiencyScore"), F.col("RobustnessScore")
    return df.withColumns({
        "EfficiencyBand": F.when(eff > 85, "EXCELLENT").when(eff >= 70, "GOOD")
        .when(eff >= 55, "NEEDS_IMPROVEMENT").when(eff < 55, "CRITICAL"),
        "RobustnessBand": F.when(rob > 60, "PREDICTABLE").when(rob >= 40, "MODERATE")
        .when(rob < 40, "UNPREDICTABLE"),
    })


# -- ranked reports ------------------------------------------------------------

def top_k(
    df: DataFrame, by: str, n: int, key: str, ascending: bool = False, cols: tuple[str, ...] = ()
) -> DataFrame:
    """First ``n`` rows by ``by``; nulls last, ties in key order."""
    order = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    ranked = df.orderBy(order, F.asc(key)).limit(n)
    return ranked.select(key, *cols) if cols else ranked


def chart_frame(report: DataFrame, by: str, key: str, n: int, ranked_by: str | None = None,
                scale: float = 1.0) -> DataFrame:
    """Rows behind a bar chart: the first ``n`` of a report, drawn in ascending order."""
    top = top_k(report, ranked_by or by, n, key)
    return top.select(key, (F.col(by) * scale).alias(by)).orderBy(F.asc(by), key)
