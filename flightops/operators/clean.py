"""Cleaning rules and their report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions import as_flag, clip, one_row, ratio, round_to
from flightops.schema import LIMITS, REQUIRED_CASCADE, REQUIRED_OPS


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _present(names) -> Column:
    return _all(F.col(n).isNotNull() for n in names)


def valid_ops_ranges() -> Column:
    """Taxi times inside (0, 200), positive distance and elapsed time."""
    return _all([
        (F.col("TaxiOut") > 0) & (F.col("TaxiOut") < LIMITS.max_taxi),
        (F.col("TaxiIn") > 0) & (F.col("TaxiIn") < LIMITS.max_taxi),
        F.col("Distance") > 0,
        F.col("ActualElapsedTime") > 0,
    ])


def valid_cascade_ranges() -> Column:
    """Positive distance, arrival delay within [-60, 600]."""
    return (F.col("Distance") > 0) & F.col("ArrDelay").between(
        LIMITS.min_arr_delay, LIMITS.max_arr_delay
    )


def split_cancelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flown, cancelled); a row without the flag is in neither."""
    return df.filter("Cancelled = 0"), df.filter("Cancelled = 1")


def drop_diverted(df: DataFrame) -> DataFrame:
    return df.filter("Diverted = 0") if "Diverted" in df.columns else df


def require_tail(df: DataFrame) -> DataFrame:
    return df.filter(F.col("TailNum").isNotNull())


def with_flight_date(df: DataFrame, strict: bool = False, replace: bool = False) -> DataFrame:
    """``FlightDate`` from year, month and day, only if absent (or ``replace``).

    A bad date becomes null; ``strict`` raises instead. Both spellings of the day
    column are accepted.
    """
    if "FlightDate" in df.columns and not replace:
        return df
    day = "DayofMonth" if "DayofMonth" in df.columns else "DayOfMonth"
    parts = [F.col("Year"), F.col("Month"), F.col(day)]
    if strict:
        date = F.make_date(*parts)
    else:
        zero = F.lit(0)
        date = F.to_date(F.try_make_timestamp(*parts, zero, zero, zero))
    return df.withColumn("FlightDate", date)


def with_day_number(df: DataFrame, name: str = "FlightDate_Numeric") -> DataFrame:
    """Days since 2000-01-01."""
    return df.withColumn(name, F.datediff("FlightDate", F.lit("2000-01-01").cast("date")))


def coerce_numeric(df: DataFrame, cols=REQUIRED_OPS) -> DataFrame:
    """Numbers out of text columns; what is not a number becomes null."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})


def clean_ops(df: DataFrame) -> DataFrame:
    """Cleaning for the descriptive tables."""
    flown, _ = split_cancelled(with_flight_date(df))
    kept = flown.filter(_present(REQUIRED_OPS)).filter(valid_ops_ranges())
    return with_day_number(kept).withColumn("Cancelled", F.lit("NO"))


def clean_cascade(df: DataFrame) -> DataFrame:
    """Cleaning for the cascade label and the model."""
    flown, _ = split_cancelled(df)
    dated = with_flight_date(require_tail(drop_diverted(flown)))
    return dated.filter(_present(REQUIRED_CASCADE)).filter(valid_cascade_ranges())


def cleaning_report(
    raw: DataFrame, rules: str = "ops", rejects: DataFrame | None = None
) -> DataFrame:
    """One row of counts for the ``ops`` or the ``cascade`` rules, in one pass.

    Rules apply in order; a row counts for the first rule it breaks. ``rejects`` are the lines
    of the source that gave no row; their number is added as ``rejected_lines``.
    """
    df = with_flight_date(raw)
    flown = F.col("Cancelled") == 0
    if rules == "ops":
        steps = [
            ("not_flown_rows", flown),
            ("missing_field_rows", _present(REQUIRED_OPS)),
            ("invalid_value_rows", valid_ops_ranges()),
        ]
    elif rules == "cascade":
        direct = F.col("Diverted") == 0 if "Diverted" in df.columns else F.lit(True)
        steps = [
            ("not_flown_rows", flown),
            ("diverted_rows", direct),
            ("no_tail_rows", F.col("TailNum").isNotNull()),
            ("missing_field_rows", _present(REQUIRED_CASCADE)),
            ("invalid_value_rows", valid_cascade_ranges()),
        ]
    else:
        raise ValueError(f"unknown rules {rules!r}")
    passes = [F.coalesce(condition, F.lit(False)) for _, condition in steps]
    lost = []
    for i, (name, _) in enumerate(steps):
        before = _all([F.lit(True), *passes[:i]])
        lost.append(F.count_if(before & ~passes[i]).alias(name))
    kept = _all(passes)
    counts = df.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(F.col("Cancelled") == 1).alias("cancelled_rows"),
        *lost,
        F.count_if(kept).alias("cleaned_rows"),
        F.count_distinct(F.when(kept, F.col("TailNum"))).alias("aircraft"),
        F.min(F.when(kept, F.col("FlightDate"))).alias("first_date"),
        F.max(F.when(kept, F.col("FlightDate"))).alias("last_date"),
    )
    if rejects is not None:
        counts = one_row(counts, rejects.agg(F.count("line").alias("rejected_lines")))
    return counts.withColumns({
        "removed_rows": F.col("initial_rows") - F.col("cleaned_rows"),
        "retention_pct": round_to(ratio(F.col("cleaned_rows"), F.col("initial_rows")) * 100, 2),
    })


def with_route(df: DataFrame) -> DataFrame:
    """``Origin-Dest``; null if either end is unknown."""
    return df.withColumn("Route", F.concat("Origin", F.lit("-"), "Dest"))


def with_airtime(df: DataFrame, mph: int = LIMITS.cruise_mph) -> DataFrame:
    """Expected air time at cruise speed, deviation, and deviation % in [-50, 200]."""
    expected = F.col("Distance") / F.lit(float(mph)) * 60
    return (
        df.withColumn("ExpectedAirTime", expected)
        .withColumn("AirTimeDeviation", F.col("ActualElapsedTime") - F.col("ExpectedAirTime"))
        .withColumn(
            "AirTimeDeviationPct",
            clip(ratio(F.col("AirTimeDeviation"), F.col("ExpectedAirTime")) * 100, -50, 200),
        )
    )


def with_turnaround_penalty(df: DataFrame) -> DataFrame:
    """75 below one hour, 25 below one and a half, else 0; only for 0 < hours < 24."""
    hours = F.col("TurnaroundTime")
    valid = (hours > 0) & (hours < LIMITS.day_hours)
    penalty = as_flag(hours < 1.0) * 50 + as_flag(hours < 1.5) * 25
    return df.withColumn("TurnaroundInefficiency", F.when(valid, penalty).otherwise(F.lit(0)))
