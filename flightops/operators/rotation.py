"""Aircraft rotations: previous and next leg, turnaround, position in the day.

Legs of one aircraft are ordered by date, scheduled departure and ``FlightId``.
A window over the tail number would put all legs of an aircraft into one task,
and placeholder tail numbers can own a large share of a table. A sketch of the
most frequent tail numbers, a scan of that one column, names the tails that may
hold too many legs. Without any the plan is a plain window. Otherwise these tails
are walked in runs of one scheduled minute, and a small table of run edges carries
the neighbour across runs. Either way the result is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightops.functions import as_flag, hhmm_to_minutes
from flightops.schema import LIMITS

# A tail with more legs is walked in runs; this changes the plan only.
HOT_ROWS = 200_000
TRACKED = 1 << 14  # tail numbers in the sketch
LISTED = 1 << 10  # tail numbers that a plan names at most

_WALK = ("_day", "_clock", "FlightId")
_KEYS = ("_tail", "_run", "_day", "_clock")


def heavy_tails(df: DataFrame, hot_rows: int = HOT_ROWS) -> list[str] | None:
    """Tail numbers that may hold more than ``hot_rows`` legs; None if they are too many to name.

    Runs a job over ``TailNum``. The sketch counts too high, never too low, and a tail that it
    does not track has at most 3.5 / ``TRACKED`` of the rows, so none that is too large is missed.
    """
    if hot_rows <= 0:
        return None
    seen = df.agg(
        F.count(F.lit(1)).alias("legs"),
        F.expr(f"approx_top_k(TailNum, {LISTED}, {TRACKED})").alias("top"),
    ).first()
    heavy = [t["item"] for t in seen["top"] if t["item"] is not None and t["count"] > hot_rows]
    if seen["legs"] * 3.5 / TRACKED > hot_rows or len(heavy) >= LISTED - 1:
        return None
    return heavy


def _with_keys(df: DataFrame, heavy: list[str] | None) -> DataFrame:
    day = F.coalesce(F.datediff("FlightDate", F.lit("2000-01-01").cast("date")), F.lit(9_999_999))
    clock = F.coalesce(F.col("CRSDepTime"), F.lit(9999))
    split = F.lit(True) if heavy is None else F.col("TailNum").isin(heavy)
    return df.withColumns({
        # legs without a tail number have no neighbours: each is its own aircraft
        "_tail": F.coalesce("TailNum", F.concat(F.lit("#"), F.col("FlightId").cast("string"))),
        "_day": day,
        "_clock": clock,
    }).withColumn("_run", F.when(split, F.col("_day").cast("long") * 10_000 + F.col("_clock")))


def walk_rotation(
    df: DataFrame,
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    position: str | None = None,
    within: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add struct ``_prev`` / ``_next`` of neighbour columns and the leg's place in its day.

    ``within`` names extra partition columns, such as the split. One exchange and one sort serve
    all three; only heavy tails add an aggregate of their run edges. Looking for heavy tails runs
    a job.
    """
    heavy = heavy_tails(df, hot_rows)
    split = heavy is None or bool(heavy)
    if split:
        keyed = _with_keys(df, heavy)
        group = [*within, "_tail", "_run"]
    else:
        # legs are spread before keys and neighbour structs are made: these repeat their columns
        lone = F.when(F.col("TailNum").isNull(), F.col("FlightId"))
        spread = df.withColumn("_lone", lone).repartition("TailNum", "_lone")
        keyed = _with_keys(spread, heavy)
        group = [*within, "TailNum", "_lone"]
    walk = F.struct(*_WALK)
    window = Window.partitionBy(*group).orderBy(*_WALK)
    day_window = Window.partitionBy(*group, "_day").orderBy("_clock", "FlightId")

    near, edge, far = {}, [], {}
    across = Window.partitionBy(*within, "_tail").orderBy("_run")
    if previous:
        near["_prev"] = F.lag(F.struct(*previous)).over(window)
        edge.append(F.max_by(F.struct(*previous), walk).alias("_last"))
        far["_prev"] = F.lag("_last").over(across)
    if following:
        near["_next"] = F.lead(F.struct(*following)).over(window)
        edge.append(F.min_by(F.struct(*following), walk).alias("_first"))
        far["_next"] = F.lead("_first").over(across)
    if position:
        near[position] = F.row_number().over(day_window)
        edge.append(F.count(F.lit(1)).alias("_count"))
        earlier = (
            Window.partitionBy(*within, "_tail", "_day").orderBy("_run")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        far[position] = F.sum("_count").over(earlier)

    walked = keyed.withColumns(near)
    if not split:
        return walked.drop("_lone", *_KEYS)
    edges = (
        keyed.filter(F.col("_run").isNotNull())
        .groupBy(*group, "_day").agg(*edge)
        .select(*group, *[c.alias(f"_far{n}") for n, c in far.items()])
    )
    walked = walked.join(edges, group, "left")
    for name in near:
        if name == position:
            merged = (F.col(name) + F.coalesce(F.col(f"_far{name}"), F.lit(0))).cast("int")
        else:
            merged = F.coalesce(F.col(name), F.col(f"_far{name}"))
        walked = walked.withColumn(name, merged)
    return walked.drop(*_KEYS, *[f"_far{n}" for n in near])


# -- descriptive rotation ------------------------------------------------------

def with_prev_leg(df: DataFrame, **hot) -> DataFrame:
    """Arrival time, day number and arrival delay of the aircraft's previous leg."""
    walked = walk_rotation(df, previous=["ArrTime", "FlightDate_Numeric", "ArrDelay"], **hot)
    return walked.withColumns({
        "PrevArrTime": F.col("_prev.ArrTime"),
        "PrevFlightDate": F.col("_prev.FlightDate_Numeric"),
        "PrevFlightDelay": F.col("_prev.ArrDelay"),
    }).drop("_prev")


def with_turnaround(df: DataFrame, clock: str = "hhmm") -> DataFrame:
    """Hours between the previous arrival and this scheduled departure.

    ``clock='hhmm'`` subtracts the clock integers as they are (the default, equal to
    the published figures, where a next-day value may be negative);
    ``clock='minutes'`` converts them first. No usable gap gives 999.
    """
    if clock == "hhmm":
        departs, arrived = F.col("CRSDepTime"), F.col("PrevArrTime")
    elif clock == "minutes":
        departs, arrived = hhmm_to_minutes(F.col("CRSDepTime")), hhmm_to_minutes(F.col("PrevArrTime"))
    else:
        raise ValueError(f"unknown clock {clock!r}")
    same_day = (departs - arrived) / 60.0
    next_day = (F.lit(24 * 60) - arrived + departs) / 60.0
    days = F.col("FlightDate_Numeric") - F.col("PrevFlightDate")
    hours = F.when((days == 0) & (same_day >= 0), same_day).when(
        (days == 1) & (next_day < LIMITS.max_turnaround_hours), next_day
    )
    return df.withColumn("TurnaroundTime", F.coalesce(hours, F.lit(LIMITS.no_turnaround)))


def with_propagation(df: DataFrame, late: int = LIMITS.late) -> DataFrame:
    """1 where the previous leg arrived late and this one departed late."""
    passed_on = (F.col("PrevFlightDelay") > late) & (F.col("DepDelay") > late)
    return df.withColumn("DelayPropagated", as_flag(passed_on))


# -- cascade label -------------------------------------------------------------

def with_next_leg(df: DataFrame, **hot) -> DataFrame:
    """Delays, date and scheduled departure of the aircraft's next leg."""
    walked = walk_rotation(
        df, following=["DepDelay", "ArrDelay", "FlightDate", "CRSDepTime"], **hot
    )
    return walked.withColumns({
        "NextFlight_DepDelay": F.col("_next.DepDelay"),
        "NextFlight_ArrDelay": F.col("_next.ArrDelay"),
        "NextFlight_Date": F.col("_next.FlightDate"),
        "NextFlight_CRSDepTime": F.col("_next.CRSDepTime"),
    }).drop("_next")


def with_sched_turnaround(df: DataFrame, clock: str = "hhmm") -> DataFrame:
    """Scheduled hours to the next departure, wrapped over midnight."""
    if clock == "hhmm":
        gap = F.col("NextFlight_CRSDepTime") - F.col("CRSArrTime")
        wrap, hour = 2400, 100.0
    elif clock == "minutes":
        gap = hhmm_to_minutes(F.col("NextFlight_CRSDepTime")) - hhmm_to_minutes(F.col("CRSArrTime"))
        wrap, hour = 1440, 60.0
    else:
        raise ValueError(f"unknown clock {clock!r}")
    return df.withColumn("TurnaroundTime", F.when(gap < 0, gap + wrap).otherwise(gap) / hour)


def with_cascade_label(df: DataFrame, late: int = LIMITS.late) -> DataFrame:
    """``CausedCascade`` for legs with a next leg; the last leg of each tail is dropped."""
    hours = F.col("TurnaroundTime")
    caused = (
        (F.col("ArrDelay") > late)
        & (F.col("NextFlight_DepDelay") > late)
        & (F.col("NextFlight_Date") == F.col("FlightDate"))
        & (hours > 0)
        & (hours < LIMITS.day_hours)
    )
    return df.filter(F.col("NextFlight_DepDelay").isNotNull()).withColumn(
        "CausedCascade", as_flag(caused)
    )


def cascade_label(clean: DataFrame, clock: str = "hhmm", **hot) -> DataFrame:
    """Clean flights to labelled legs."""
    return with_cascade_label(with_sched_turnaround(with_next_leg(clean, **hot), clock))
