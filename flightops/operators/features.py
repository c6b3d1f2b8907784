"""The 28 model features and the history tables behind seven of them."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.functions import as_flag, clip, one_row, ratio
from flightops.operators.rotation import walk_rotation
from flightops.schema import FEATURES, LIMITS

# fixed hour sets of the time features
RUSH_HOURS = (6, 7, 8, 16, 17, 18)
EARLY_HOURS = (5, 6, 7, 8)
LATE_HOURS = (21, 22, 23, 0, 1, 2)


def hour_flags(hour: Column) -> dict[str, Column]:
    return {
        "IsRushHour": as_flag(hour.isin(*RUSH_HOURS)),
        "IsEarlyMorning": as_flag(hour.isin(*EARLY_HOURS)),
        "IsLateNight": as_flag(hour.isin(*LATE_HOURS)),
    }


def temporal_features(df: DataFrame) -> DataFrame:
    """Hour, weekday (Monday = 0), month and four time-of-day or week flags."""
    hour = F.floor(F.col("CRSDepTime") / 100).cast("int")
    return df.withColumns({
        "Hour": hour,
        "DayOfWeek": F.weekday("FlightDate"),
        "Month": F.month("FlightDate"),
        "IsWeekend": as_flag(F.weekday("FlightDate").isin(5, 6)),
        **hour_flags(hour),
    })


def flight_features(df: DataFrame) -> DataFrame:
    miles = F.col("Distance")
    return df.withColumns({
        "Distance": miles.cast("double"),
        "CRSElapsedTime": F.col("CRSElapsedTime").cast("double"),
        "IsShortHaul": as_flag(miles < LIMITS.short_haul),
        "IsMediumHaul": as_flag((miles >= LIMITS.short_haul) & (miles < LIMITS.long_haul)),
        "IsLongHaul": as_flag(miles >= LIMITS.long_haul),
    })


def rotation_features(df: DataFrame, within: tuple[str, ...] = ("split",), **hot) -> DataFrame:
    """Incoming delays (0 if there is no earlier leg) and the place in the day.

    ``within`` keeps the windows inside each split, so the first test leg of an
    aircraft has no incoming delay.
    """
    walked = walk_rotation(
        df, previous=["ArrDelay", "DepDelay"], position="PositionInRotation", within=within, **hot
    )
    return walked.withColumns({
        "IncomingDelay": F.coalesce("_prev.ArrDelay", F.lit(0)).cast("double"),
        "IncomingDepDelay": F.coalesce("_prev.DepDelay", F.lit(0)).cast("double"),
    }).drop("_prev")


def incoming_features(df: DataFrame) -> DataFrame:
    return df.withColumn("HasIncomingDelay", as_flag(F.col("IncomingDelay") > LIMITS.late))


def turnaround_features(df: DataFrame, minutes: Column | None = None) -> DataFrame:
    """Buffer in minutes (from the hours unless given) and three flags for a short one."""
    hours = F.col("TurnaroundTime")
    minutes = hours * 60 if minutes is None else minutes
    return df.withColumns({
        "TurnaroundMinutes": minutes,
        "TightTurnaround": as_flag(hours < 1.0),
        "CriticalTurnaround": as_flag(hours < 0.75),
        "InsufficientBuffer": as_flag((minutes - F.col("IncomingDelay")) < 30),
    })


def utilization_features(df: DataFrame) -> DataFrame:
    place = F.col("PositionInRotation")
    return df.withColumns({
        "IsFirstFlight": as_flag(place == 1),
        "IsEarlyRotation": as_flag(place <= 3),
        "IsLateRotation": as_flag(place >= 5),
    })


def engineer(split: DataFrame, **hot) -> DataFrame:
    """All features that need no history, for labelled legs with a ``split`` column."""
    walked = rotation_features(split, **hot)
    return utilization_features(
        turnaround_features(incoming_features(flight_features(temporal_features(walked))))
    )


# -- history -------------------------------------------------------------------

def history_cells(train: DataFrame) -> DataFrame:
    """Counts and sums by route, carrier and whole minute of arrival delay.

    One scan of the training legs serves all history tables: each is rolled up from the cells,
    whose number is bounded by routes, carriers and minutes, not by legs. ``_ids`` adds up a
    64-bit hash of each ``FlightId``, in any order, to tell later which legs are behind a table.
    """
    sums = {"_dep": "DepDelay", "_out": "TaxiOut", "_in": "TaxiIn"}
    ids = F.xxhash64("FlightId") if "FlightId" in train.columns else F.lit(None)
    return train.groupBy("Origin", "Dest", "UniqueCarrier", "ArrDelay").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.count(c).alias(f"{n}_n") for n, c in sums.items()],
        F.sum(ids.cast("decimal(20,0)")).alias("_ids"),
    )


def _mean_of(name: str) -> Column:
    return ratio(F.sum(name), F.sum(f"{name}_n"))


def _arr_moments() -> tuple[Column, Column, Column]:
    """Exact count, sum and sum of squares of the arrival delays of cells."""
    delay = F.col("ArrDelay").cast("decimal(12,0)")
    weight = F.when(F.col("ArrDelay").isNotNull(), F.col("_n")).cast("decimal(14,0)")
    return F.sum(weight), F.sum(delay * weight), F.sum(delay * delay * weight)


def _arr_mean() -> Column:
    n, total, _ = _arr_moments()
    return ratio(total, n)


def _arr_deviation() -> Column:
    n, total, squares = (m.cast("double") for m in _arr_moments())
    variance = ratio(squares - total * ratio(total, n), n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))


def _rolled(cells: DataFrame, name: str, *columns: Column) -> DataFrame:
    return cells.groupBy(*HISTORY_KEYS[name]).agg(*columns)


def _route_columns() -> list[Column]:
    spread = F.coalesce(_arr_deviation(), F.lit(30.0))
    return [
        _arr_mean().alias("RouteAvgDelay"),
        _arr_deviation().alias("RouteStdDelay"),
        F.percentile("ArrDelay", F.lit(0.5), F.col("_n")).alias("RouteMedianDelay"),
        _mean_of("_dep").alias("RouteAvgDepDelay"),
        clip(100 - clip(spread, 0, 60), 0, 100).alias("RouteRobustnessScore"),
    ]


def _history_columns() -> dict[str, list[Column]]:
    return {
        "route": _route_columns(),
        "origin": [_mean_of("_dep").alias("Origin_AvgDepDelay"),
                   _mean_of("_out").alias("OriginCongestion")],
        "dest": [_arr_mean().alias("Dest_AvgArrDelay"), _mean_of("_in").alias("DestCongestion")],
        "carrier": [_arr_mean().alias("CarrierAvgDelay")],
    }


def history_table(train: DataFrame, name: str) -> DataFrame:
    """The route, origin, dest or carrier history of the training legs."""
    return _rolled(history_cells(train), name, *_history_columns()[name])


HISTORY_KEYS = {
    "route": ["Origin", "Dest"],
    "origin": ["Origin"],
    "dest": ["Dest"],
    "carrier": ["UniqueCarrier"],
}


# what a history table says of the legs behind each row: their number and their ids
SOURCE = ("SourceLegs", "SourceIds")


def history_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """The four history tables, from the cells of the training legs, with their sources."""
    return {
        name: _rolled(cells, name, *columns, F.sum("_n").alias(SOURCE[0]),
                      F.sum("_ids").alias(SOURCE[1]))
        for name, columns in _history_columns().items()
    }


def apply_history(df: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """Left-join every table in ``stats`` (the carrier table may be left out).

    There is no broadcast hint. Pass tables read from files (``staged`` or
    ``read_history``): the planner then knows their size, broadcasts the small ones
    and shuffles, with skew handling, those that are not.
    """
    joined = df
    for name, keys in HISTORY_KEYS.items():
        if name in stats:
            joined = joined.join(stats[name].drop(*SOURCE), keys, "left")
    return joined


# -- selection and fill --------------------------------------------------------

def select_features(
    df: DataFrame, features: tuple[str, ...] = FEATURES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The wanted features that exist; warns about the others."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        warnings.warn(f"missing features: {missing}", stacklevel=2)
    return df.select(*keep, *[f for f in features if f in df.columns])


def train_medians(train: DataFrame, cols: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row of exact medians, from one pass over the legs.

    Each task counts the distinct values of every column, and the counts are merged. Features
    take few values (clock minutes, flags, one value per history key), so what is merged does
    not grow with the legs.
    """
    present = [c for c in cols if c in train.columns]
    return train.agg(*[
        F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in present])


def fill_features(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Nulls become the training median, or 0 where there is none."""
    cols = [c for c in medians.columns if c in df.columns]
    renamed = medians.select([F.col(c).alias(f"_median_{c}") for c in cols])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}"), F.lit(0.0))
              for c in cols}
    return one_row(df, renamed).withColumns(filled).drop(*renamed.columns)
