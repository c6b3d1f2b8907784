"""The descriptive run: clean flights to every route, carrier and airport table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flightops.operators import clean as C
from flightops.operators import metrics as M
from flightops.operators import rotation as R
from flightops.operators import scores as S
from flightops.schema import LIMITS
from flightops.session import staged


def measured(flights: DataFrame) -> DataFrame:
    """Clean flights with route and air-time columns; no shuffle."""
    return C.with_route(C.with_airtime(C.clean_ops(flights)))


def rotated(flights: DataFrame, clock: str = "hhmm", **hot) -> DataFrame:
    """Measured flights with turnaround, penalty and propagation; one walk per aircraft."""
    walked = R.with_prev_leg(measured(flights), **hot)
    return R.with_propagation(C.with_turnaround_penalty(R.with_turnaround(walked, clock)))


# what the tables below read of a rotated leg
LEG_COLUMNS = (
    "FlightNum", "Route", "Origin", "UniqueCarrier", "DepDelay", "TurnaroundTime",
    "TurnaroundInefficiency", "PrevFlightDelay", "DelayPropagated",
)


def rotated_legs(
    flights: DataFrame, clock: str = "hhmm", sources: tuple[str, ...] = (), **hot
) -> DataFrame:
    """Rotated flights as a stored table, so that all turnaround and propagation
    tables share one walk over the aircraft."""
    return staged(
        flights.sparkSession, f"rotated-{clock}",
        lambda: rotated(flights, clock, **hot).select(*LEG_COLUMNS), sources,
    )


def route_table(
    df: DataFrame, min_flights: int = LIMITS.min_route_flights, raw: DataFrame | None = None,
    sources: tuple[str, ...] = (),
) -> DataFrame:
    """Route statistics with scores, flags, robustness and segment.

    The statistics are stored first: the P95 and the medians then read a table of one
    row per route instead of all flights. With ``raw`` the cancel rate is taken before
    cleaning (by ``Origin-Dest``). ``sources`` name the files behind the measured
    flights, to keep the table for the session.
    """
    def build() -> DataFrame:
        stats = M.route_stats(df, min_flights)
        return stats if raw is None else M.with_cancel_rate(stats, C.with_route(raw), "Route")

    name = f"routes-{min_flights}{'' if raw is None else '-raw'}"
    stats = staged(df.sparkSession, name, build, sources)
    scored = S.bottleneck_flags(S.efficiency_score(stats))
    return S.quadrants(S.recovery_capability(S.robustness_score(scored)))


def carrier_table(
    df: DataFrame, carriers: DataFrame, sources: tuple[str, ...] = ()
) -> DataFrame:
    """Carrier statistics with scores and names."""
    stats = staged(df.sparkSession, "carriers", lambda: M.carrier_stats(df), sources)
    return M.with_carrier_name(S.robustness_score(S.efficiency_score(stats)), carriers)


def taxi_tables(
    df: DataFrame, min_flights: int = LIMITS.min_airport_flights, sources: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(taxi-out by origin, taxi-in by destination) with inefficiency, stored."""
    spark = df.sparkSession
    out = staged(spark, f"taxi-out-{min_flights}",
                 lambda: M.taxi_out_by_origin(df, min_flights), sources)
    inn = staged(spark, f"taxi-in-{min_flights}",
                 lambda: M.taxi_in_by_dest(df, min_flights), sources)
    return S.taxi_inefficiency(out, "Out"), S.taxi_inefficiency(inn, "In")


def descriptive_tables(flights: DataFrame, carriers: DataFrame, **hot) -> dict[str, DataFrame]:
    """All result tables by name, ready for ``write_results``."""
    df, legs = measured(flights), rotated_legs(flights, **hot)
    out, inn = taxi_tables(df)
    return {
        "routes": route_table(df),
        "carriers": carrier_table(df, carriers),
        "taxi_out": out,
        "taxi_in": inn,
        "air_time": M.airtime_by_route(df),
        "turnaround": M.turnaround_by_origin(legs),
        "route_propagation": M.propagation(legs, "Route", LIMITS.min_incoming),
        "carrier_propagation": M.with_carrier_name(M.propagation(legs, "UniqueCarrier"), carriers),
        "cleaning": C.cleaning_report(flights),
    }
