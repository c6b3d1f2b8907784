"""Column types, the feature list and the fixed limits of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_INT, _STR = T.IntegerType(), T.StringType()

# Columns of the flight history file that have a declared type. Anything else
# found in a header is read as text.
FLIGHT_TYPES: dict[str, T.DataType] = {
    "Year": _INT,
    "Month": _INT,
    "DayofMonth": _INT,
    "DayOfMonth": _INT,
    "DayOfWeek": _INT,
    "DepTime": _INT,
    "CRSDepTime": _INT,
    "ArrTime": _INT,
    "CRSArrTime": _INT,
    "UniqueCarrier": _STR,
    "FlightNum": _INT,
    "TailNum": _STR,
    "ActualElapsedTime": _INT,
    "CRSElapsedTime": _INT,
    "AirTime": _INT,
    "ArrDelay": _INT,
    "DepDelay": _INT,
    "Origin": _STR,
    "Dest": _STR,
    "Distance": _INT,
    "TaxiIn": _INT,
    "TaxiOut": _INT,
    "Cancelled": _INT,
    "CancellationCode": _STR,
    "Diverted": _INT,
}

FLIGHT_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in FLIGHT_TYPES.items() if n != "DayOfMonth"]
)

CARRIER_SCHEMA = T.StructType(
    [T.StructField("Code", _STR), T.StructField("Description", _STR)]
)

REQUIRED_OPS = ("TaxiOut", "TaxiIn", "ArrDelay", "DepDelay", "Distance", "ActualElapsedTime")
REQUIRED_CASCADE = (
    "ArrDelay", "DepDelay", "CRSDepTime", "CRSArrTime", "Distance", "Origin", "Dest", "FlightDate",
)

# fixed values: the model inputs, in the order a scoring request lists them
TEMPORAL = (
    "Hour", "DayOfWeek", "Month", "IsWeekend", "IsRushHour", "IsEarlyMorning", "IsLateNight",
)
FLIGHT = ("Distance", "CRSElapsedTime", "IsShortHaul")
INCOMING = ("IncomingDelay", "HasIncomingDelay", "IncomingDepDelay")
TURNAROUND = ("TurnaroundMinutes", "TightTurnaround", "CriticalTurnaround", "InsufficientBuffer")
UTILIZATION = ("PositionInRotation", "IsFirstFlight", "IsEarlyRotation", "IsLateRotation")
HISTORY = (
    "RouteAvgDelay", "RouteStdDelay", "RouteRobustnessScore",
    "Origin_AvgDepDelay", "OriginCongestion", "Dest_AvgArrDelay", "DestCongestion",
)
FEATURES = TEMPORAL + FLIGHT + INCOMING + TURNAROUND + UTILIZATION + HISTORY


@dataclass(frozen=True)
class Limits:
    """Fixed values of the analysis, all in minutes unless named otherwise."""

    late: int = 15
    max_taxi: int = 200
    min_arr_delay: int = -60
    max_arr_delay: int = 600
    cruise_mph: int = 450
    no_turnaround: float = 999.0  # hours; marks a leg without a usable turnaround
    max_turnaround_hours: int = 48
    day_hours: int = 24
    taxi_out_bottleneck: int = 15
    taxi_in_bottleneck: int = 10
    air_time_bottleneck_pct: int = 10
    air_time_spread_pct: int = 15
    tight_rate: float = 0.2
    short_haul: int = 500
    long_haul: int = 1500
    min_route_flights: int = 100
    min_airport_flights: int = 1000
    min_turnaround_flights: int = 500
    min_incoming: int = 50


LIMITS = Limits()
