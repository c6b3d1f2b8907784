"""A second, independent statement of the registered queries, as SQL.

Nothing here is used by the engine. The text runs on the source tables and is
compared with the results of the Spark queries.
"""

from __future__ import annotations

import re

from flightops.schema import FEATURES

# -- shared tables -------------------------------------------------------------

_TABLES = {
    "lines": """
        SELECT *, l_linenumber AS ln, l_returnflag AS rf, CAST(l_quantity AS INT) AS q,
               CAST(round(l_discount * 100) AS INT) AS dc, CAST(round(l_tax * 100) AS INT) AS tx,
               CAST(l_partkey % 10 AS INT) AS o, CAST(l_orderkey % 10 AS INT) AS d,
               CAST((l_partkey*7 + l_orderkey*13 + l_linenumber*131) % 1080 + 300 AS INT) AS dep_min,
               DATE '2008-01-01'
                 + CAST(datediff('day', TIMESTAMP '1992-01-01', l_shipdate) % 120 AS INT) AS fd
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "shaped": """
        SELECT *, 150 + 97*o + 61*d AS dist,
               CAST(floor((150 + 97*o + 61*d) * 2 / 15.0E0) AS INT) + 4*d AS crs_el,
               CASE WHEN ln = 7 AND q < 5 THEN 1 ELSE 0 END AS canc,
               CASE WHEN ln = 5 AND q = 1 THEN 1 ELSE 0 END AS divr,
               q - 15 + CASE WHEN rf = 'R' THEN 30 ELSE 0 END AS dd0,
               CASE WHEN ln = 2 AND q = 49 THEN 650
                    ELSE q - 15 + CASE WHEN rf = 'R' THEN 30 ELSE 0 END + dc - 5 END AS ad0
        FROM lines""",
    "flights": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, q) AS FlightId,
               l_orderkey*8 + ln AS FlightNum, fd AS FlightDate,
               CAST(year(fd) AS INT) AS Year, CAST(month(fd) AS INT) AS Month,
               CAST(day(fd) AS INT) AS DayofMonth,
               CASE WHEN ln = 6 AND q > 45 THEN NULL ELSE concat('N', l_suppkey) END AS TailNum,
               CAST(s_nationkey AS VARCHAR) AS UniqueCarrier,
               concat('A', o) AS Origin, concat('B', d) AS Dest,
               CAST(floor(dep_min/60.0E0)*100 + dep_min%60 AS INT) AS CRSDepTime,
               CAST(floor(((dep_min+crs_el)%1440)/60.0E0)*100 + ((dep_min+crs_el)%1440)%60 AS INT)
                 AS CRSArrTime,
               CASE WHEN canc + divr = 0 THEN
                 CAST(floor(((dep_min+crs_el+ad0+1440)%1440)/60.0E0)*100
                      + ((dep_min+crs_el+ad0+1440)%1440)%60 AS INT) END AS ArrTime,
               crs_el AS CRSElapsedTime,
               CASE WHEN canc + divr = 0 THEN crs_el + ad0 - dd0 END AS ActualElapsedTime,
               CASE WHEN canc + divr = 0 THEN ad0 END AS ArrDelay,
               CASE WHEN canc = 0 THEN dd0 END AS DepDelay,
               CASE WHEN canc = 0 THEN CASE WHEN ln = 1 AND q = 50 THEN 0 ELSE 8 + o + tx END END
                 AS TaxiOut,
               CASE WHEN canc + divr = 0 THEN 3 + d + ln%3 END AS TaxiIn,
               dist AS Distance, canc AS Cancelled, divr AS Diverted
        FROM shaped""",
    "carriers": "SELECT CAST(n_nationkey AS VARCHAR) AS Code, n_name AS Description FROM nation",
    "ops": """
        SELECT *, CAST(datediff('day', DATE '2000-01-01', FlightDate) AS INT) AS dayno
        FROM flights
        WHERE Cancelled = 0 AND TaxiOut IS NOT NULL AND TaxiIn IS NOT NULL
          AND ArrDelay IS NOT NULL AND DepDelay IS NOT NULL AND Distance IS NOT NULL
          AND ActualElapsedTime IS NOT NULL AND TaxiOut > 0 AND TaxiOut < 200
          AND TaxiIn > 0 AND TaxiIn < 200 AND Distance > 0 AND ActualElapsedTime > 0""",
    "measured": """
        SELECT *, greatest(-50.0E0, least(200.0E0, dev / expected * 100)) AS dev_pct
        FROM (SELECT *, ActualElapsedTime - expected AS dev
              FROM (SELECT *, Distance / 450.0E0 * 60 AS expected,
                           Origin || '-' || Dest AS Route FROM ops))""",
    "prev": """
        SELECT *, CASE WHEN TailNum IS NOT NULL THEN lag(ArrTime) OVER w END AS PrevArrTime,
               CASE WHEN TailNum IS NOT NULL THEN lag(dayno) OVER w END AS PrevFlightDate,
               CASE WHEN TailNum IS NOT NULL THEN lag(ArrDelay) OVER w END AS PrevFlightDelay
        FROM measured
        WINDOW w AS (PARTITION BY TailNum ORDER BY FlightDate, CRSDepTime, FlightId)""",
    "rot": """
        SELECT *, CASE WHEN hours > 0 AND hours < 24 THEN
                    CASE WHEN hours < 1.0 THEN 75 WHEN hours < 1.5 THEN 25 ELSE 0 END
                  ELSE 0 END AS penalty,
               CASE WHEN PrevFlightDelay > 15 AND DepDelay > 15 THEN 1 ELSE 0 END AS passed
        FROM (SELECT *, coalesce(CASE
                 WHEN dayno = PrevFlightDate AND CRSDepTime >= PrevArrTime
                   THEN (CRSDepTime - PrevArrTime) / 60.0E0
                 WHEN dayno = PrevFlightDate + 1 AND (1440 - PrevArrTime + CRSDepTime) / 60.0E0 < 48
                   THEN (1440 - PrevArrTime + CRSDepTime) / 60.0E0 END, 999.0E0) AS hours
              FROM prev)""",
    "rstats": """
        SELECT Route,
               round_even(avg(ArrDelay)*100, 0)/100 AS AvgArrDelay,
               round_even(stddev_samp(ArrDelay)*100, 0)/100 AS StdArrDelay,
               round_even(avg(DepDelay)*100, 0)/100 AS AvgDepDelay,
               round_even(stddev_samp(DepDelay)*100, 0)/100 AS StdDepDelay,
               round_even(avg(TaxiOut)*100, 0)/100 AS AvgTaxiOut,
               round_even(stddev_samp(TaxiOut)*100, 0)/100 AS StdTaxiOut,
               round_even(avg(TaxiIn)*100, 0)/100 AS AvgTaxiIn,
               round_even(stddev_samp(TaxiIn)*100, 0)/100 AS StdTaxiIn,
               round_even(avg(dev)*100, 0)/100 AS AvgAirTimeDeviation,
               round_even(stddev_samp(dev)*100, 0)/100 AS StdAirTimeDeviation,
               round_even(avg(dev_pct)*100, 0)/100 AS AvgAirTimeDeviationPct,
               arg_min(Distance, (TailNum IS NULL, TailNum, FlightDate, CRSDepTime, FlightId))
                 AS Distance,
               round_even(avg(ActualElapsedTime)*100, 0)/100 AS AvgElapsedTime,
               count(FlightNum) AS FlightCount,
               round_even(avg(CASE WHEN ArrDelay <= 15 THEN 1.0E0 ELSE 0 END)*1000, 0)/1000
                 AS OnTimeRate,
               round_even(quantile_cont(TaxiOut, 0.9)*100, 0)/100 AS P90TaxiOut,
               round_even(quantile_cont(TaxiIn, 0.9)*100, 0)/100 AS P90TaxiIn,
               0.0E0 AS CancelRate
        FROM measured GROUP BY Route HAVING count(FlightNum) >= 100""",
    "reff": """
        SELECT *, round_even(greatest(0.0E0, least(100.0E0,
                    OnTimeComponent + ReliabilityComponent + DelayComponent + SmoothComponent))*10,
                    0)/10 AS EfficiencyScore
        FROM (SELECT *, OnTimeRate*40 AS OnTimeComponent, (1-CancelRate)*20 AS ReliabilityComponent,
                (1 - greatest(0.0E0, least(60.0E0, AvgArrDelay))/60)*20 AS DelayComponent,
                CASE WHEN StdArrDelay IS NOT NULL THEN
                  (1 - greatest(0.0E0, least(60.0E0, StdArrDelay))/60)*20 END AS SmoothComponent
              FROM rstats)""",
    "rflag": """
        SELECT *, t_out AS TaxiOutBottleneck, t_in AS TaxiInBottleneck, air AS AirTimeBottleneck,
               t_out + t_in + air AS TotalBottlenecks,
               CASE WHEN t_out + t_in + air = 0 THEN 'None' ELSE concat_ws(', ',
                 CASE WHEN t_out = 1 THEN 'TaxiOut' END, CASE WHEN t_in = 1 THEN 'TaxiIn' END,
                 CASE WHEN air = 1 THEN 'AirTime' END) END AS PrimaryBottleneck
        FROM (SELECT *, CASE WHEN AvgTaxiOut > 15 THEN 1 ELSE 0 END AS t_out,
                     CASE WHEN AvgTaxiIn > 10 THEN 1 ELSE 0 END AS t_in,
                     CASE WHEN AvgAirTimeDeviationPct > 10 THEN 1 ELSE 0 END AS air FROM reff)""",
    "rrob": """
        SELECT r.*, round_even(100*(1 - greatest(0.0E0, least(1.0E0, StdArrDelay/p95)))*10, 0)/10
                 AS RobustnessScore,
               round_even(StdArrDelay/(abs(AvgArrDelay)+1)*100, 0)/100 AS DelayCV,
               round_even(greatest(0.0E0, least(2.0E0, OnTimeRate /
                 (1 - greatest(0.0E0, least(60.0E0, AvgArrDelay))/60 + 0.1)))*100, 0)/100
                 AS RecoveryCapability
        FROM rflag r, (SELECT quantile_cont(StdArrDelay, 0.95) AS p95 FROM rflag)""",
    "routes": """
        SELECT r.*, CASE WHEN EfficiencyScore >= me THEN 'HIGH' ELSE 'LOW' END || '_EFF_'
                 || CASE WHEN RobustnessScore >= mr THEN 'HIGH' ELSE 'LOW' END || '_ROB' AS Category
        FROM rrob r, (SELECT median(EfficiencyScore) AS me, median(RobustnessScore) AS mr FROM rrob)
        """,
    "cstats": """
        SELECT UniqueCarrier,
               round_even(avg(ArrDelay)*100, 0)/100 AS AvgArrDelay,
               round_even(stddev_samp(ArrDelay)*100, 0)/100 AS StdArrDelay,
               round_even(avg(DepDelay)*100, 0)/100 AS AvgDepDelay,
               round_even(stddev_samp(DepDelay)*100, 0)/100 AS StdDepDelay,
               round_even(avg(TaxiOut)*100, 0)/100 AS AvgTaxiOut,
               round_even(avg(TaxiIn)*100, 0)/100 AS AvgTaxiIn,
               round_even(avg(dev)*100, 0)/100 AS AvgAirTimeDeviation,
               round_even(avg(dev_pct)*100, 0)/100 AS AvgAirTimeDeviationPct,
               count(FlightNum) AS FlightCount,
               round_even(avg(CASE WHEN ArrDelay <= 15 THEN 1.0E0 ELSE 0 END)*1000, 0)/1000
                 AS OnTimeRate,
               0.0E0 AS CancelRate
        FROM measured GROUP BY UniqueCarrier""",
    "cscore": """
        SELECT *, round_even(greatest(0.0E0, least(100.0E0, OnTimeRate*40 + (1-CancelRate)*20
                 + (1 - greatest(0.0E0, least(60.0E0, AvgArrDelay))/60)*20
                 + (1 - greatest(0.0E0, least(60.0E0, StdArrDelay))/60)*20))*10, 0)/10
                 AS EfficiencyScore
        FROM cstats""",
    "ctable": """
        SELECT c.*, round_even(100*(1 - greatest(0.0E0, least(1.0E0, StdArrDelay/p95)))*10, 0)/10
                 AS RobustnessScore,
               round_even(StdArrDelay/(abs(AvgArrDelay)+1)*100, 0)/100 AS DelayCV, Description
        FROM cscore c CROSS JOIN (SELECT quantile_cont(StdArrDelay, 0.95) AS p95 FROM cscore)
        LEFT JOIN carriers ON Code = UniqueCarrier""",
    "rprop": """
        SELECT Route, round_even(sum(passed)/(count(*)+1.0E0)*1000, 0)/1000 AS PropagationRate,
               nullif(count(*) FILTER (PrevFlightDelay > 15), 0) AS FlightsWithIncomingDelay,
               count(*) AS TotalFlights,
               round_even(sum(passed)/(1.0E0*nullif(count(*) FILTER (PrevFlightDelay > 15), 0))*1000,
                          0)/1000 AS ConditionalRate
        FROM rot GROUP BY Route""",
    "cprop": """
        SELECT UniqueCarrier, round_even(sum(passed)/(count(*)+1.0E0)*1000, 0)/1000
                 AS PropagationRate,
               nullif(count(*) FILTER (PrevFlightDelay > 15), 0) AS FlightsWithIncomingDelay,
               count(*) AS TotalFlights,
               round_even(sum(passed)/(1.0E0*nullif(count(*) FILTER (PrevFlightDelay > 15), 0))*1000,
                          0)/1000 AS ConditionalRate, any_value(Description) AS Description
        FROM rot LEFT JOIN carriers ON Code = UniqueCarrier GROUP BY UniqueCarrier""",
    "tout": """
        SELECT *, round_even((AvgTaxiOut*0.6E0 + P90TaxiOut*0.3E0 + StdTaxiOut*0.1E0)*10, 0)/10
                 AS TaxiOutInefficiency
        FROM (SELECT Origin, round_even(avg(TaxiOut)*100, 0)/100 AS AvgTaxiOut,
                round_even(stddev_samp(TaxiOut)*100, 0)/100 AS StdTaxiOut,
                round_even(avg(DepDelay)*100, 0)/100 AS AvgDepDelay, count(FlightNum) AS FlightCount,
                round_even(quantile_cont(TaxiOut, 0.9)*100, 0)/100 AS P90TaxiOut,
                round_even(quantile_cont(TaxiOut, 0.95)*100, 0)/100 AS P95TaxiOut
              FROM measured GROUP BY Origin HAVING count(FlightNum) >= 1000)""",
    "tin": """
        SELECT *, round_even((AvgTaxiIn*0.6E0 + P90TaxiIn*0.3E0 + StdTaxiIn*0.1E0)*10, 0)/10
                 AS TaxiInInefficiency
        FROM (SELECT Dest, round_even(avg(TaxiIn)*100, 0)/100 AS AvgTaxiIn,
                round_even(stddev_samp(TaxiIn)*100, 0)/100 AS StdTaxiIn,
                round_even(avg(ArrDelay)*100, 0)/100 AS AvgArrDelay, count(FlightNum) AS FlightCount,
                round_even(quantile_cont(TaxiIn, 0.9)*100, 0)/100 AS P90TaxiIn,
                round_even(quantile_cont(TaxiIn, 0.95)*100, 0)/100 AS P95TaxiIn
              FROM measured GROUP BY Dest HAVING count(FlightNum) >= 1000)""",
    "airt": """
        SELECT *, CASE WHEN AvgAirTimeDeviationPct > 10 OR StdAirTimeDeviationPct > 15 THEN 1
                  ELSE 0 END AS HasAirTimeIssue
        FROM (SELECT Route, round_even(avg(dev)*100, 0)/100 AS AvgAirTimeDeviation,
                round_even(stddev_samp(dev)*100, 0)/100 AS StdAirTimeDeviation,
                round_even(avg(dev_pct)*100, 0)/100 AS AvgAirTimeDeviationPct,
                round_even(stddev_samp(dev_pct)*100, 0)/100 AS StdAirTimeDeviationPct,
                arg_min(Distance, (TailNum IS NULL, TailNum, FlightDate, CRSDepTime, FlightId))
                  AS Distance,
                round_even(avg(ActualElapsedTime)*100, 0)/100 AS AvgActualTime,
                round_even(avg(expected)*100, 0)/100 AS AvgExpectedTime,
                count(FlightNum) AS FlightCount
              FROM measured GROUP BY Route HAVING count(FlightNum) >= 100)""",
    "turn": """
        SELECT Origin, round_even(avg(hours)*100, 0)/100 AS AvgTurnaround,
               round_even(stddev_samp(hours)*100, 0)/100 AS StdTurnaround,
               round_even(avg(penalty)*100, 0)/100 AS AvgInefficiency,
               round_even(avg(DepDelay)*100, 0)/100 AS AvgDepDelay, count(FlightNum) AS FlightCount,
               round_even(quantile_cont(hours, 0.1)*100, 0)/100 AS P10Turnaround,
               round_even(count(CASE WHEN hours < 1 THEN FlightNum END)
                          /(1.0E0*count(FlightNum))*1000, 0)/1000 AS TightTurnaroundRate
        FROM rot WHERE hours < 24 GROUP BY Origin HAVING count(FlightNum) >= 500""",
    "casc": """
        SELECT *, CAST(datediff('day', DATE '2000-01-01', FlightDate) AS INT) AS dayno FROM flights
        WHERE Cancelled = 0 AND Diverted = 0 AND TailNum IS NOT NULL AND ArrDelay IS NOT NULL
          AND DepDelay IS NOT NULL AND CRSDepTime IS NOT NULL AND CRSArrTime IS NOT NULL
          AND Distance IS NOT NULL AND Origin IS NOT NULL AND Dest IS NOT NULL
          AND FlightDate IS NOT NULL AND Distance > 0 AND ArrDelay BETWEEN -60 AND 600""",
    "nextleg": """
        SELECT *, lead(DepDelay) OVER w AS n_dep, lead(ArrDelay) OVER w AS n_arr,
               lead(FlightDate) OVER w AS n_date, lead(CRSDepTime) OVER w AS n_clock,
               (CASE WHEN lead(CRSDepTime) OVER w - CRSArrTime < 0
                     THEN lead(CRSDepTime) OVER w - CRSArrTime + 2400
                     ELSE lead(CRSDepTime) OVER w - CRSArrTime END) / 100.0E0 AS gap
        FROM casc WINDOW w AS (PARTITION BY TailNum ORDER BY FlightDate, CRSDepTime, FlightId)""",
    "labelled": """
        SELECT l.*, CASE WHEN ArrDelay > 15 AND n_dep > 15 AND n_date = FlightDate AND gap > 0
                         AND gap < 24 THEN 1 ELSE 0 END AS y
        FROM nextleg l WHERE n_dep IS NOT NULL""",
    "legs": """
        SELECT l.*, CASE WHEN dayno < cut THEN 'train' ELSE 'test' END AS split
        FROM labelled l, (SELECT quantile_cont(dayno, 0.75) AS cut FROM labelled)""",
    "train": "SELECT * FROM legs WHERE split = 'train'",
    "feat": """
        SELECT *, CASE WHEN inc > 15 THEN 1 ELSE 0 END AS HasIncomingDelay,
               gap*60 AS TurnaroundMinutes,
               CASE WHEN gap < 1.0 THEN 1 ELSE 0 END AS TightTurnaround,
               CASE WHEN gap < 0.75 THEN 1 ELSE 0 END AS CriticalTurnaround,
               CASE WHEN gap*60 - inc < 30 THEN 1 ELSE 0 END AS InsufficientBuffer,
               CASE WHEN place = 1 THEN 1 ELSE 0 END AS IsFirstFlight,
               CASE WHEN place <= 3 THEN 1 ELSE 0 END AS IsEarlyRotation,
               CASE WHEN place >= 5 THEN 1 ELSE 0 END AS IsLateRotation,
               round_even(1/(1+exp(-(0.05E0*inc + 0.5E0*CASE WHEN gap < 1.0 THEN 1 ELSE 0 END
                                     - 0.1E0*place - 0.5E0)))*10000, 0)/10000 AS score
        FROM (SELECT *, CAST(coalesce(lag(ArrDelay) OVER w, 0) AS DOUBLE) AS inc,
                     CAST(coalesce(lag(DepDelay) OVER w, 0) AS DOUBLE) AS inc_dep,
                     CAST(row_number() OVER (PARTITION BY split, TailNum, FlightDate
                       ORDER BY CRSDepTime, FlightId) AS INT) AS place
              FROM legs
              WINDOW w AS (PARTITION BY split, TailNum ORDER BY FlightDate, CRSDepTime, FlightId))
        """,
    "hroute": """
        SELECT Origin, Dest, avg(ArrDelay) AS RouteAvgDelay, stddev_samp(ArrDelay) AS RouteStdDelay,
               median(ArrDelay) AS RouteMedianDelay, avg(DepDelay) AS RouteAvgDepDelay,
               greatest(0.0E0, least(100.0E0, 100 - greatest(0.0E0, least(60.0E0,
                 coalesce(stddev_samp(ArrDelay), 30.0E0))))) AS RouteRobustnessScore
        FROM train GROUP BY Origin, Dest""",
    "horigin": """
        SELECT Origin, avg(DepDelay) AS Origin_AvgDepDelay, avg(TaxiOut) AS OriginCongestion
        FROM train GROUP BY Origin""",
    "hdest": """
        SELECT Dest, avg(ArrDelay) AS Dest_AvgArrDelay, avg(TaxiIn) AS DestCongestion
        FROM train GROUP BY Dest""",
    "hcarrier": """
        SELECT UniqueCarrier, avg(ArrDelay) AS CarrierAvgDelay FROM train GROUP BY UniqueCarrier""",
    "joined": """
        SELECT FlightId, FlightDate, split, y, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred,
               CAST(floor(CRSDepTime/100.0E0) AS INT) AS Hour,
               CAST(isodow(FlightDate) - 1 AS INT) AS DayOfWeek, Month,
               CASE WHEN isodow(FlightDate) >= 6 THEN 1 ELSE 0 END AS IsWeekend,
               CASE WHEN CRSDepTime//100 IN (6,7,8,16,17,18) THEN 1 ELSE 0 END AS IsRushHour,
               CASE WHEN CRSDepTime//100 IN (5,6,7,8) THEN 1 ELSE 0 END AS IsEarlyMorning,
               CASE WHEN CRSDepTime//100 IN (21,22,23,0,1,2) THEN 1 ELSE 0 END AS IsLateNight,
               CAST(Distance AS DOUBLE) AS Distance, CAST(CRSElapsedTime AS DOUBLE) AS CRSElapsedTime,
               CASE WHEN Distance < 500 THEN 1 ELSE 0 END AS IsShortHaul,
               inc AS IncomingDelay, HasIncomingDelay, inc_dep AS IncomingDepDelay,
               TurnaroundMinutes, TightTurnaround, CriticalTurnaround, InsufficientBuffer,
               place AS PositionInRotation, IsFirstFlight, IsEarlyRotation, IsLateRotation,
               RouteAvgDelay, RouteStdDelay, RouteRobustnessScore, Origin_AvgDepDelay,
               OriginCongestion, Dest_AvgArrDelay, DestCongestion, RouteMedianDelay,
               RouteAvgDepDelay, CarrierAvgDelay, CRSDepTime
        FROM feat LEFT JOIN hroute USING (Origin, Dest) LEFT JOIN horigin USING (Origin)
        LEFT JOIN hdest USING (Dest) LEFT JOIN hcarrier USING (UniqueCarrier)""",
    "test": "SELECT * FROM joined WHERE split = 'test'",
    "indexed": """
        SELECT *, row_number() OVER (ORDER BY FlightDate, CRSDepTime, FlightId) - 1 AS idx,
               count(*) OVER () AS n
        FROM joined WHERE split = 'train'""",
    "folds": """
        SELECT *, CASE WHEN idx >= n - 5*(n//6) THEN (idx - (n - 5*(n//6)))//(n//6) + 1 ELSE 0 END
                 AS fold
        FROM indexed""",
    "cm": """
        SELECT count(*) FILTER (y=0 AND pred=0) AS tn, count(*) FILTER (y=0 AND pred=1) AS fp,
               count(*) FILTER (y=1 AND pred=0) AS fn, count(*) FILTER (y=1 AND pred=1) AS tp
        FROM test""",
    "byscore": """
        SELECT score AS threshold, count(*) FILTER (y=1) AS pos, count(*) FILTER (y=0) AS neg
        FROM test GROUP BY score""",
    "ranked": """
        SELECT threshold, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
               sum(pos) OVER () AS p, sum(neg) OVER () AS n
        FROM byscore WINDOW w AS (ORDER BY threshold DESC)""",
    "tiers": """
        SELECT t.*, CASE WHEN score >= c THEN 'CRITICAL' WHEN score >= h THEN 'HIGH'
                         WHEN score >= e THEN 'ELEVATED' ELSE 'NORMAL' END AS RiskTier
        FROM test t, (SELECT quantile_cont(score, 0.95) AS c, quantile_cont(score, 0.9) AS h,
                             quantile_cont(score, 0.8) AS e FROM test)""",
}


def _with(body: str) -> str:
    """Prefix the shared tables that the text uses, directly or not."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", text):
            if name in _TABLES and name not in needed:
                needed.add(name)
                visit(_TABLES[name])

    visit(body)
    parts = [f"{n} AS ({sql})" for n, sql in _TABLES.items() if n in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _r6(*cols: str) -> str:
    return ", ".join(f"round_even({c}*1000000, 0)/1000000 AS {c}" for c in cols)


_HIST = ("RouteAvgDelay", "RouteStdDelay", "RouteRobustnessScore", "Origin_AvgDepDelay",
         "OriginCongestion", "Dest_AvgArrDelay", "DestCongestion")
_PLAIN = tuple(f for f in FEATURES if f not in _HIST)

_ROUTE_COLS = ("Route, EfficiencyScore, OnTimeRate, AvgArrDelay, AvgTaxiOut, AvgTaxiIn, "
               "AvgAirTimeDeviationPct")
_ROBUST_COLS = "RobustnessScore, StdArrDelay, AvgArrDelay, DelayCV, OnTimeRate"
_CARRIER_COLS = ("UniqueCarrier, Description, EfficiencyScore, OnTimeRate, AvgArrDelay, AvgTaxiOut, "
                 "AvgTaxiIn, AvgAirTimeDeviationPct, FlightCount")


def _top(cols: str, table: str, by: str, n: int, way: str = "DESC") -> str:
    key = cols.split(",")[0]
    return f"SELECT {cols} FROM {table} ORDER BY {by} {way} NULLS LAST, {key} LIMIT {n}"


# raw requests: FlightNum % k decides which fields are left out
_RAW = """
    SELECT FlightId AS RequestId, upper(lower(Origin)) AS o2,
           CASE WHEN FlightNum % 5 = 0 THEN 'ZZZ' ELSE Dest END AS d2,
           CASE WHEN FlightNum % 2 = 0 OR FlightNum % 4 = 1
                THEN CAST(CRSDepTime//100 AS INT) ELSE 12 END AS Hour,
           CASE WHEN FlightNum % 3 <> 0 THEN CAST(isodow(FlightDate)-1 AS INT) ELSE 2 END
             AS DayOfWeek,
           CASE WHEN FlightNum % 3 <> 1 THEN Month ELSE 6 END AS Month,
           CASE WHEN FlightNum % 7 <> 0 THEN CAST(Distance AS DOUBLE) ELSE 800.0E0 END AS Distance,
           CASE WHEN FlightNum % 7 <> 1 THEN CAST(CRSElapsedTime AS DOUBLE) ELSE 120.0E0 END
             AS CRSElapsedTime,
           coalesce(CAST(ArrDelay AS DOUBLE), 0.0E0) AS IncomingDelay,
           coalesce(CAST(DepDelay AS DOUBLE), 0.0E0) AS IncomingDepDelay,
           CASE WHEN FlightNum % 11 <> 0 AND TaxiOut IS NOT NULL THEN CAST(TaxiOut*3 AS DOUBLE)
                ELSE 120.0E0 END AS TurnaroundMinutes,
           CASE WHEN FlightNum % 11 <> 1 THEN CAST(FlightNum % 7 AS INT) ELSE 1 END
             AS PositionInRotation
    FROM flights"""

_NUMBERS = ", ".join(
    f"CAST({('CRSDepTime', 'Distance', 'Cancelled', 'CRSElapsedTime')[i % 4]} + {i} AS DOUBLE) AS {f}"
    for i, f in enumerate(FEATURES)
)

_REQUEST_FEATURES = f"""
        SELECT RequestId, Hour, DayOfWeek, Month,
               CASE WHEN DayOfWeek IN (5,6) THEN 1 ELSE 0 END AS IsWeekend,
               CASE WHEN Hour IN (6,7,8,16,17,18) THEN 1 ELSE 0 END AS IsRushHour,
               CASE WHEN Hour IN (5,6,7,8) THEN 1 ELSE 0 END AS IsEarlyMorning,
               CASE WHEN Hour IN (21,22,23,0,1,2) THEN 1 ELSE 0 END AS IsLateNight,
               Distance, CRSElapsedTime, CASE WHEN Distance < 500 THEN 1 ELSE 0 END AS IsShortHaul,
               IncomingDelay, CASE WHEN IncomingDelay > 15 THEN 1 ELSE 0 END AS HasIncomingDelay,
               IncomingDepDelay, TurnaroundMinutes,
               CASE WHEN TurnaroundMinutes < 60 THEN 1 ELSE 0 END AS TightTurnaround,
               CASE WHEN TurnaroundMinutes < 45 THEN 1 ELSE 0 END AS CriticalTurnaround,
               CASE WHEN TurnaroundMinutes - IncomingDelay < 30 THEN 1 ELSE 0 END
                 AS InsufficientBuffer,
               PositionInRotation,
               CASE WHEN PositionInRotation = 1 THEN 1 ELSE 0 END AS IsFirstFlight,
               CASE WHEN PositionInRotation <= 3 THEN 1 ELSE 0 END AS IsEarlyRotation,
               CASE WHEN PositionInRotation >= 5 THEN 1 ELSE 0 END AS IsLateRotation,
               {_r6(*_HIST)}
        FROM (SELECT a.*,
                 CASE WHEN r.Origin IS NULL THEN 5.0E0 ELSE RouteAvgDelay END AS RouteAvgDelay,
                 CASE WHEN r.Origin IS NULL THEN 15.0E0 ELSE RouteStdDelay END AS RouteStdDelay,
                 CASE WHEN r.Origin IS NULL THEN 70.0E0 ELSE RouteRobustnessScore END
                   AS RouteRobustnessScore,
                 CASE WHEN h.Origin IS NULL THEN 8.0E0 ELSE Origin_AvgDepDelay END
                   AS Origin_AvgDepDelay,
                 CASE WHEN h.Origin IS NULL THEN 15.0E0 ELSE OriginCongestion END
                   AS OriginCongestion,
                 CASE WHEN g.Dest IS NULL THEN 6.0E0 ELSE Dest_AvgArrDelay END AS Dest_AvgArrDelay,
                 CASE WHEN g.Dest IS NULL THEN 12.0E0 ELSE DestCongestion END AS DestCongestion
              FROM ({_RAW}) a
              LEFT JOIN hroute r ON r.Origin = o2 AND r.Dest = d2
              LEFT JOIN horigin h ON h.Origin = o2 LEFT JOIN hdest g ON g.Dest = d2)"""
_AS_DOUBLES = (
    "SELECT RequestId, " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    + f" FROM ({_REQUEST_FEATURES})"
)

_ORACLE = {
    "cln01_split_cancelled": """
        SELECT FlightId, CASE WHEN Cancelled = 0 THEN 'kept' ELSE 'cancelled' END AS part
        FROM flights WHERE Cancelled IN (0, 1)""",
    "cln02_drop_diverted": "SELECT FlightId FROM flights WHERE Diverted = 0",
    "cln03_require_tail": "SELECT FlightId, TailNum FROM flights WHERE TailNum IS NOT NULL",
    "cln04_required_fields_ops": """
        SELECT FlightId FROM flights WHERE TaxiOut IS NOT NULL AND TaxiIn IS NOT NULL
          AND ArrDelay IS NOT NULL AND DepDelay IS NOT NULL AND Distance IS NOT NULL
          AND ActualElapsedTime IS NOT NULL""",
    "cln05_required_fields_cascade": """
        SELECT FlightId FROM flights WHERE ArrDelay IS NOT NULL AND DepDelay IS NOT NULL
          AND CRSDepTime IS NOT NULL AND CRSArrTime IS NOT NULL AND Distance IS NOT NULL
          AND Origin IS NOT NULL AND Dest IS NOT NULL AND FlightDate IS NOT NULL""",
    "cln06_clean_ops": """
        SELECT FlightId, TaxiOut, TaxiIn, ArrDelay, DepDelay, Distance, ActualElapsedTime FROM ops""",
    "cln07_clean_cascade": """
        SELECT FlightId, TailNum, ArrDelay, DepDelay, CRSDepTime, CRSArrTime, Distance FROM casc""",
    "cln08_flight_date": """
        SELECT FlightId, TRY_CAST(concat(Year, '-', lpad(CAST(Month AS VARCHAR), 2, '0'), '-',
          CASE WHEN DayofMonth > 28 THEN '31' ELSE lpad(CAST(DayofMonth AS VARCHAR), 2, '0') END)
          AS DATE) AS FlightDate
        FROM flights""",
    "cln09_day_number": """
        SELECT FlightId, CAST(FlightDate - DATE '2000-01-01' AS INT) AS FlightDate_Numeric
        FROM flights""",
    "cln10_coerce_numeric": """
        SELECT FlightId, CAST(ArrDelay AS DOUBLE) AS ArrDelay, CAST(TaxiOut AS DOUBLE) AS TaxiOut
        FROM flights""",
    "cln11_cleaning_report_ops": """
        SELECT *, initial_rows - cleaned_rows AS removed_rows,
               round_even(cleaned_rows/(1.0E0*initial_rows)*100*100, 0)/100 AS retention_pct
        FROM (SELECT count(*) AS initial_rows, count(*) FILTER (Cancelled = 1) AS cancelled_rows,
                count(*) FILTER (Cancelled <> 0) AS not_flown_rows,
                count(*) FILTER (Cancelled = 0 AND ArrDelay IS NULL) AS missing_field_rows,
                count(*) FILTER (Cancelled = 0 AND ArrDelay IS NOT NULL AND FlightId NOT IN
                  (SELECT FlightId FROM ops)) AS invalid_value_rows,
                (SELECT count(*) FROM ops) AS cleaned_rows,
                (SELECT count(DISTINCT TailNum) FROM ops) AS aircraft,
                (SELECT min(FlightDate) FROM ops) AS first_date,
                (SELECT max(FlightDate) FROM ops) AS last_date
              FROM flights)""",
    "cln11_cleaning_report_cascade": """
        SELECT *, initial_rows - cleaned_rows AS removed_rows,
               round_even(cleaned_rows/(1.0E0*initial_rows)*100*100, 0)/100 AS retention_pct
        FROM (SELECT count(*) AS initial_rows, count(*) FILTER (Cancelled = 1) AS cancelled_rows,
                count(*) FILTER (Cancelled <> 0) AS not_flown_rows,
                count(*) FILTER (Cancelled = 0 AND Diverted <> 0) AS diverted_rows,
                count(*) FILTER (Cancelled = 0 AND Diverted = 0 AND TailNum IS NULL) AS no_tail_rows,
                count(*) FILTER (Cancelled = 0 AND Diverted = 0 AND TailNum IS NOT NULL
                  AND (ArrDelay IS NULL OR DepDelay IS NULL)) AS missing_field_rows,
                count(*) FILTER (Cancelled = 0 AND Diverted = 0 AND TailNum IS NOT NULL
                  AND ArrDelay > 600) AS invalid_value_rows,
                (SELECT count(*) FROM casc) AS cleaned_rows,
                (SELECT count(DISTINCT TailNum) FROM casc) AS aircraft,
                (SELECT min(FlightDate) FROM casc) AS first_date,
                (SELECT max(FlightDate) FROM casc) AS last_date
              FROM flights)""",
    "cln12_survivor_label": "SELECT 'NO' AS Cancelled, count(*) AS flights FROM ops",
    "prj01_03_airtime": """
        SELECT FlightId, expected AS ExpectedAirTime, dev AS AirTimeDeviation,
               dev_pct AS AirTimeDeviationPct FROM measured""",
    "prj04_route": """
        SELECT concat(Origin, '-', Dest) AS Route, count(*) AS flights FROM flights GROUP BY 1""",
    "prj05_turnaround_penalty": "SELECT FlightId, penalty AS TurnaroundInefficiency FROM rot",
    "prj06_temporal_features": """
        SELECT FlightId, CAST(CRSDepTime//100 AS INT) AS Hour,
               CAST(isodow(FlightDate)-1 AS INT) AS DayOfWeek, CAST(month(FlightDate) AS INT) AS Month,
               CASE WHEN isodow(FlightDate) IN (6,7) THEN 1 ELSE 0 END AS IsWeekend,
               CASE WHEN CRSDepTime//100 IN (6,7,8,16,17,18) THEN 1 ELSE 0 END AS IsRushHour,
               CASE WHEN CRSDepTime//100 BETWEEN 5 AND 8 THEN 1 ELSE 0 END AS IsEarlyMorning,
               CASE WHEN CRSDepTime//100 >= 21 OR CRSDepTime//100 <= 2 THEN 1 ELSE 0 END
                 AS IsLateNight
        FROM casc""",
    "prj07_flight_features": """
        SELECT FlightId, CAST(Distance AS DOUBLE) AS Distance,
               CAST(CRSElapsedTime AS DOUBLE) AS CRSElapsedTime,
               CASE WHEN Distance < 500 THEN 1 ELSE 0 END AS IsShortHaul,
               CASE WHEN Distance >= 500 AND Distance < 1500 THEN 1 ELSE 0 END AS IsMediumHaul,
               CASE WHEN Distance >= 1500 THEN 1 ELSE 0 END AS IsLongHaul
        FROM casc""",
    "prj08_09_incoming_and_buffer": """
        SELECT FlightId, HasIncomingDelay, TurnaroundMinutes, TightTurnaround, CriticalTurnaround,
               InsufficientBuffer FROM feat""",
    "prj10_rotation_flags": """
        SELECT FlightId, IsFirstFlight, IsEarlyRotation, IsLateRotation FROM feat""",
    "prj11_select_features": f"""
        SELECT FlightId, split, {", ".join(_PLAIN)}, {_r6(*_HIST)} FROM joined""",
    "prj12_fill_features": """
        SELECT FlightId, coalesce(e, me) AS CRSElapsedTime,
               round_even(coalesce(c, mc)*1000000, 0)/1000000 AS OriginCongestion
        FROM (SELECT FlightId, split, CASE WHEN Distance % 7 <> 0 THEN CRSElapsedTime END AS e,
                     CASE WHEN Hour <> 12 THEN OriginCongestion END AS c FROM joined),
             (SELECT median(CASE WHEN Distance % 7 <> 0 THEN CRSElapsedTime END) AS me,
                     median(CASE WHEN Hour <> 12 THEN OriginCongestion END) AS mc
              FROM joined WHERE split = 'train')""",
    "win01_prev_leg": "SELECT FlightId, PrevArrTime, PrevFlightDate, PrevFlightDelay FROM prev",
    "win01_prev_leg_split_runs": """
        SELECT FlightId, PrevArrTime, PrevFlightDate, PrevFlightDelay FROM prev""",
    "win02_turnaround": "SELECT FlightId, hours AS TurnaroundTime FROM rot",
    "win02_turnaround_minutes": """
        SELECT FlightId, coalesce(CASE
                 WHEN dayno = PrevFlightDate AND dep >= arr THEN (dep - arr)/60.0E0
                 WHEN dayno = PrevFlightDate + 1 AND (1440 - arr + dep)/60.0E0 < 48
                   THEN (1440 - arr + dep)/60.0E0 END, 999.0E0) AS TurnaroundTime
        FROM (SELECT *, CRSDepTime//100*60 + CRSDepTime%100 AS dep,
                     PrevArrTime//100*60 + PrevArrTime%100 AS arr FROM prev)""",
    "win03_propagation": """
        SELECT FlightId, PrevFlightDelay, passed AS DelayPropagated FROM rot""",
    "win04_next_leg": """
        SELECT FlightId, n_dep AS NextFlight_DepDelay, n_arr AS NextFlight_ArrDelay,
               n_date AS NextFlight_Date, n_clock AS NextFlight_CRSDepTime FROM nextleg""",
    "win05_sched_turnaround": "SELECT FlightId, gap AS TurnaroundTime FROM nextleg",
    "win06_07_cascade_label": "SELECT FlightId, y AS CausedCascade FROM labelled",
    "win08_incoming_delay": """
        SELECT FlightId, inc AS IncomingDelay, inc_dep AS IncomingDepDelay FROM feat""",
    "win09_position_in_rotation": "SELECT FlightId, place AS PositionInRotation FROM feat",
    "win10_time_index_split_minutes": "SELECT FlightId, idx AS TimeIndex FROM indexed",
    "win10_time_index": "SELECT FlightId, idx AS TimeIndex FROM indexed",
    "agg01_route_stats": "SELECT * FROM rstats",
    "agg02_on_time_rate_by_route": """
        SELECT Route, round_even(count(*) FILTER (ArrDelay <= 15)/(1.0E0*count(*))*1000, 0)/1000
          AS OnTimeRate FROM measured GROUP BY Route""",
    "agg02_on_time_rate_by_carrier": """
        SELECT UniqueCarrier,
               round_even(count(*) FILTER (ArrDelay <= 15)/(1.0E0*count(*))*1000, 0)/1000
          AS OnTimeRate FROM measured GROUP BY UniqueCarrier""",
    "agg03_taxi_p90_by_route": """
        SELECT Route, round_even(quantile_cont(TaxiOut, 0.9)*100, 0)/100 AS P90TaxiOut,
               round_even(quantile_cont(TaxiIn, 0.9)*100, 0)/100 AS P90TaxiIn
        FROM measured GROUP BY Route""",
    "agg04_cancel_rate_clean": """
        SELECT Route, 0.0E0 AS CancelRate FROM measured GROUP BY Route""",
    "agg04_cancel_rate_raw": """
        SELECT UniqueCarrier, round_even(avg(CAST(Cancelled AS DOUBLE))*10000, 0)/10000
          AS CancelRate FROM flights GROUP BY UniqueCarrier""",
    "agg05_min_group_size": """
        SELECT Route, count(FlightNum) AS FlightCount FROM measured GROUP BY Route
        HAVING count(FlightNum) >= (SELECT count(*)/(1.0E0*count(DISTINCT Route)) FROM measured)""",
    "agg06_carrier_stats": "SELECT * FROM cstats",
    "agg07_propagation_by_route": "SELECT * FROM rprop WHERE FlightsWithIncomingDelay >= 50",
    "agg08_propagation_by_carrier": "SELECT * FROM cprop",
    "agg09_propagation_summary": """
        SELECT round_even(avg(passed)*100*10, 0)/10 AS PropagationPct,
               count(*) FILTER (PrevFlightDelay > 15) AS FlightsWithIncomingDelay,
               CAST(sum(passed) AS BIGINT) AS PropagatedDelays, count(*) AS TotalFlights
        FROM rot""",
    "agg10_taxi_out_by_origin": "SELECT * EXCLUDE (TaxiOutInefficiency) FROM tout",
    "agg11_taxi_in_by_dest": "SELECT * EXCLUDE (TaxiInInefficiency) FROM tin",
    "agg12_airtime_by_route": "SELECT * FROM airt",
    "agg13_turnaround_by_origin": "SELECT * FROM turn",
    "agg14_bottleneck_summary": """
        SELECT CAST(sum(t_out) AS BIGINT) AS TaxiOutRoutes, CAST(sum(t_in) AS BIGINT) AS TaxiInRoutes,
               CAST(sum(air) AS BIGINT) AS AirTimeRoutes,
               round_even(avg(t_out)*100*10, 0)/10 AS TaxiOutPct,
               round_even(avg(t_in)*100*10, 0)/10 AS TaxiInPct,
               round_even(avg(air)*100*10, 0)/10 AS AirTimePct,
               round_even(avg(AvgTaxiOut)*10, 0)/10 AS MeanTaxiOut,
               round_even(avg(AvgTaxiIn)*10, 0)/10 AS MeanTaxiIn,
               round_even(avg(AvgAirTimeDeviationPct)*10, 0)/10 AS MeanAirTimeDeviationPct,
               count(*) FILTER (TotalBottlenecks >= 2) AS MultipleBottleneckRoutes
        FROM rflag""",
    "agg15_excess_ground_cost": """
        SELECT round_even(a*10, 0)/10 AS ExcessTaxiOut, round_even(b*10, 0)/10 AS ExcessTaxiIn,
               round_even((a+b)*10, 0)/10 AS ExcessGroundTime,
               round_even((a+b)*10000000.0E0*50.0E0/1e6*10, 0)/10 AS AnnualCostMillions
        FROM (SELECT avg(greatest(AvgTaxiOut - q, 0.0E0)) AS a FROM tout,
                (SELECT quantile_cont(AvgTaxiOut, 0.25) AS q FROM tout)),
             (SELECT avg(greatest(AvgTaxiIn - q, 0.0E0)) AS b FROM tin,
                (SELECT quantile_cont(AvgTaxiIn, 0.25) AS q FROM tin))""",
    "agg16_bottleneck_category_counts": """
        SELECT 'taxi_out_airports' AS Category, count(*) FILTER (AvgTaxiOut > 15) AS Count FROM tout
        UNION ALL SELECT 'taxi_in_airports', count(*) FILTER (AvgTaxiIn > 10) FROM tin
        UNION ALL SELECT 'air_time_routes', count(*) FILTER (HasAirTimeIssue = 1) FROM airt
        UNION ALL SELECT 'tight_turnaround_airports', count(*) FILTER (TightTurnaroundRate > 0.2)
        FROM turn""",
    "agg17_median_delay_by_route": """
        SELECT Route, median(ArrDelay) AS MedianArrDelay FROM measured GROUP BY Route
        ORDER BY 2 DESC, 1 LIMIT 20""",
    "agg18_median_delay_by_carrier": """
        SELECT UniqueCarrier, median(ArrDelay) AS MedianArrDelay FROM measured
        GROUP BY UniqueCarrier""",
    "agg19_quadrant_distribution": """
        SELECT Category, count(*) AS Routes,
               round_even(count(*)/(1.0E0*(SELECT count(*) FROM routes))*100*10, 0)/10 AS Pct
        FROM routes GROUP BY Category""",
    "agg20_label_distribution": """
        SELECT y AS CausedCascade, count(*) AS legs,
               round_even(count(*)/(1.0E0*(SELECT count(*) FROM labelled))*100*100, 0)/100 AS pct
        FROM labelled GROUP BY y""",
    "agg21_history_route": f"""
        SELECT Origin, Dest, RouteMedianDelay,
               {_r6("RouteAvgDelay", "RouteStdDelay", "RouteAvgDepDelay", "RouteRobustnessScore")}
        FROM hroute""",
    "agg22_history_origin": f"""
        SELECT Origin, {_r6("Origin_AvgDepDelay", "OriginCongestion")} FROM horigin""",
    "agg23_history_dest": f"""
        SELECT Dest, {_r6("Dest_AvgArrDelay", "DestCongestion")} FROM hdest""",
    "agg24_history_carrier": f"SELECT UniqueCarrier, {_r6('CarrierAvgDelay')} FROM hcarrier",
    "agg25_train_medians": "SELECT " + ", ".join(
        [f"CAST(median({f}) AS DOUBLE) AS {f}" for f in _PLAIN]
        + [f"round_even(median({f})*1000000, 0)/1000000 AS {f}" for f in _HIST]
    ) + " FROM joined WHERE split = 'train'",
    "agg26_class_weight": """
        SELECT count(*) FILTER (y=0) AS negatives, count(*) FILTER (y=1) AS positives,
               round_even(count(*) FILTER (y=0)/(1.0E0*count(*) FILTER (y=1))*1000000, 0)/1000000
                 AS weight
        FROM train""",
    "agg27_turnaround_counts": """
        SELECT count(*) FILTER (hours < 24) AS turnarounds_under_24h,
               count(*) FILTER (hours > 0 AND hours < 24) AS valid_turnarounds,
               count(*) FILTER (penalty > 0) AS tight_turnarounds
        FROM rot""",
    "agg28_bottleneck_by_type": """
        SELECT 'TaxiOut' AS Bottleneck, CAST(sum(t_out) AS BIGINT) AS Routes FROM rflag
        UNION ALL SELECT 'TaxiIn', CAST(sum(t_in) AS BIGINT) FROM rflag
        UNION ALL SELECT 'AirTime', CAST(sum(air) AS BIGINT) FROM rflag""",
    "agg29_split_profile": """
        SELECT split, min(FlightDate) AS first_date, max(FlightDate) AS last_date, count(*) AS legs,
               round_even(avg(y)*100*100, 0)/100 AS cascade_pct
        FROM legs GROUP BY split""",
    "scr01_efficiency_routes": f"""
        SELECT Route, EfficiencyScore, {_r6("OnTimeComponent", "ReliabilityComponent",
                                            "DelayComponent", "SmoothComponent")} FROM reff""",
    "scr01_efficiency_carriers": "SELECT UniqueCarrier, EfficiencyScore FROM cscore",
    "scr01_efficiency_raw_cancel_rate": """
        SELECT Route, rate AS CancelRate, round_even(greatest(0.0E0, least(100.0E0,
                 OnTimeRate*40 + (1-rate)*20
                 + (1 - greatest(0.0E0, least(60.0E0, AvgArrDelay))/60)*20
                 + (1 - greatest(0.0E0, least(60.0E0, StdArrDelay))/60)*20))*10, 0)/10
                 AS EfficiencyScore
        FROM rstats JOIN (SELECT Origin || '-' || Dest AS Route,
             round_even(avg(CAST(Cancelled AS DOUBLE))*10000, 0)/10000 AS rate
             FROM flights GROUP BY 1) USING (Route)""",
    "scr02_03_bottleneck_flags": """
        SELECT Route, TaxiOutBottleneck, TaxiInBottleneck, AirTimeBottleneck, TotalBottlenecks,
               PrimaryBottleneck FROM rflag""",
    "scr04_06_robustness_routes": """
        SELECT Route, RobustnessScore, DelayCV, RecoveryCapability FROM rrob""",
    "scr04_05_robustness_carriers": "SELECT UniqueCarrier, RobustnessScore, DelayCV FROM ctable",
    "scr07_taxi_out_inefficiency": "SELECT Origin, TaxiOutInefficiency FROM tout",
    "scr07_taxi_in_inefficiency": "SELECT Dest, TaxiInInefficiency FROM tin",
    "scr08_air_time_issue": "SELECT Route, HasAirTimeIssue FROM airt",
    "scr09_quadrants": "SELECT Route, EfficiencyScore, RobustnessScore, Category FROM routes",
    "scr10_tight_turnaround_rate": "SELECT Origin, TightTurnaroundRate FROM turn",
    "scr11_score_bands": """
        SELECT Route, CASE WHEN EfficiencyScore > 85 THEN 'EXCELLENT'
                           WHEN EfficiencyScore >= 70 THEN 'GOOD'
                           WHEN EfficiencyScore >= 55 THEN 'NEEDS_IMPROVEMENT'
                           WHEN EfficiencyScore < 55 THEN 'CRITICAL' END AS EfficiencyBand,
               CASE WHEN RobustnessScore > 60 THEN 'PREDICTABLE'
                    WHEN RobustnessScore >= 40 THEN 'MODERATE'
                    WHEN RobustnessScore < 40 THEN 'UNPREDICTABLE' END AS RobustnessBand
        FROM routes""",
    "jon01_carrier_name": """
        SELECT c.code AS UniqueCarrier, Description, FlightCount FROM (
          SELECT CASE WHEN FlightNum % 10 = 0 THEN '?' ELSE '' END || UniqueCarrier AS code,
                 count(FlightNum) AS FlightCount
          FROM measured GROUP BY 1) c
        LEFT JOIN carriers k ON k.Code = c.code""",
    "jon02_03_route_and_propagation": """
        SELECT Route, OnTimeRate, P90TaxiOut, CancelRate, PropagationRate, FlightsWithIncomingDelay,
               TotalFlights, ConditionalRate FROM rstats LEFT JOIN rprop USING (Route)""",
    "jon04_apply_history": f"""
        SELECT FlightId, {_r6(*_HIST, "RouteMedianDelay", "RouteAvgDepDelay", "CarrierAvgDelay")}
        FROM joined""",
    "jon05_lookup_history": f"""
        SELECT FlightId, Origin, Dest, {_r6(*_HIST)} FROM (
          SELECT FlightId, a.Origin, a.Dest,
                 CASE WHEN r.Origin IS NULL THEN 5.0E0 ELSE RouteAvgDelay END AS RouteAvgDelay,
                 CASE WHEN r.Origin IS NULL THEN 15.0E0 ELSE RouteStdDelay END AS RouteStdDelay,
                 CASE WHEN r.Origin IS NULL THEN 70.0E0 ELSE RouteRobustnessScore END
                   AS RouteRobustnessScore,
                 CASE WHEN h.Origin IS NULL THEN 8.0E0 ELSE Origin_AvgDepDelay END
                   AS Origin_AvgDepDelay,
                 CASE WHEN h.Origin IS NULL THEN 15.0E0 ELSE OriginCongestion END
                   AS OriginCongestion,
                 CASE WHEN g.Dest IS NULL THEN 6.0E0 ELSE Dest_AvgArrDelay END AS Dest_AvgArrDelay,
                 CASE WHEN g.Dest IS NULL THEN 12.0E0 ELSE DestCongestion END AS DestCongestion
          FROM (SELECT FlightId, Origin, CASE WHEN FlightNum % 5 = 0 THEN 'ZZZ' ELSE Dest END AS Dest
                FROM flights) a
          LEFT JOIN hroute r ON r.Origin = a.Origin AND r.Dest = a.Dest
          LEFT JOIN horigin h ON h.Origin = a.Origin LEFT JOIN hdest g ON g.Dest = a.Dest)""",
    "top01_best_routes": _top(f"{_ROUTE_COLS}, TotalBottlenecks, FlightCount", "routes",
                              "EfficiencyScore", 10),
    "top02_worst_routes": _top(
        f"{_ROUTE_COLS}, PrimaryBottleneck, TotalBottlenecks, FlightCount", "routes",
        "EfficiencyScore", 10, "ASC"),
    "top03_bottleneck_routes": _top(
        "Route, TotalBottlenecks, PrimaryBottleneck, EfficiencyScore, AvgTaxiOut, AvgTaxiIn, "
        "AvgAirTimeDeviationPct, FlightCount", "routes", "TotalBottlenecks", 15),
    "top04_best_carriers": _top(_CARRIER_COLS, "ctable", "EfficiencyScore", 10),
    "top05_worst_carriers": _top(_CARRIER_COLS, "ctable", "EfficiencyScore", 10, "ASC"),
    "top06_most_robust_routes": _top(
        f"Route, {_ROBUST_COLS}, RecoveryCapability, FlightCount", "routes", "RobustnessScore", 10),
    "top07_least_robust_routes": _top(
        f"Route, {_ROBUST_COLS}, RecoveryCapability, FlightCount", "routes", "RobustnessScore", 10,
        "ASC"),
    "top08_most_robust_carriers": _top(
        f"UniqueCarrier, Description, {_ROBUST_COLS}, FlightCount", "ctable", "RobustnessScore", 10),
    "top09_least_robust_carriers": _top(
        f"UniqueCarrier, Description, {_ROBUST_COLS}, FlightCount", "ctable", "RobustnessScore", 10,
        "ASC"),
    "top10_route_propagation": _top(
        "Route, PropagationRate, FlightsWithIncomingDelay, TotalFlights",
        "(SELECT * FROM rprop WHERE FlightsWithIncomingDelay >= 50)", "PropagationRate", 15),
    "top11_carrier_propagation": _top(
        "UniqueCarrier, Description, PropagationRate, FlightsWithIncomingDelay, TotalFlights",
        "cprop", "PropagationRate", 10),
    "top12_priority_routes": _top(
        "Route, EfficiencyScore, RobustnessScore, AvgArrDelay, StdArrDelay, PrimaryBottleneck, "
        "TotalBottlenecks, FlightCount", "(SELECT * FROM routes WHERE Category = 'LOW_EFF_LOW_ROB')",
        "EfficiencyScore", 20, "ASC"),
    "top13_taxi_out_airports": _top(
        "Origin, AvgTaxiOut, P90TaxiOut, P95TaxiOut, StdTaxiOut, TaxiOutInefficiency, AvgDepDelay, "
        "FlightCount", "tout", "TaxiOutInefficiency", 15),
    "top14_taxi_in_airports": _top(
        "Dest, AvgTaxiIn, P90TaxiIn, P95TaxiIn, StdTaxiIn, TaxiInInefficiency, AvgArrDelay, "
        "FlightCount", "tin", "TaxiInInefficiency", 15),
    "top15_air_time_routes": _top(
        "Route, AvgAirTimeDeviationPct, StdAirTimeDeviationPct, AvgAirTimeDeviation, Distance, "
        "AvgActualTime, AvgExpectedTime, FlightCount",
        "(SELECT * FROM airt WHERE HasAirTimeIssue = 1)", "AvgAirTimeDeviationPct", 15),
    "top16_turnaround_airports": _top(
        "Origin, AvgTurnaround, P10Turnaround, TightTurnaroundRate, AvgInefficiency, AvgDepDelay, "
        "FlightCount", "turn", "AvgInefficiency", 15),
    "top17_chart_taxi_out": _top("Origin, AvgTaxiOut", "tout", "TaxiOutInefficiency", 10),
    "top17_chart_taxi_in": _top("Dest, AvgTaxiIn", "tin", "TaxiInInefficiency", 10),
    "top17_chart_air_time": _top(
        "Route, AvgAirTimeDeviationPct", "(SELECT * FROM airt WHERE HasAirTimeIssue = 1)",
        "AvgAirTimeDeviationPct", 10),
    "top17_chart_carrier_efficiency": _top(
        "UniqueCarrier, Description, EfficiencyScore", "ctable", "EfficiencyScore", 10),
    "top17_chart_carrier_robustness": _top(
        "UniqueCarrier, Description, RobustnessScore", "ctable", "RobustnessScore", 10),
    "top17_chart_carrier_propagation": """
        SELECT UniqueCarrier, round_even(rate*100*1000000, 0)/1000000 AS PropagationRate
        FROM (SELECT UniqueCarrier, PropagationRate AS rate FROM cprop
              ORDER BY rate DESC NULLS LAST, UniqueCarrier LIMIT 10)""",
    "ml01_temporal_split": "SELECT FlightId, split FROM legs",
    "ml02_time_series_folds": """
        SELECT CAST(f.fold AS INT) AS ValFold, count(*) AS val_rows, min(f.idx) AS first_index,
               max(f.idx) AS last_index, min(f.idx) AS train_rows
        FROM folds f WHERE f.fold > 0 GROUP BY f.fold""",
    "ml03_cv_summary": """
        SELECT """ + ", ".join(
        f"round_even({fn}({m})*1000000, 0)/1000000 AS {p}_{m}"
        for p, fn in (("mean", "avg"), ("std", "stddev_samp")) for m in ("f1", "recall", "precision")
    ) + """
        FROM (SELECT 2.0E0*tp/(2*tp+fp+fn) AS f1, tp*1.0E0/(tp+fn) AS recall,
                     tp*1.0E0/(tp+fp) AS precision
              FROM (SELECT fold, count(*) FILTER (y=1 AND pred=1) AS tp,
                           count(*) FILTER (y=0 AND pred=1) AS fp,
                           count(*) FILTER (y=1 AND pred=0) AS fn
                    FROM folds WHERE fold > 0 GROUP BY fold))""",
    "ml06_confusion_matrix": "SELECT * FROM cm",
    "ml07_binary_metrics": """
        SELECT round_even(2.0E0*tp/(2*tp+fp+fn)*1000000, 0)/1000000 AS f1,
               round_even(tp*1.0E0/(tp+fn)*1000000, 0)/1000000 AS recall,
               round_even(tp*1.0E0/(tp+fp)*1000000, 0)/1000000 AS precision,
               round_even((tp+tn)*1.0E0/(tp+tn+fp+fn)*1000000, 0)/1000000 AS accuracy
        FROM cm""",
    "ml08_roc_auc": """
        SELECT round_even((sum(r) FILTER (y=1) - count(*) FILTER (y=1)
                 *(count(*) FILTER (y=1)+1)/2.0E0)
               /(1.0E0*count(*) FILTER (y=1)*count(*) FILTER (y=0))*1000000, 0)/1000000 AS auc
        FROM (SELECT y, rank() OVER (ORDER BY score)
                     + (count(*) OVER (PARTITION BY score) - 1)/2.0E0 AS r FROM test)""",
    "ml09_classification_report": f"""
        SELECT class, {_r6("precision", "recall", "f1")}, support FROM (
          SELECT 'No Cascade' AS class, tn*1.0E0/(tn+fn) AS precision, tn*1.0E0/(tn+fp) AS recall,
                 2.0E0*tn/(2*tn+fp+fn) AS f1, tn+fp AS support FROM cm
          UNION ALL SELECT 'Cascade', tp*1.0E0/(tp+fp), tp*1.0E0/(tp+fn), 2.0E0*tp/(2*tp+fp+fn),
                 tp+fn FROM cm
          UNION ALL SELECT 'accuracy', NULL, NULL, (tp+tn)*1.0E0/(tp+tn+fp+fn), tp+tn+fp+fn FROM cm
          UNION ALL SELECT 'macro avg', (tn*1.0E0/(tn+fn) + tp*1.0E0/(tp+fp))/2,
                 (tn*1.0E0/(tn+fp) + tp*1.0E0/(tp+fn))/2,
                 (2.0E0*tn/(2*tn+fp+fn) + 2.0E0*tp/(2*tp+fp+fn))/2, tp+tn+fp+fn FROM cm
          UNION ALL SELECT 'weighted avg',
                 (tn*1.0E0/(tn+fn)*(tn+fp) + tp*1.0E0/(tp+fp)*(tp+fn))/(tp+tn+fp+fn),
                 (tn*1.0E0/(tn+fp)*(tn+fp) + tp*1.0E0/(tp+fn)*(tp+fn))/(tp+tn+fp+fn),
                 (2.0E0*tn/(2*tn+fp+fn)*(tn+fp) + 2.0E0*tp/(2*tp+fp+fn)*(tp+fn))/(tp+tn+fp+fn),
                 tp+tn+fp+fn FROM cm)""",
    "ml10_roc_curve": f"""
        SELECT threshold, {_r6("fpr", "tpr")} FROM (
          SELECT threshold, fps*1.0E0/n AS fpr, tps*1.0E0/p AS tpr FROM ranked
          UNION ALL SELECT NULL, 0.0E0, 0.0E0)""",
    "ml11_pr_curve": f"""
        SELECT threshold, {_r6("precision", "recall", "base_rate")} FROM (
          SELECT threshold, tps*1.0E0/(tps+fps) AS precision, tps*1.0E0/p AS recall,
                 p*1.0E0/(p+n) AS base_rate FROM ranked
          UNION ALL SELECT NULL, 1.0E0, 0.0E0, avg(y) FROM test)""",
    "ml13_risk_tiers": "SELECT FlightId, RiskTier FROM tiers",
    "ml13_tier_thresholds": """
        SELECT round_even(quantile_cont(score, 0.95)*1000000, 0)/1000000 AS critical,
               round_even(quantile_cont(score, 0.9)*1000000, 0)/1000000 AS high,
               round_even(quantile_cont(score, 0.8)*1000000, 0)/1000000 AS elevated FROM test""",
    "ml14_tier_distribution": """
        SELECT RiskTier, count(FlightId) AS legs,
               round_even(count(FlightId)/(1.0E0*(SELECT count(*) FROM test))*100*10, 0)/10 AS pct
        FROM (VALUES ('CRITICAL'), ('HIGH'), ('ELEVATED'), ('NORMAL')) v(RiskTier)
        LEFT JOIN tiers USING (RiskTier) GROUP BY RiskTier""",
    "ml15_tier_rates": """
        SELECT RiskTier, round_even(avg(y)*100*10, 0)/10 AS cascade_pct,
               CAST(sum(y) AS BIGINT) AS cascades, count(*) AS legs FROM tiers GROUP BY RiskTier""",
    "ml16_score_histogram": f"""
        SELECT label, bin, legs, {_r6("low", "density")} FROM (
          SELECT e.y AS label, CAST(b AS INT) AS bin, lo + b*w AS low, count(t.y) AS legs,
                 count(t.y)/(total*w) AS density
          FROM (SELECT y, min(score) AS lo, (max(score)-min(score))/50 AS w, count(*) AS total
                FROM test GROUP BY y) e CROSS JOIN range(50) r(b)
          LEFT JOIN test t ON t.y = e.y AND least(floor((t.score-lo)/w), 49) = b
          GROUP BY e.y, b, lo, w, total)""",
    "ml17_leakage_checks": """
        SELECT 'temporal_order' AS "check", 'days from last train to first test date' AS measure,
               CAST(datediff('day', max(FlightDate) FILTER (split='train'),
                             min(FlightDate) FILTER (split='test')) AS DOUBLE) AS value,
               'PASS' AS status FROM legs
        UNION ALL
        SELECT 'feature_drift', 'RouteAvgDelay mean difference in percent',
               round_even(drift*10, 0)/10, CASE WHEN drift < 2 THEN 'WARNING' ELSE 'PASS' END
        FROM (SELECT abs(avg(RouteAvgDelay) FILTER (split='train')
                         - avg(RouteAvgDelay) FILTER (split='test'))
                     / avg(RouteAvgDelay) FILTER (split='train') * 100 AS drift FROM joined)
        UNION ALL SELECT 'statistics_source', 'route rows from training data',
               CAST(count(*) AS DOUBLE), 'PASS' FROM hroute
        UNION ALL SELECT 'statistics_source', 'origin rows from training data',
               CAST(count(*) AS DOUBLE), 'PASS' FROM horigin
        UNION ALL SELECT 'statistics_source', 'dest rows from training data',
               CAST(count(*) AS DOUBLE), 'PASS' FROM hdest
        UNION ALL SELECT 'statistics_source', 'carrier rows from training data',
               CAST(count(*) AS DOUBLE), 'PASS' FROM hcarrier
        UNION ALL SELECT 'recall_sanity', 'test recall',
               round_even(tp*1.0E0/(tp+fn)*1000000, 0)/1000000,
               CASE WHEN tp*1.0E0/(tp+fn) > 0.95 THEN 'WARNING' ELSE 'PASS' END FROM cm""",
    "src01_flight_csv": "SELECT * FROM flights WHERE FlightNum % 10 <> 0",
    "src01_rejected_lines": """
        SELECT FlightId, concat_ws(',', FlightId, FlightNum, Year) AS line, 'not 21 fields' AS reason
        FROM flights WHERE FlightNum % 10 = 0""",
    "src02_row_limit": """
        SELECT least(1000, count(*)) AS flights FROM flights WHERE FlightNum % 10 <> 0""",
    "src03_carrier_csv": "SELECT Code, Description FROM carriers",
    "cln11_cleaning_report_rejects": """
        SELECT (SELECT count(*) FROM flights WHERE FlightNum % 10 <> 0) AS initial_rows,
               (SELECT count(*) FROM casc WHERE FlightNum % 10 <> 0) AS cleaned_rows,
               (SELECT count(*) FROM flights WHERE FlightNum % 10 = 0) AS rejected_lines""",
    "snk01_result_tables": """
        SELECT UniqueCarrier, Description, EfficiencyScore, RobustnessScore, FlightCount
        FROM ctable""",
    "snk01_result_tables_csv": """
        SELECT Origin, AvgTaxiOut, P90TaxiOut, FlightCount, TaxiOutInefficiency FROM tout""",
    "snk02_history_tables": """
        SELECT Origin, round_even(avg(DepDelay)*1000000, 0)/1000000 AS Origin_AvgDepDelay,
               round_even(avg(TaxiOut)*1000000, 0)/1000000 AS OriginCongestion,
               count(*) AS SourceLegs FROM train GROUP BY Origin""",
    "snk03_feature_list": " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS position, '{f}' AS feature" for i, f in enumerate(FEATURES)),
    "snk04_importance_csv": " UNION ALL ".join(
        f"SELECT '{f}' AS Feature, true AS InRange" for f in FEATURES),
    "snk05_saved_model": "SELECT FlightId, true AS Same FROM legs WHERE split = 'test'",
    "src04_csv_requests": f"SELECT FlightId AS RequestId, {_NUMBERS} FROM flights",
    "src05_json_feature_requests": f"SELECT FlightId AS RequestId, {_NUMBERS} FROM flights",
    "src06_json_raw_requests": """
        SELECT FlightId AS RequestId, lower(Origin) AS origin,
               CASE WHEN FlightNum % 5 = 0 THEN 'zzz' ELSE Dest END AS dest,
               CASE WHEN FlightNum % 7 <> 0 THEN CAST(Distance AS VARCHAR) END AS distance,
               CAST(ArrDelay AS VARCHAR) AS incoming_delay
        FROM flights""",
    "src07_bad_requests": """
        SELECT _error, count(*) AS requests FROM (
          SELECT CASE WHEN FlightNum % 5 = 0 OR FlightNum % 4 = 1
                      THEN 'JSON must have features or a raw flight'
                      WHEN (FlightNum // 8) % 3 = 0
                      THEN 'bad ' || (['hour', 'day_of_week', 'month', 'distance',
                        'crs_elapsed_time', 'incoming_delay', 'incoming_dep_delay',
                        'turnaround_time', 'position_in_rotation'])[
                        ((FlightNum // 8) // 3) % 9 + 1] END AS _error
          FROM flights)
        WHERE _error IS NOT NULL GROUP BY _error""",
    "srv01_features_from_raw": _REQUEST_FEATURES,
    "srv04_feature_stream": _AS_DOUBLES,
    "srv05_incoming_delay_stream": """
        SELECT FlightId, CAST(coalesce(lag(ArrDelay) OVER w, 0) AS DOUBLE) AS IncomingDelay,
               CAST(coalesce(lag(DepDelay) OVER w, 0) AS DOUBLE) AS IncomingDepDelay, false AS Late
        FROM casc WINDOW w AS (PARTITION BY TailNum ORDER BY FlightDate, CRSDepTime, FlightId)
        UNION ALL
        SELECT FlightId, NULL, NULL, true FROM casc WHERE dayofyear(FlightDate) <= 30""",
    "snk06_responses": """
        SELECT FlightId AS RequestId, CASE WHEN FlightNum % 5 <> 0 THEN '2.0' END AS ModelVersion,
               CASE WHEN FlightNum % 5 <> 0 THEN true END AS ScoreInRange,
               CASE WHEN FlightNum % 5 <> 0 THEN true END AS PredictionFits,
               CASE WHEN FlightNum % 5 <> 0 THEN true END AS TierFits,
               CASE WHEN FlightNum % 5 <> 0 THEN true END AS ActionFits,
               CASE WHEN FlightNum % 5 = 0 THEN 'JSON must have features or a raw flight' END AS Error
        FROM flights""",
    "ml03_cross_validation_rules": """
        SELECT fold AS ValFold, CAST(min(idx) AS BIGINT) AS train_rows, count(*) AS val_rows,
               true AS Bounded
        FROM folds WHERE fold > 0 GROUP BY fold""",
    "ml18_metadata_rules": f"""
        SELECT '2.0' AS model_version, strftime(min(FlightDate) FILTER (split='train'), '%Y-%m-%d')
                 AS train_start,
               strftime(max(FlightDate) FILTER (split='train'), '%Y-%m-%d') AS train_end,
               strftime(min(FlightDate) FILTER (split='test'), '%Y-%m-%d') AS test_start,
               strftime(max(FlightDate) FILTER (split='test'), '%Y-%m-%d') AS test_end,
               'PASS' AS temporal_split, 'training_only' AS statistics_source,
               '{",".join(FEATURES)}' AS features, true AS tiers_ordered
        FROM legs""",
    "ml05_score_rules": """
        SELECT FlightId, true AS ScoreInRange, true AS ClassFits FROM legs WHERE split = 'test'""",
    "ml04_scored_legs": """
        SELECT count(*) FILTER (y = 0) AS negatives, count(*) FILTER (y = 1) AS positives
        FROM legs WHERE split = 'test'""",
    "ml12_importance_rules": "SELECT Feature, true AS InRange, 1.0E0 AS Total FROM ("
                             + " UNION ALL ".join(f"SELECT '{f}' AS Feature" for f in FEATURES) + ")",
    "srv02_fixed_tiers": """
        SELECT FlightId, CASE WHEN score >= 0.5 THEN 'CRITICAL' WHEN score >= 0.3 THEN 'HIGH'
                              WHEN score >= 0.15 THEN 'ELEVATED' ELSE 'NORMAL' END AS RiskTier,
               CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS CascadePrediction,
               CASE WHEN score >= 0.5 THEN 'IMMEDIATE: Swap aircraft or adjust schedule'
                    WHEN score >= 0.3 THEN 'ALERT: Consider aircraft swap'
                    WHEN score >= 0.15 THEN 'MONITOR: Pre-position ground crew'
                    ELSE 'ROUTINE: Standard operations' END AS RecommendedAction
        FROM test""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(body) for name, body in _ORACLE.items()}
