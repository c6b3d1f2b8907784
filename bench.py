"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Every query runs to the end into a sink that keeps all its columns. The derived
flights table is written once before the clock starts and its time is given apart.
"""

from __future__ import annotations

import json
import os
import time

from flightops.plans.catalog import queries
from flightops.session import build_session
from flightops.sources.tables import table_flights

HEADLINE = (
    "cln11_cleaning_report_ops",
    "agg01_route_stats",
    "agg06_carrier_stats",
    "agg10_taxi_out_by_origin",
    "agg13_turnaround_by_origin",
    "win02_turnaround",
    "win06_07_cascade_label",
    "agg07_propagation_by_route",
    "top01_best_routes",
    "scr09_quadrants",
    "agg29_split_profile",
    "agg21_history_route",
    "prj11_select_features",
    "ml02_time_series_folds",
    "ml08_roc_auc",
    "ml13_risk_tiers",
    "srv01_features_from_raw",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    rows = table_flights(spark, folder).count()
    load = time.time() - start
    seconds = {}
    registered = queries()
    for name in HEADLINE:
        start = time.time()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "rows": rows, "load_sec": round(load, 3), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
