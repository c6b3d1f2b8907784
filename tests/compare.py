"""Run registered queries next to their SQL on DuckDB and compare the rows.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is not None, round(v, 6) if isinstance(v, float) else v) for v in row)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def _same(a, b, exact: bool) -> bool:
    if isinstance(a, float) and isinstance(b, float) and not exact:
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def difference(df, con, sql: str, exact: bool = True) -> str | None:
    """None if rows are the same, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    want = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"rows {len(got)} / {len(want)}"
    if not want:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want)
           if not all(_same(x, y, exact) for x, y in zip(g, w))]
    if bad:
        cols = sorted(names)
        g, w = bad[0]
        cells = [(c, x, y) for c, x, y in zip(cols, g, w) if not _same(x, y, exact)]
        return f"{len(bad)} of {len(want)} rows, first: {cells[:4]}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from flightops.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), oracle_sql()
    failed = 0
    for name, function in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            if name in sql:
                problem = difference(df, con, sql[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:300]}"
        failed += problem is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time()-start:6.2f}s {name}"
              f"{'' if problem is None else '  ' + problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
