"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from codeloom.plans.corpus import BASE_TABLES

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    t2 = time.time()
    problems = []
    if sorted(cols) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(cols)}")
    else:
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if a != b:
            sa, sb = set(a), set(b)
            problems.append(f"{len(a)} rows vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only duck {sorted(sb - sa)[:3]}")
    return problems, len(got), t1 - t0, t2 - t1


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from codeloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                  "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{ROOT}/sf{sf}"
    con = duck(folder)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            if name in oracles:
                problems, n, ts, td = compare(spark, con, name, fn, oracles[name], folder)
            else:
                t0 = time.time()
                n, problems, td = len(fn(spark, folder).collect()), [], 0.0
                ts = time.time() - t0
        except Exception as e:  # noqa: BLE001
            problems, n, ts, td = [f"{type(e).__name__}: {str(e)[:1500]}"], 0, 0, 0
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} rows={n:7d} spark={ts:6.2f}s duck={td:6.2f}s"
              + ("" if name in oracles else "  (rows only)") + "".join("\n     " + p for p in problems), flush=True)
    print("failed:", bad)
