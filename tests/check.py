"""Compare registered queries with their SQL in DuckDB: ``python tests/check.py [folder] [name part ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (bool, int, str)):
        return value
    if type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(spark_df, con, sql):
    names, got = rows_of(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    cur = con.execute(sql)
    others, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != others:
        return [f"columns {names} != {others}"], len(got)
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"] + [f"  {a}\n  {b}" for a, b in list(zip(got, want))[:3]], len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return [f"{len(bad)} of {len(got)} rows differ"] * bool(bad) + [f"  {a}\n  {b}" for a, b in bad[:3]], len(got)


def main() -> int:
    from tests.conftest import make_session
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = make_session(), connect(folder)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.monotonic()
        try:
            if name in sql:
                problems, n = differences(fn(spark, folder), con, sql[name])
            else:
                problems, n = [], len(fn(spark, folder).collect())
        except Exception as exc:
            problems, n = [f"{type(exc).__name__}: {str(exc)[:900]}"], -1
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok  " if name in sql else "rows")
        print(f"{mark} {name:42s} {n:8d} rows {time.monotonic() - started:6.2f} s", flush=True)
        for line in problems:
            print("    " + line, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
