"""Runs registered queries beside their DuckDB counterparts: rows, column names and sorted values must agree.

usage: python tools/check.py [sf folder] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from figtrail.plans import catalog, fixtures  # noqa: E402
from figtrail.session import local_session  # noqa: E402


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, query, oracle, folder):
    t0 = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t0
    if oracle is None:
        return "rows-only", f"{len(got)} rows", took
    t1 = time.time()
    cur = con.execute(oracle)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    duck = time.time() - t1
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", f"{sorted(df.columns)} != {sorted(cols)}", took
    if got != want:
        a, b = (sorted(set(x) - set(y), key=repr)[:3] for x, y in ((got, want), (want, got)))
        return "DIFFER", f"{len(got)} vs {len(want)} rows\n   spark {a}\n   duck  {b}\n   columns {sorted(cols)}", took
    return "ok", f"{len(got)} rows, duck {duck:.1f}s", took


def connect(folder):
    con = duckdb.connect()
    for t in fixtures.DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    queries, oracles = catalog.load()
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in sorted(queries):
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            status, note, took = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            status, note, took = "ERROR", f"{type(e).__name__}: {str(e)[:900]}", 0
        bad += status not in ("ok", "rows-only")
        print(f"{status:9s} {name} {took:.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
