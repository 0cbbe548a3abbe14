"""Runs named queries beside their SQL and compares the rows.

    python -m tests.oracle_check [folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (bytearray, bytes)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder, build, sql):
    """(problem or None, rows, spark seconds, sql seconds)."""
    start = time.time()
    df = build(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return None, len(got), took, 0.0
    start = time.time()
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    sql_took = time.time() - start
    left = rows_by_name(df.columns, got)
    right = rows_by_name(want_columns, want)
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}", len(got), took, sql_took
    if left[1] != right[1]:
        in_left, in_right = set(left[1]), set(right[1])
        only_left = [r for r in left[1] if r not in in_right][:3]
        only_right = [r for r in right[1] if r not in in_left][:3]
        return (
            f"{len(left[1])} vs {len(right[1])} rows\n  columns {left[0]}"
            f"\n  spark {only_left}\n  sql   {only_right}",
            len(got),
            took,
            sql_took,
        )
    return None, len(got), took, sql_took


def main() -> None:
    import __spark_entry__ as entry
    from driftline.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    spark = local_session(os.environ.get("CPUS", "8"))
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            problem, n, took, sql_took = compare(spark, con, folder, build, oracles.get(name))
        except Exception as error:  # report every query, then fail
            problem, n, took, sql_took = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0, 0
        mark = "ok " if problem is None else "BAD"
        if problem is None and n == 0:
            mark = "ok0"
        if problem is None and name not in oracles:
            mark = "row"
        bad += problem is not None
        print(f"{mark} {name:32s} rows={n:7d} spark={took:6.2f}s sql={sql_took:6.2f}s", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{bad} bad of {len(queries)}")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
