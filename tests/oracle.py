"""Side-by-side run of registered queries and their oracle SQL.

``python tests/oracle.py [sf] [key ...]`` prints one line per key.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(float(value) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    mine, names = rows_of(df.columns, df.collect())
    if sql is None:
        return len(mine) > 0, f"{len(mine)} rows, no oracle"
    result = con.execute(sql)
    wanted, other = rows_of([d[0] for d in result.description], result.fetchall())
    if names != other:
        return False, f"columns {names} / {other}"
    if mine == wanted:
        return True, f"{len(mine)} rows"
    a, b = set(mine), set(wanted)
    return False, f"{len(mine)}/{len(wanted)} rows; only spark {sorted(a - b)[:3]}; only oracle {sorted(b - a)[:3]}"


def main(argv: list[str]) -> int:
    import importlib

    from planmark.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    entry = importlib.import_module("__spark_entry__")
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, oracle = entry.queries(), entry.oracle_sql()
    keys = argv[1:] or list(queries)
    con, failed = connect(folder), 0
    for key in keys:
        start = time.time()
        try:
            ok, note = compare(spark, con, folder, queries[key], oracle.get(key))
        except Exception as error:  # report and go on with the next key
            ok, note = False, f"{type(error).__name__}: {str(error)[:400]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - start:.1f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
