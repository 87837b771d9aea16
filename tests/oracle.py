"""Compares registered queries with their SQL on DuckDB.

Run as a script: ``python tests/oracle.py [folder] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "<null>"
    if isinstance(v, float) and math.isnan(v):
        return "<nan>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.10g}" if float(v) != 0 else "0"
    return str(v)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(con, sql: str, df) -> str | None:
    """What differs, or None."""
    cur = con.execute(sql)
    want_names, want = _table([d[0] for d in cur.description], cur.fetchall())
    got_names, got = _table(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return f"columns {got_names} instead of {want_names}"
    if len(want) != len(got):
        return f"{len(got)} rows instead of {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} instead of {bad[0][1]} of {got_names}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    from pyspark.sql import SparkSession

    from catalog import QUERIES, SQL

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    for name in wanted:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = difference(con, SQL[name], df) if name in SQL else (None if df.count() else "no rows")
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")
