"""Run queries against their oracle SQL: python -m checks.compare [sf] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import checks.text_queries  # noqa: F401  registers its queries
from checks.oracle import ORACLES
from checks.queries import QUERIES

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = (tuple(_plain(r[i]) for i in order) for r in rows)
    return sorted(plain, key=lambda row: [(x is not None, x or "") for x in row])


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty when the query and its oracle agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(ORACLES[name])
    cols = [d[0] for d in got.description]
    theirs = rows_of(cols, got.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} / {sorted(cols)}"
    kinds = {d[0]: str(d[1]) for d in got.description}
    for f, k in df.dtypes:
        want = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}.get(k, "TIMESTAMP")
        if kinds[f].upper() not in (want, {"INTEGER": "NUMBER", "BIGINT": "NUMBER"}.get(want, want), "STRING", "DATETIME"):
            return f"type of {f}: {k} / {kinds[f]}"
    if mine == theirs:
        return "" if mine else "no rows"
    a, b = set(mine), set(theirs)
    return f"{len(mine)} / {len(theirs)} rows; only mine {list(a - b)[:3]}; only oracle {list(b - a)[:3]}"


def main() -> None:
    from railflow.session import local_session

    hot_rows = os.environ.get("HOT_ROWS")  # a low bound makes every key hot
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, sf_dir = local_session(8), f"{ROOT}/{sf}"
    if hot_rows:
        spark.conf.set("railflow.skew.minRows", hot_rows)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            diff = compare(spark, con, sf_dir, name) if name in ORACLES else f"no oracle, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        print(f"{name:22s} {time.time() - t0:6.2f}s {'ok' if not diff else diff}", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
