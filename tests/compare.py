"""Rows of a Spark query against rows of SQL in DuckDB, ignoring order."""

from __future__ import annotations

import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(df) -> Counter:
    return Counter(tuple(norm(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


def oracle_rows(con, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(norm(r[i]) for i in order) for r in got.fetchall())
