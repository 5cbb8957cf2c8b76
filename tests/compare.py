"""Compare a query with its SQL in DuckDB, rows in any order."""

import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return round(float(v), 6)
    return v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return Counter(tuple(_cell(v) for v in r) for r in df.itertuples(index=False, name=None))


def differences(query, sql, spark, folder, con):
    a, b = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    return list((x - y).elements())[:3], list((y - x).elements())[:3]
