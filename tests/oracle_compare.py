"""Compare a Spark DataFrame with a DuckDB query on the same parquet tables.

Mirrors the driver's check: same column names (order ignored), same row count,
and the same multiset of rows.  Floats are compared exactly and, separately,
after rounding to 9 significant digits, so a report says which one failed.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

from marketlens.sources.tables import BASE_TABLES


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, approx: bool):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if v == 0:
            return 0.0
        if approx:
            return float(f"{v:.9g}")
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(cols, rows, order, approx):
    idx = [cols.index(c) for c in order]
    return Counter(tuple(_norm(r[i], approx) for i in idx) for r in rows)


def compare(spark_df, sql: str, con) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "duck_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not out["columns_match"]:
        out["only_spark"] = sorted(set(s_cols) - set(d_cols))
        out["only_duck"] = sorted(set(d_cols) - set(s_cols))
        out["ok"] = False
        return out
    order = sorted(s_cols)
    for approx in (False, True):
        a, b = _rows(s_cols, s_rows, order, approx), _rows(d_cols, d_rows, order, approx)
        key = "approx_match" if approx else "exact_match"
        out[key] = a == b
        if a != b and approx:
            diff_a = list((a - b).elements())[:3]
            diff_b = list((b - a).elements())[:3]
            out["sample_only_spark"] = diff_a
            out["sample_only_duck"] = diff_b
            out["columns"] = order
    out["ok"] = out["columns_match"] and out["spark_rows"] == out["duck_rows"] and out["approx_match"]
    return out
