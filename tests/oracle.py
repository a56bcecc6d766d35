"""Local replica of the correctness gate: run a Spark DataFrame and a DuckDB query
on the same parquet tables and compare row count, column names and values."""

from __future__ import annotations

import math

import duckdb

from fluxsieve.sources.bridge import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits=6):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        return round(v, digits) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item(), digits)
        except Exception:
            pass
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark_df, con, sql: str, digits: int = 6):
    """Return (ok, message)."""
    s_cols = sorted(spark_df.columns)
    s_rows = [tuple(_norm(r[c], digits) for c in s_cols) for r in spark_df.collect()]
    res = con.execute(sql)
    d_names = [d[0] for d in res.description]
    d_cols = sorted(d_names)
    idx = [d_names.index(c) for c in d_cols]
    d_rows = [tuple(_norm(r[i], digits) for i in idx) for r in res.fetchall()]
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"row counts differ: spark={len(s_rows)} duck={len(d_rows)}"
    s_sorted = sorted(s_rows, key=_key)
    d_sorted = sorted(d_rows, key=_key)
    for a, b in zip(s_sorted, d_sorted):
        if a != b:
            return False, f"first difference: spark={a} duck={b}"
    return True, f"{len(s_rows)} rows match"
