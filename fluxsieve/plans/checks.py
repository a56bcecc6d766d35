"""Registered queries: each operator (or small group of operators) as a Spark job over the
driver tables, paired with an independent DuckDB SQL oracle where SQL can express it.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, sql or None)``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import BRIDGE_SQL, bridge_view

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def with_bridge(body: str, extra: str = "") -> str:
    """Oracle SQL on the bridge view: ``WITH bridge AS (...) <extra CTEs> <body>``."""
    ctes = f"bridge AS ({BRIDGE_SQL})"
    if extra:
        ctes += ",\n" + extra
    return f"WITH {ctes}\n{body}"


# --------------------------------------------------------------- SQL fragments (oracle side)

def sql_ieee_div(a: str, b: str) -> str:
    a, b = f"({a})", f"({b})"
    return (f"(CASE WHEN {b} <> 0 THEN {a} / {b} WHEN {b} = 0 AND {a} > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN {b} = 0 AND {a} < 0 THEN CAST('-inf' AS DOUBLE) END)")


def sql_tf(expr: str) -> str:
    return f"COALESCE({expr}, FALSE)"


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge_view(spark, sf_dir)

