"""Registered queries for slice operators (D-05, G-14, G-15, I-19) on the bridge view
(slice key ``scan_id``, sliced dimension ``Ati``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slices
from .checks import bridge, register, with_bridge

MODE_COLS = {"ITG": ["efiITG_GB", "efeITG_GB", "pfeITG_GB"], "TEM": ["efeTEM_GB", "efiTEM_GB", "pfeTEM_GB"],
             "ETG": ["efeETG_GB"]}
SHORT = {"ITG": "i", "TEM": "t", "ETG": "e"}


def _breakdown_ctes(patience=6):
    w = ", ".join(f"CASE WHEN prim AND {slices.BREAKDOWN_TARGET[m]} <> 0 THEN {slices.BREAKDOWN_TARGET[m]} END "
                  f"AS w{SHORT[m]}" for m in MODE_COLS)
    sick = ", ".join(f"(w{k} IS NOT NULL AND pos < gmax AND count(w{k}) OVER f = least({patience}, gmax - pos) "
                     f"AND max(w{k}) OVER f < w{k}) AS sick{k}" for k in SHORT.values())
    cut = ", ".join(f"min(CASE WHEN sick{k} THEN pos END) OVER (PARTITION BY scan_id) AS cut{k}" for k in SHORT.values())
    outs = ", ".join(f"CASE WHEN COALESCE(prim AND pos > cut{SHORT[m]}, FALSE) THEN NULL ELSE {c} END AS {c}"
                     for m, cols in MODE_COLS.items() for c in cols)
    ctes = ",\n".join([
        "ax AS (SELECT Ati, dense_rank() OVER (ORDER BY Ati) - 1 AS pos FROM (SELECT DISTINCT Ati FROM bridge))",
        "g AS (SELECT count(*) - 1 AS gmax FROM ax)",
        "p AS (SELECT b.*, ax.pos, row_number() OVER (PARTITION BY scan_id, b.Ati ORDER BY dimx) = 1 AS prim "
        "FROM bridge b JOIN ax ON b.Ati = ax.Ati)",
        f"w AS (SELECT p.*, {w} FROM p)",
        f"s AS (SELECT w.*, g.gmax, {sick} FROM w, g WINDOW f AS (PARTITION BY scan_id ORDER BY pos "
        f"RANGE BETWEEN 1 FOLLOWING AND {patience} FOLLOWING))",
        f"c AS (SELECT s.*, {cut} FROM s)",
    ])
    return ctes, outs


def _breakdown_sql(patience=6):
    ctes, outs = _breakdown_ctes(patience)
    return with_bridge(f"SELECT dimx, {outs} FROM c", ctes)


@register("breakdown_mask", _breakdown_sql())
def breakdown_mask(spark, sf):
    """D-05 for ITG, TEM and ETG in one window pass over slices of ``Ati``."""
    b = bridge(spark, sf)
    cols = [c for m in MODE_COLS.values() for c in m]
    out = slices.breakdown_mask(b.select("dimx", "scan_id", "Ati", *cols), ["scan_id"], "Ati")
    return out.select("dimx", *cols)


@register("breakdown_drop_counts", with_bridge(
    "SELECT CAST(count_if(COALESCE(prim AND pos > cuti, FALSE)) AS BIGINT) AS drop_itg, "
    "CAST(count_if(COALESCE(prim AND pos > cutt, FALSE)) AS BIGINT) AS drop_tem, "
    "CAST(count_if(COALESCE(prim AND pos > cute, FALSE)) AS BIGINT) AS drop_etg FROM c",
    _breakdown_ctes()[0]))
def breakdown_drop_counts(spark, sf):
    """D-05 yield: points removed per mode (patience 6)."""
    b = bridge(spark, sf)
    d = slices.breakdown_drop_flags(b.select("dimx", "scan_id", "Ati", "efiITG_GB", "efeTEM_GB", "efeETG_GB"),
                                    ["scan_id"], "Ati")
    return d.agg(F.count_if("__drop_ITG").cast("bigint").alias("drop_itg"),
                 F.count_if("__drop_TEM").cast("bigint").alias("drop_tem"),
                 F.count_if("__drop_ETG").cast("bigint").alias("drop_etg"))


@register("collect_slices", with_bridge(
    "SELECT scan_id, CAST(count(*) AS INTEGER) AS n_points, min(Ati) AS first_x, max(Ati) AS last_x, "
    "round(sum(efiITG_GB), 6) AS sum_v FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, Ati ORDER BY dimx) "
    "AS rn FROM bridge) WHERE rn = 1 GROUP BY scan_id"))
def collect_slices(spark, sf):
    """G-14: per-slice sorted point arrays, summarised with array functions."""
    s = slices.collect_slices(bridge(spark, sf), ["scan_id"], "Ati", "efiITG_GB")
    p = F.col("points")
    return s.select("scan_id", F.size(p).alias("n_points"), p[0]["x"].alias("first_x"),
                    F.element_at(p, -1)["x"].alias("last_x"),
                    F.round(F.aggregate(p, F.lit(0.0), lambda acc, e: acc + e["v"]), 6).alias("sum_v"))


def _wide_sql():
    cols = ", ".join(f"max(CASE WHEN Ati = {float(v)!r} THEN efiITG_GB END) AS \"{float(v)!r}\"" for v in range(1, 51))
    return with_bridge(f"SELECT scan_id, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, Ati "
                       "ORDER BY dimx) AS rn FROM bridge) WHERE rn = 1 GROUP BY scan_id")


@register("wide_slices", _wide_sql())
def wide_slices(spark, sf):
    """G-15: one column per grid value of ``Ati``."""
    return slices.wide_slices(bridge(spark, sf), ["scan_id"], "Ati", "efiITG_GB")


@register("relative_to_reference", with_bridge(
    "SELECT dimx, efiITG_GB / NULLIF(first_value(CASE WHEN Ati = 25e0 THEN efiITG_GB END IGNORE NULLS) OVER "
    "(PARTITION BY scan_id ORDER BY Ati, dimx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS relative "
    "FROM bridge"))
def relative_to_reference(spark, sf):
    """I-19: value relative to the value at ``Ati = 25`` of the same slice, back-filled."""
    b = bridge(spark, sf)
    r = slices.relative_to_reference(b, ["scan_id"], ["Ati", "dimx"], "Ati", "efiITG_GB", 25.0)
    return r.select("dimx", "relative")
