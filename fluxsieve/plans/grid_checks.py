"""Registered queries for gridded-output operators (B) on gridded fixtures derived from the
driver tables:

* ``modes``: one row per (point = ``l_partkey``, ``kthetarhos`` = line number / 2,
  ``numsols`` = ``l_suppkey % 2``) with ``gam_GB``, ``ome_GB``;
* ``ions``: one row per (point = ``l_orderkey``, ``nions`` = line number % 2) with
  ``pfi_GB, normni, Zi``; ``points``: one row per order with ``pfe_GB, Zeff``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from ..operators.slices import axis_positions
from ..sources.bridge import read_table
from .checks import bridge, register, with_bridge

MODES_SQL = ("modes AS (SELECT l_partkey AS point, CAST(l_linenumber AS DOUBLE) * 5e-1 AS kthetarhos, "
             "CAST(l_suppkey % 2 AS INTEGER) AS numsols, "
             "CASE WHEN c % 3 = 0 THEN 0e0 ELSE CAST(c % 1000 AS DOUBLE) / 1e2 END AS gam_GB, "
             "CAST((c * 7) % 2000 AS DOUBLE) / 1e2 - 1e1 AS ome_GB "
             "FROM (SELECT *, CAST(ROUND(l_extendedprice * 1e2, 0) AS BIGINT) AS c FROM lineitem))")
IONS_SQL = ("ions AS (SELECT l_orderkey AS point, CAST(l_linenumber % 2 AS INTEGER) AS nions, "
            "CAST((c * 3) % 200 AS DOUBLE) / 1e2 - 1e0 AS pfi_GB, 5e-1 + CAST(l_linenumber % 3 AS DOUBLE) / 1e1 AS normni, "
            "CASE WHEN l_linenumber % 2 = 0 THEN 1e0 ELSE 6e0 END AS Zi "
            "FROM (SELECT *, CAST(ROUND(l_extendedprice * 1e2, 0) AS BIGINT) AS c FROM lineitem))")
POINTS_SQL = ("points AS (SELECT o_orderkey AS point, CASE WHEN o_orderkey % 13 = 0 THEN 0e0 ELSE "
              "CAST(CAST(ROUND(o_totalprice * 1e2, 0) AS BIGINT) % 500 AS DOUBLE) / 1e2 - 2.5e0 END AS pfe_GB, "
              "1e0 + CAST(o_orderkey % 20 AS DOUBLE) / 1e1 AS Zeff FROM orders)")


def modes(spark, sf):
    li = read_table(spark, sf, "lineitem")
    c = F.round(F.col("l_extendedprice") * 1e2, 0).cast("bigint")
    return li.select(F.col("l_partkey").alias("point"), (F.col("l_linenumber").cast("double") * 0.5).alias("kthetarhos"),
                     (F.col("l_suppkey") % 2).cast("int").alias("numsols"),
                     F.when(c % 3 == 0, F.lit(0.0)).otherwise((c % 1000).cast("double") / 1e2).alias("gam_GB"),
                     (((c * 7) % 2000).cast("double") / 1e2 - 10.0).alias("ome_GB"))


def ions(spark, sf):
    li = read_table(spark, sf, "lineitem")
    c = F.round(F.col("l_extendedprice") * 1e2, 0).cast("bigint")
    return li.select(F.col("l_orderkey").alias("point"), (F.col("l_linenumber") % 2).cast("int").alias("nions"),
                     (((c * 3) % 200).cast("double") / 1e2 - 1.0).alias("pfi_GB"),
                     (0.5 + (F.col("l_linenumber") % 3).cast("double") / 1e1).alias("normni"),
                     F.when(F.col("l_linenumber") % 2 == 0, F.lit(1.0)).otherwise(F.lit(6.0)).alias("Zi"))


def points(spark, sf):
    o = read_table(spark, sf, "orders")
    c = F.round(F.col("o_totalprice") * 1e2, 0).cast("bigint")
    return o.select(F.col("o_orderkey").alias("point"),
                    F.when(F.col("o_orderkey") % 13 == 0, F.lit(0.0)).otherwise((c % 500).cast("double") / 1e2 - 2.5)
                    .alias("pfe_GB"),
                    (1.0 + (F.col("o_orderkey") % 20).cast("double") / 1e1).alias("Zeff"))


def _grid(body, *ctes):
    return "WITH " + ",\n".join(ctes) + "\n" + body


@register("grid_stability_flags", _grid(
    "SELECT point, gam_leq_GB, gam_great_GB, COALESCE(gam_leq_GB <> 0, FALSE) AND COALESCE(pos, FALSE) AS TEM, "
    "COALESCE(gam_leq_GB <> 0, FALSE) AND COALESCE(neg, FALSE) AS ITG, COALESCE(gam_great_GB <> 0, FALSE) AS ETG FROM ("
    "SELECT point, max(CASE WHEN kthetarhos <= 2e0 THEN gam_GB END) AS gam_leq_GB, "
    "max(CASE WHEN kthetarhos > 2e0 THEN gam_GB END) AS gam_great_GB, "
    "bool_or(kthetarhos <= 2e0 AND ome_GB > 0) AS pos, bool_or(kthetarhos <= 2e0 AND ome_GB < 0) AS neg "
    "FROM modes GROUP BY point)", MODES_SQL))
def grid_stability_flags(spark, sf):
    """B-09, B-11 / B-12, B-13: growth rates and instability flags per scan point."""
    return grid.stability_flags(modes(spark, sf), ["point"])


@register("grid_growth_gen4", _grid(
    "SELECT point, max(CASE WHEN kthetarhos <= 2e0 THEN gam_GB END) AS gam_leq_GB, "
    "max(CASE WHEN kthetarhos > 2e0 AND kthetarhos <> (SELECT min(kthetarhos) FROM modes WHERE kthetarhos > 2e0) "
    "THEN gam_GB END) AS gam_great_GB FROM modes GROUP BY point", MODES_SQL))
def grid_growth_gen4(spark, sf):
    """B-09 with the gen4 indexing (first wavenumber above the bound left out)."""
    return grid.growth_rates(modes(spark, sf), ["point"], skip_first_above=True)


@register("grid_ambipolarity", _grid(
    "SELECT p.point, p.pfe_GB, CASE WHEN p.pfe_GB = 0 THEN 1e0 ELSE s.s / NULLIF(p.pfe_GB, 0) END AS absambi, "
    "CASE WHEN p.pfe_GB = 0 THEN 1e0 ELSE abs(s.s / NULLIF(p.pfe_GB, 0)) END AS absambi_abs "
    "FROM points p LEFT JOIN (SELECT point, sum(pfi_GB * normni * Zi) AS s FROM ions GROUP BY point) s "
    "ON p.point = s.point", IONS_SQL, POINTS_SQL))
def grid_ambipolarity(spark, sf):
    """B-15 and B-16 (absolute) per scan point."""
    a = grid.ambipolarity(ions(spark, sf), points(spark, sf), ["point"])
    b = grid.ambipolarity(ions(spark, sf), points(spark, sf), ["point"], absolute=True)
    return a.select("point", "pfe_GB", "absambi").join(b.select("point", F.col("absambi").alias("absambi_abs")), "point")


@register("grid_ion_densities", _grid(
    "SELECT point, (1e0 - 6e0 * ((Zeff - 1e0) / (36e0 - 6e0))) / 1e0 AS n0, (Zeff - 1e0) / (36e0 - 6e0) AS n1 "
    "FROM points", POINTS_SQL))
def grid_ion_densities(spark, sf):
    """B-14 with Z0 = 1, Z1 = 6."""
    p = points(spark, sf)
    n0, n1 = grid.ion_densities(F.lit(1.0), F.lit(6.0), F.col("Zeff"))
    return p.select("point", n0.alias("n0"), n1.alias("n1"))


@register("grid_axis_index", with_bridge(
    "SELECT b.dimx AS id, (pa.p * (SELECT count(DISTINCT An) FROM bridge) + pb.p) * (SELECT count(DISTINCT x) FROM bridge) "
    "+ pc.p AS dimx FROM bridge b "
    "JOIN (SELECT Ate, dense_rank() OVER (ORDER BY Ate) - 1 AS p FROM (SELECT DISTINCT Ate FROM bridge)) pa ON b.Ate = pa.Ate "
    "JOIN (SELECT An, dense_rank() OVER (ORDER BY An) - 1 AS p FROM (SELECT DISTINCT An FROM bridge)) pb ON b.An = pb.An "
    "JOIN (SELECT x, dense_rank() OVER (ORDER BY x) - 1 AS p FROM (SELECT DISTINCT x FROM bridge)) pc ON b.x = pc.x"))
def grid_axis_index(spark, sf):
    """B-03: row-major cell index over the (Ate, An, x) axes."""
    b = bridge(spark, sf).select(F.col("dimx").alias("id"), "Ate", "An", "x")
    return grid.axis_index(b, ["Ate", "An", "x"]).select("id", "dimx")


@register("grid_unfold", _grid(
    "SELECT m.point, k.kthetarhos, max(m.gam_GB) AS gam_GB, max(m.ome_GB) AS ome_GB FROM "
    "(SELECT DISTINCT point FROM modes) p CROSS JOIN (SELECT DISTINCT kthetarhos FROM modes) k LEFT JOIN modes m ON m.point = p.point AND m.kthetarhos = k.kthetarhos "
    "GROUP BY p.point, k.kthetarhos, m.point", MODES_SQL).replace(
    "SELECT m.point,", "SELECT p.point,"))
def grid_unfold(spark, sf):
    """B-02: per-point arrays over the wavenumber axis (built by Spark) unfolded to rows."""
    m = modes(spark, sf).groupBy("point", "kthetarhos").agg(F.max("gam_GB").alias("g"), F.max("ome_GB").alias("o"))
    axis, n = axis_positions(m, "kthetarhos")
    arr = m.join(axis, "kthetarhos").groupBy("point").agg(
        F.map_from_entries(F.collect_list(F.struct("__pos", F.struct("g", "o")))).alias("mp"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    wide = arr.select("point", F.transform(places, lambda k: F.element_at(F.col("mp"), k)["g"]).alias("gam_GB"),
                      F.transform(places, lambda k: F.element_at(F.col("mp"), k)["o"]).alias("ome_GB"))
    return grid.unfold_arrays(wide, ["point"], "kthetarhos", (axis, n), ["gam_GB", "ome_GB"])


@register("grid_nearest", with_bridge(
    "SELECT b.dimx, b.efi_GB FROM bridge b WHERE b.dimx IN (SELECT (SELECT dimx FROM bridge "
    "ORDER BY abs(dimx - t), dimx LIMIT 1) FROM (SELECT mn + (mx - mn) * i // 13 AS t FROM "
    "(SELECT min(dimx) AS mn, max(dimx) AS mx FROM bridge), range(14) r(i)))"))
def grid_nearest(spark, sf):
    """B-24: points nearest to 14 evenly spaced ids."""
    b = bridge(spark, sf).select("dimx", "efi_GB")
    r = b.agg(F.min("dimx").alias("mn"), F.max("dimx").alias("mx")).first()
    targets = [r["mn"] + (r["mx"] - r["mn"]) * i // 13 for i in range(14)]
    return grid.nearest_ids(b, targets)


@register("grid_equality_slice", with_bridge(
    "SELECT dimx, Ati, q, x FROM bridge WHERE Ate = 5e0 AND An = 2e0"))
def grid_equality_slice(spark, sf):
    """B-25."""
    return grid.equality_slice(bridge(spark, sf).select("dimx", "Ati", "q", "x", "Ate", "An"), {"Ate": 5.0, "An": 2.0})


@register("grid_constants", with_bridge(
    " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS VARCHAR) AS value FROM (SELECT *, 1e0 + 0 * q AS Zeff, "
                       f"floor(x) AS whole FROM bridge) HAVING min({c}) = max({c})" for c in ["Ati", "q", "x", "Zeff", "whole"])))
def grid_constants(spark, sf):
    """B-06: the columns that never vary moved to a constants table."""
    whole = bridge(spark, sf).select("dimx", "Ati", "q", "x", (1.0 + 0 * F.col("q")).alias("Zeff"), F.floor("x").cast("double").alias("whole"))
    _rest, consts = grid.metadatize(whole, ["Ati", "q", "x", "Zeff", "whole"])
    return consts


@register("grid_prepare", _grid(
    "SELECT COALESCE(f.point, a.point) AS point, f.gam_leq_GB, f.TEM, f.ITG, a.absambi FROM "
    "(SELECT point, gam_leq_GB, COALESCE(gam_leq_GB <> 0, FALSE) AND COALESCE(pos, FALSE) AS TEM, "
    "COALESCE(gam_leq_GB <> 0, FALSE) AND COALESCE(neg, FALSE) AS ITG FROM (SELECT point, "
    "max(CASE WHEN kthetarhos <= 2e0 THEN gam_GB END) AS gam_leq_GB, bool_or(kthetarhos <= 2e0 AND ome_GB > 0) AS pos, "
    "bool_or(kthetarhos <= 2e0 AND ome_GB < 0) AS neg FROM modes GROUP BY point)) f FULL JOIN "
    "(SELECT p.point, CASE WHEN p.pfe_GB = 0 THEN 1e0 ELSE s.s / NULLIF(p.pfe_GB, 0) END AS absambi "
    "FROM points p LEFT JOIN (SELECT point, sum(pfi_GB * normni * Zi) AS s FROM ions GROUP BY point) s "
    "ON p.point = s.point) a ON f.point = a.point", MODES_SQL, IONS_SQL, POINTS_SQL))
def grid_prepare(spark, sf):
    """B-28 core: flags + ambipolarity merged on the scan point (B-01 full outer merge)."""
    f = grid.stability_flags(modes(spark, sf), ["point"]).select("point", "gam_leq_GB", "TEM", "ITG")
    a = grid.ambipolarity(ions(spark, sf), points(spark, sf), ["point"]).select("point", "absambi")
    return grid.merge_groups(f, a, ["point"], dedupe=False)
