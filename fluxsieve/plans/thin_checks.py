"""Registered queries for thinning (H-01..H-09) and instance weights (H-10..H-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import thin, weights
from .checks import bridge, register, with_bridge

THIN_DIMS = ["Ate", "Ati", "efeITG_GB"]
# fixed values: the clustering settings shipped with the reference's test data
SETTINGS = dict(initial_eps=1.0, reduction_threshold=50, min_eps=0.3, min_reduction=20, min_samples=2,
                min_cluster_size=6, zeta=0.0, tau=1000.0)


@register("rescale_centred", with_bridge(
    "SELECT dimx, round(Ate - (SELECT CAST(sum(CAST(Ate AS DECIMAL(38,2))) AS DOUBLE) / count(Ate) FROM bridge), 9) AS Ate, "
    "round(Ati - (SELECT CAST(sum(CAST(Ati AS DECIMAL(38,2))) AS DOUBLE) / count(Ati) FROM bridge), 9) AS Ati, "
    "round(efeITG_GB - (SELECT CAST(sum(CAST(efeITG_GB AS DECIMAL(38,2))) AS DOUBLE) / count(efeITG_GB) FROM bridge), 9) AS efeITG_GB FROM bridge"))
def rescale_centred(spark, sf):
    """H-01: mean-centred features (one aggregate, then a projection)."""
    r = thin.rescale(bridge(spark, sf).select("dimx", *THIN_DIMS), THIN_DIMS, decimals=2)
    return r.select("dimx", *[F.round(F.col(d), 9).alias(d) for d in THIN_DIMS])


@register("k_per_slice", with_bridge(
    "SELECT scan_id, CAST(count(*) AS BIGINT) AS npts, "
    "CAST(greatest(1, floor(count(*) / 5e0 * (1e0 - 5e-1) + 5e-1 * (count(*) / 5e0 * exp(-1e0 * (count(*) / 4e0)) "
    "+ (1e0 - exp(-1e0 * (count(*) / 4e0)))))) AS INTEGER) AS k FROM bridge GROUP BY scan_id"))
def k_per_slice(spark, sf):
    """H-05 on per-slice counts (density = points / 4, rfmin 5, tau 1, zeta 0.5)."""
    g = bridge(spark, sf).groupBy("scan_id").agg(F.count(F.lit(1)).alias("npts"))
    return g.select("scan_id", F.col("npts").cast("bigint").alias("npts"),
                    thin.k_expression(F.col("npts") / 4.0, F.col("npts"), 5, 1.0, 0.5).alias("k"))


# columns: (Ate, Ati) taken three apart, so that clusters at every radius up to 1 are runs of close z within a column;
# z is off the grid of hundredths, so that no distance is a tie
COLUMNS = """p AS (SELECT dimx, Ate, Ati, efeITG_GB * 101e-2 + CAST(dimx % 9973 AS DOUBLE) / 1e7 AS z FROM bridge)"""
RUNS = """SELECT *, sum(gap) OVER (PARTITION BY {by}Ate, Ati ORDER BY z, dimx) AS run FROM (SELECT *, CASE WHEN z - lag(z) OVER (PARTITION BY {by}Ate, Ati ORDER BY z, dimx) <= {eps} THEN 0 ELSE 1 END AS gap FROM {rows})"""


def columns_apart(spark, sf):
    z = F.col("efeITG_GB") * 1.01 + (F.col("dimx") % 9973).cast("double") / 1e7
    return bridge(spark, sf).select("dimx", (F.col("Ate") * 3.0).alias("Ate"), (F.col("Ati") * 3.0).alias("Ati"), z.alias("z"))


@register("dbscan_labels", with_bridge(
    "SELECT dimx, size, min(dimx) OVER (PARTITION BY Ate, Ati, run) AS least, CASE WHEN size = 1 THEN 'toss' WHEN size > 9 THEN 'next' WHEN size > 3 THEN 'reduce' ELSE 'keep' END AS cls "
    "FROM (SELECT *, count(*) OVER (PARTITION BY Ate, Ati, run) AS size FROM (" + RUNS.format(by="", eps="55e-2", rows="p") + "))", COLUMNS))
def dbscan_labels(spark, sf):
    """H-02 + H-03: every point's cluster (named by its least id), its size and its class."""
    lab = thin.dbscan(columns_apart(spark, sf), ["Ate", "Ati", "z"], 0.55, 2)
    cls = thin.classify_clusters(lab.withColumn("own", F.when(F.col("label") == thin.NOISE, F.col("dimx"))), 3, 8)
    least = cls.groupBy("label", "own").agg(F.min("dimx").alias("least"))
    named = least.select(F.col("label").alias("name"), F.col("own").alias("single"), "least")      # each lone point meets its own row only
    same = cls.join(named, (F.col("label") == F.col("name")) & F.col("own").eqNullSafe(F.col("single")))
    return same.select("dimx", F.when(F.col("own").isNotNull(), 1).otherwise(F.col("size")).cast("bigint").alias("size"), "least", "cls")


@register("local_density", with_bridge(
    "SELECT least, max(nb) / (405e-3 * 405e-3 * 405e-3) AS density, CAST(count(*) AS BIGINT) AS npts FROM (SELECT *, min(dimx) OVER (PARTITION BY Ate, Ati, run) AS least, "
    "count(*) OVER (PARTITION BY Ate, Ati, run ORDER BY z RANGE BETWEEN 405e-3 PRECEDING AND 405e-3 FOLLOWING) - 1 AS nb FROM ("
    + RUNS.format(by="", eps="55e-2", rows="p") + ")) GROUP BY least", COLUMNS))
def local_density(spark, sf):
    """H-04: the densest neighbourhood of every run of close values, counted within the run."""
    pts = columns_apart(spark, sf)
    lab = thin.dbscan(pts, ["Ate", "Ati", "z"], 0.55, 1)
    named = lab.join(lab.groupBy("label").agg(F.min("dimx").alias("least")), "label").drop("label").join(pts, "dimx")
    out = thin.local_density(named, ["Ate", "Ati", "z"], 0.405, cluster="least")
    return out.select("least", "density", F.col("npts").cast("bigint").alias("npts"))


# the levels of thinning_columns: the first pass at 1, then from 0.995 down by 0.05, the first below 0.3 being the last
_PASSES = [1.0, *thin.pass_radii(thin.ThinSettings(dims=[], initial_eps=0.995))[1:]]


@register("thinning_columns", with_bridge(
    "SELECT dimx FROM way WHERE cls = 'keep' UNION ALL SELECT arg_min(dimx, {'d': (z - m) * (z - m), 'i': dimx}) FROM (SELECT *, avg(z) OVER (PARTITION BY t, Ate, Ati, run) AS m "
    "FROM way WHERE cls = 'reduce') GROUP BY t, Ate, Ati, run",
    COLUMNS + ",\nlevel AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {e!r}::DOUBLE)" for t, e in enumerate(_PASSES)) + ") v(t, eps)),\n"
    "sized AS (SELECT *, count(*) OVER (PARTITION BY t, Ate, Ati, run) AS size FROM (" + RUNS.format(by="t, ", eps="eps", rows="p, level") + ")),\n"
    "leaves AS (SELECT dimx, coalesce(min(t) FILTER (size <= 51), " + str(len(_PASSES) - 1) + ") AS t FROM sized GROUP BY dimx),\n"
    "way AS (SELECT s.*, CASE WHEN size = 1 AND t = 0 THEN 'toss' WHEN size > 6 THEN 'reduce' ELSE 'keep' END AS cls FROM sized s JOIN leaves USING (dimx, t))"))
def thinning_columns(spark, sf):
    """H-07: kept ids of the whole thinning loop (one representative a cluster) where SQL can follow it."""
    s = thin.ThinSettings(dims=["Ate", "Ati", "z"], **{**SETTINGS, "initial_eps": 0.995, "min_reduction": 10 ** 9})
    return thin.two_step_thinning(columns_apart(spark, sf), s).select("dimx")


@register("dbscan_noise", with_bridge(
    "SELECT p.dimx, n.dimx IS NULL AS noise FROM p LEFT JOIN (SELECT DISTINCT a.dimx FROM near a JOIN p b ON a.i = b.Ate AND a.j = b.Ati "
    "AND a.k = floor(b.z) AND a.dimx <> b.dimx WHERE (a.Ate - b.Ate) * (a.Ate - b.Ate) + (a.Ati - b.Ati) * (a.Ati - b.Ati) "
    "+ (a.z - b.z) * (a.z - b.z) <= 25e-2) n ON n.dimx = p.dimx",
    "p AS (SELECT dimx, Ate, Ati, efeITG_GB AS z FROM bridge),\n"
    "near AS (SELECT p.*, Ate AS i, Ati AS j, floor(z) + o AS k FROM p, (VALUES (-1), (0), (1)) t(o))"))
def dbscan_noise(spark, sf):
    """H-02: points without another one within half a unit (with two samples to a cluster, just these are noise)."""
    b = bridge(spark, sf).select("dimx", *THIN_DIMS)
    return thin.dbscan(b, THIN_DIMS, 0.5, 2).select("dimx", (F.col("label") == thin.NOISE).alias("noise"))


@register("dbscan_cluster_sizes", with_bridge(
    "SELECT size, count(*) AS clusters FROM (SELECT Ate, Ati, run, count(*) AS size FROM (SELECT *, sum(gap) OVER (PARTITION BY Ate, Ati ORDER BY z, dimx) AS run "
    "FROM (SELECT *, CASE WHEN (z - lag(z) OVER (PARTITION BY Ate, Ati ORDER BY z, dimx)) * (z - lag(z) OVER (PARTITION BY Ate, Ati ORDER BY z, dimx)) <= 25e-2 "
    "THEN 0 ELSE 1 END AS gap FROM p)) GROUP BY ALL) WHERE size > 1 GROUP BY size", "p AS (SELECT dimx, Ate, Ati, efeITG_GB AS z FROM bridge)"))
def dbscan_cluster_sizes(spark, sf):
    """H-02 / H-03: how many clusters there are of each size.  Ate and Ati are whole numbers, so at half a unit a
    cluster is a run of close efeITG_GB values of one (Ate, Ati), which SQL can find too."""
    b = bridge(spark, sf).select("dimx", *THIN_DIMS)
    sizes = thin.dbscan(b, THIN_DIMS, 0.5, 2).filter(F.col("label") != thin.NOISE).groupBy("label").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"))


@register("two_step_thinning")
def two_step_thinning(spark, sf):
    """H-07: the thinning job with the settings shipped with the test data (k of several, so rows-only; ``thinning_columns``
    has an oracle)."""
    b = bridge(spark, sf).select("dimx", *THIN_DIMS, "efiITG_GB")
    return thin.two_step_thinning(b, thin.ThinSettings(dims=THIN_DIMS, **SETTINGS))


@register("max_resolvable_density", with_bridge(
    "SELECT round(50e0 / power(3e-1, 3), 6) AS \"limit\", count(*) AS cubes, count_if(n > 50) AS denser, round(max(n) / power(3e-1, 3), 6) AS densest "
    "FROM (SELECT count(*) AS n FROM bridge GROUP BY floor(Ate / 3e-1), floor(Ati / 3e-1), floor(efeITG_GB / 3e-1))"))
def max_resolvable_density(spark, sf):
    """H-09: how the data's densest cubes compare with the density that the settings can resolve."""
    out = thin.density_against_limit(bridge(spark, sf), THIN_DIMS, SETTINGS["reduction_threshold"], SETTINGS["min_eps"])
    return out.select(F.round("limit", 6).alias("limit"), F.col("cubes").cast("bigint").alias("cubes"), F.col("denser").cast("bigint").alias("denser"),
                      F.round("densest", 6).alias("densest"))


WSQL = ("CAST(coalesce(9e0 * exp(-(({x} - least(greatest({t}, -2e0), 16e0)) * ({x} - least(greatest({t}, -2e0), "
        "16e0))) / (2e0 * 7e0 * 7e0)) + 1e0, 1e0) AS FLOAT)")


@register("instance_weights", with_bridge(
    "SELECT dimx, " + WSQL.format(x="Ati", t="ti") + " AS ITGweights, "
    + WSQL.format(x="Ate", t="tt") + " AS TEMweights FROM (SELECT dimx, Ati, Ate, "
    "min(CASE WHEN efiITG_GB > 0 THEN Ati END) OVER (PARTITION BY scan_id) AS ti, "
    "min(CASE WHEN efeTEM_GB > 0 THEN Ate END) OVER (PARTITION BY An, q, x) AS tt FROM bridge)"))
def instance_weights(spark, sf):
    """H-11..H-13: per-point weights around the slice thresholds for ITG (slices over Ati) and
    TEM (slices over Ate)."""
    return weights.weights_job(bridge(spark, sf), {"ITG": ["scan_id"], "TEM": ["An", "q", "x"]})


@register("expand_thresholds", with_bridge(
    "SELECT b.dimx, t.thresh FROM bridge b LEFT JOIN (SELECT scan_id, min(CASE WHEN efiITG_GB > 0 THEN Ati END) "
    "AS thresh FROM bridge GROUP BY scan_id HAVING thresh IS NOT NULL) t ON b.scan_id = t.scan_id"))
def expand_thresholds(spark, sf):
    """H-10 / H-13 in table form: thresholds per slice expanded to the wanted points."""
    b = bridge(spark, sf)
    t = weights.thresholds(b, ["scan_id"], "Ati", "efiITG_GB")
    return weights.expand_thresholds(b.select("dimx", "scan_id"), t, ["scan_id"]).select("dimx", "thresh")
