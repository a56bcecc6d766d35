"""Registered queries for training aggregates (J) on the bridge view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score as S
from ..operators import train as T
from .checks import bridge, register, with_bridge
from .score_checks import NET_A, SQL_A

STD_COLS = ["Ati", "Ate", "An", "q", "x", "efiITG_GB"]


def _std_sql(kind):
    parts = []
    for c in STD_COLS:
        if kind == "minmax":
            fac = f"(2e0 / (max({c}) - min({c})))"
            parts.append(f"SELECT '{c}' AS name, round({fac}, 9) AS factor, round(-1e0 - min({c}) * {fac}, 9) AS bias "
                         "FROM bridge")
        else:
            fac = f"(1e0 / stddev_samp({c}))"
            parts.append(f"SELECT '{c}' AS name, round({fac}, 9) AS factor, round(0e0 - avg({c}) * {fac}, 9) AS bias "
                         "FROM bridge WHERE COALESCE(efiITG_GB <> 0, FALSE) OR COALESCE(efeITG_GB <> 0, FALSE)")
    return with_bridge(" UNION ALL ".join(parts))


def _rounded(t):
    return t.select("name", F.round("factor", 9).alias("factor"), F.round("bias", 9).alias("bias"))


@register("standardization_minmax", _std_sql("minmax"))
def standardization_minmax(spark, sf):
    """J-01 ``minmax_-1_1``."""
    return _rounded(T.standardization(bridge(spark, sf), STD_COLS, "minmax_-1_1"))


@register("standardization_normsm_nonzero", _std_sql("normsm"))
def standardization_normsm_nonzero(spark, sf):
    """J-01 ``normsm_1_0`` on rows with any non-zero target (J-02)."""
    return _rounded(T.standardization(bridge(spark, sf), STD_COLS, "normsm_1_0",
                                      nonzero_targets=["efiITG_GB", "efeITG_GB"]))


@register("scale_roundtrip", with_bridge(
    "SELECT dimx, round((Ati - (SELECT min(Ati) FROM bridge)) * (2e0 / ((SELECT max(Ati) FROM bridge) - "
    "(SELECT min(Ati) FROM bridge))) - 1e0, 6) AS Ati, round(efiITG_GB, 6) AS efiITG_GB FROM bridge"))
def scale_roundtrip(spark, sf):
    """J-03: scale features, scale and descale a target (identity), one projection each."""
    b = bridge(spark, sf).select("dimx", "Ati", "efiITG_GB")
    consts = T.scaling_dict(T.standardization(b, ["Ati", "efiITG_GB"], "minmax_-1_1"))
    scaled = T.scale_columns(b, consts)
    back = T.scale_columns(scaled, {"efiITG_GB": consts["efiITG_GB"]}, inverse=True)
    return back.select("dimx", F.round("Ati", 6).alias("Ati"), F.round("efiITG_GB", 6).alias("efiITG_GB"))


@register("goodness_metrics", with_bridge(
    f"SELECT round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mabse, "
    "round(sum(CASE WHEN efiITG_GB > 0 THEN d * d ELSE 0e0 END) / count_if(efiITG_GB > 0), 6) AS mse_unstable, "
    "round(sqrt(avg(d * d)), 6) AS rms FROM "
    f"(SELECT ({SQL_A['efiITG_GB']}) - efiITG_GB AS d, efiITG_GB FROM bridge)"))
def goodness_metrics(spark, sf):
    """J-04: MSE, mean absolute error, MSE on unstable points and RMS of a scored network."""
    j = S.score(bridge(spark, sf).withColumn("truth", F.col("efiITG_GB")), {"a": NET_A}, keep=("dimx", "truth"))
    mse, mabse = T.goodness(F.col("efiITG_GB"), F.col("truth"))
    mse_u, _ = T.goodness(F.col("efiITG_GB"), F.col("truth"), only_unstable=True)
    g = j.agg(mse.alias("mse"), mabse.alias("mabse"), mse_u.alias("mse_unstable"))
    return g.select(F.round("mse", 6).alias("mse"), F.round("mabse", 6).alias("mabse"),
                    F.round("mse_unstable", 6).alias("mse_unstable"), F.round(F.sqrt("mse"), 6).alias("rms"))


@register("stable_positive_cost", with_bridge(
    "SELECT round(avg(5e0 * (p - 1e-1) * CASE WHEN efiITG_GB <= 0 AND p > 1e-1 THEN 1e0 ELSE 0e0 END), 6) AS block, "
    "round(avg(CASE WHEN efiITG_GB <= 0 THEN 1e0 ELSE 0e0 END * exp(1e-1 * (p - 1e-1))), 6) AS barrier FROM "
    f"(SELECT ({SQL_A['efiITG_GB']}) AS p, efiITG_GB FROM bridge)"))
def stable_positive_cost(spark, sf):
    """J-05: block and barrier penalties for positive predictions on stable points."""
    j = S.score(bridge(spark, sf).withColumn("truth", F.col("efiITG_GB")), {"a": NET_A}, keep=("dimx", "truth")) \
        .withColumnsRenamed({"efiITG_GB": "p", "truth": "efiITG_GB"})
    return j.agg(F.round(T.stable_positive(F.col("p"), F.col("efiITG_GB"), 5.0, 0.1, "block"), 6).alias("block"),
                 F.round(T.stable_positive(F.col("p"), F.col("efiITG_GB"), 0.1, 0.1, "barrier"), 6).alias("barrier"))


@register("weighted_loss", with_bridge(
    "SELECT round(sum(w * d * d) / sum(w), 6) AS mse, round(sum(w * abs(d)) / sum(w), 6) AS mabse FROM "
    f"(SELECT ({SQL_A['efiITG_GB']}) - efiITG_GB AS d, CAST(coalesce(9e0 * exp(-((Ati - least(greatest(ti, -2e0), "
    "16e0)) * (Ati - least(greatest(ti, -2e0), 16e0))) / (2e0 * 7e0 * 7e0)) + 1e0, 1e0) AS FLOAT) AS w FROM "
    "(SELECT *, min(CASE WHEN efiITG_GB > 0 THEN Ati END) OVER (PARTITION BY scan_id) AS ti FROM bridge))"))
def weighted_loss(spark, sf):
    """J-11: instance-weighted goodness with the H-12 weights."""
    from ..operators import weights as W
    b = bridge(spark, sf)
    w = W.weights_job(b, {"ITG": ["scan_id"]})
    s = S.score(b.withColumn("truth", F.col("efiITG_GB")), {"a": NET_A}, keep=("dimx", "truth"))
    j = s.withColumnsRenamed({"efiITG_GB": "p", "truth": "efiITG_GB"}).join(w, "dimx")
    g = j.agg(*T.goodness(F.col("p"), F.col("efiITG_GB"), weight=F.col("ITGweights").cast("double")))
    return g.select(F.round("mse", 6).alias("mse"), F.round("mabse", 6).alias("mabse"))


@register("fit_network")
def fit_network(spark, sf):
    """J-07 / J-08: a small MLP fitted data-parallel on standardised bridge columns; the
    training log is the result (rows-only check; convergence is tested in tests/)."""
    b = bridge(spark, sf).select("dimx", "Ati", "Ate", "An", "q", "x", "efiITG_GB")
    cols = ["Ati", "Ate", "An", "q", "x", "efiITG_GB"]
    consts = T.scaling_dict(T.standardization(b, cols, "normsm_1_0"))
    scaled = T.scale_columns(b, consts)
    _net, log = T.fit(scaled, ["Ati", "Ate", "An", "q", "x"], ["efiITG_GB"], hidden=(8,), epochs=3, minibatches=2)
    return log
