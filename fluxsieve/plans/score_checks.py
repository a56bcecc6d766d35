"""Registered queries for scoring (I) and network evaluation reports (R-09, R-10).

The networks are fixed model parameters (seeded weights, see ``make_network``); the
input rows are the bridge view, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import join, score as S
from .checks import bridge, register, with_bridge

FEATS = ["Ati", "Ate", "An", "q", "x"]
NET_A = S.make_network(FEATS, ["efiITG_GB", "efeITG_GB"], hidden=(3,), activation="tanh", seed=1)
NET_B = S.make_network(FEATS, ["efiITG_GB"], hidden=(2,), activation="relu", seed=2)
NET_C = S.make_network(FEATS, ["efiITG_GB"], hidden=(2, 2), activation="tanh", seed=3)
NET_DIV = S.make_network(FEATS, ["efeITG_GB_div_efiITG_GB"], hidden=(2,), activation="tanh", seed=4)
NET_GAM = S.make_network(FEATS, ["gam_leq_GB"], hidden=(2,), activation="tanh", seed=5)
SQL_A, SQL_B, SQL_C = S.network_sql(NET_A), S.network_sql(NET_B), S.network_sql(NET_C)
SQL_DIV, SQL_GAM = S.network_sql(NET_DIV), S.network_sql(NET_GAM)


def _r(c, n=6):
    return F.round(c, n)


@register("score_network", with_bridge(
    f"SELECT dimx, round({SQL_A['efiITG_GB']}, 6) AS efiITG_GB, round({SQL_A['efeITG_GB']}, 6) AS efeITG_GB FROM bridge"))
def score_network(spark, sf):
    """I-01 / I-04: one network scored over Arrow batches (mapInPandas, broadcast weights)."""
    s = S.score(bridge(spark, sf), {"a": NET_A})
    return s.select("dimx", _r(F.col("efiITG_GB")).alias("efiITG_GB"), _r(F.col("efeITG_GB")).alias("efeITG_GB"))


@register("score_network_native", with_bridge(
    f"SELECT dimx, round({SQL_C['efiITG_GB']}, 6) AS efiITG_GB FROM bridge"))
def score_network_native(spark, sf):
    """I-01 for a tiny two-hidden-layer network as native expressions (codegen, no Python)."""
    cols = S.network_columns(NET_C)
    return bridge(spark, sf).select("dimx", _r(cols["efiITG_GB"]).alias("efiITG_GB"))


@register("score_clip_scale", with_bridge(
    "SELECT dimx, round(least(greatest(" + SQL_A["efiITG_GB"] + " / 2e0, -1e1), 5e1), 6) AS ion_flux, "
    "round(least(greatest(" + SQL_A["efeITG_GB"] + " / 2e0, -1e1), 5e1), 6) AS electron_flux FROM bridge"))
def score_clip_scale(spark, sf):
    """I-02, I-03, I-05: scale length 2, clipping to the network's target range, renamed targets."""
    s = S.score(bridge(spark, sf), {"a": NET_A}, scale_length=2.0, clip_low=True, clip_high=True,
                target_names_mask={"a": ["ion_flux", "electron_flux"]})
    return s.select("dimx", _r(F.col("ion_flux")).alias("ion_flux"), _r(F.col("electron_flux")).alias("electron_flux"))


def _committee_sql(members, low, high):
    ms = [f"least(greatest({m}, {low!r}), {high!r})" for m in members]
    mean = "((" + " + ".join(ms) + f") / {float(len(ms))!r})"
    var = "((" + " + ".join(f"({m} - {mean}) * ({m} - {mean})" for m in ms) + f") / {float(len(ms))!r})"
    return mean, f"sqrt({var})"


_CM, _CS = _committee_sql([SQL_A["efiITG_GB"], SQL_B["efiITG_GB"], SQL_C["efiITG_GB"]], -5.0, 40.0)


@register("score_committee", with_bridge(
    f"SELECT dimx, round({_CM}, 6) AS efiITG_GB, round({_CS}, 6) AS efiITG_GB_EB FROM bridge"))
def score_committee(spark, sf):
    """I-09 / I-11: three members scored in one pass (collection), mean and population std."""
    s = S.score(bridge(spark, sf), {"a": NET_A, "b": NET_B, "c": NET_C})
    mean, std = S.committee([F.col("a__efiITG_GB"), F.col("b__efiITG_GB"), F.col("c__efiITG_GB")], -5.0, 40.0)
    return s.select("dimx", _r(mean).alias("efiITG_GB"), _r(std).alias("efiITG_GB_EB"))


_PM, _PS = _committee_sql([SQL_A["efiITG_GB"], SQL_B["efiITG_GB"]], -5.0, 40.0)
_QM, _QS = _committee_sql([SQL_A["efeITG_GB"], SQL_C["efiITG_GB"]], -5.0, 40.0)


@register("score_committee_product", with_bridge(
    f"SELECT dimx, round({_PM} * {_QM}, 5) AS product, "
    f"round(sqrt(({_PM} * {_QS}) * ({_PM} * {_QS}) + ({_PS} * {_QM}) * ({_PS} * {_QM})), 5) AS product_EB FROM bridge"))
def score_committee_product(spark, sf):
    """I-10: product of two committees with propagated error."""
    s = S.score(bridge(spark, sf), {"a": NET_A, "b": NET_B, "c": NET_C})
    x, ex = S.committee([F.col("a__efiITG_GB"), F.col("b__efiITG_GB")], -5.0, 40.0)
    y, ey = S.committee([F.col("a__efeITG_GB"), F.col("c__efiITG_GB")], -5.0, 40.0)
    p, pe = S.committee_product(x, ex, y, ey)
    return s.select("dimx", _r(p, 5).alias("product"), _r(pe, 5).alias("product_EB"))


@register("score_combo", with_bridge(
    f"SELECT dimx, round({SQL_A['efiITG_GB']} * {SQL_B['efiITG_GB']}, 6) AS combo, "
    f"round({SQL_A['efeITG_GB']} - {SQL_A['efiITG_GB']}, 6) AS self_combo FROM bridge"))
def score_combo(spark, sf):
    """I-06 (``nn0 * nn1`` across networks) and I-07 (``nn1 - nn0`` across targets of one network)."""
    s = S.score(bridge(spark, sf), {"a": NET_A, "b": NET_B})
    combo = S.combine("nn0 * nn1", [F.col("a__efiITG_GB"), F.col("b__efiITG_GB")])
    self_combo = S.combine("nn1 - nn0", [F.col("a__efiITG_GB"), F.col("a__efeITG_GB")])
    return s.select("dimx", _r(combo).alias("combo"), _r(self_combo).alias("self_combo"))


@register("score_divnet_leading", with_bridge(
    f"SELECT dimx, round({SQL_DIV['efeITG_GB_div_efiITG_GB']} * {SQL_B['efiITG_GB']}, 6) AS efeITG_GB FROM bridge"))
def score_divnet_leading(spark, sf):
    """I-13: ratio network times the leading-flux network."""
    s = S.score(bridge(spark, sf), {"div": NET_DIV, "lead": NET_B})
    name, col = S.combine_divnet_with_leading("efeITG_GB_div_efiITG_GB", F.col("div__efeITG_GB_div_efiITG_GB"),
                                              {"efiITG_GB": F.col("lead__efiITG_GB")})
    return s.select("dimx", _r(col).alias(name))


def _rotation_rule_sql():
    g0 = f"greatest({SQL_GAM['gam_leq_GB']}, 1e-4)"
    f = "(0.13 * q + 0.09 / (x * (1e0 / 3e0)) + 0.41 * smag + -1.65)"
    fac = f"(CASE WHEN {g0} = 1e-4 THEN 0e0 WHEN x <> 0 THEN greatest(1e0 + {f} * gammaE_GB / {g0}, 0e0) END)"
    return fac


@register("score_rotation_rule", with_bridge(
    f"SELECT dimx, round({SQL_A['efiITG_GB']} * {_rotation_rule_sql()}, 6) AS efiITG_GB FROM "
    "(SELECT *, An / 4e0 AS smag, Machtor * 2e0 - 1e-1 AS gammaE_GB FROM bridge)"))
def score_rotation_rule(spark, sf):
    """I-15: rotation rule applied to a flux network with a growth-rate network."""
    b = bridge(spark, sf).withColumns(
        {"smag": F.col("An") / 4.0, "gammaE_GB": F.col("Machtor") * 2.0 - 0.1})
    s = S.score(b, {"flux": NET_A, "gam": NET_GAM}, keep=("dimx", "x", "q", "smag", "gammaE_GB"))
    fac = S.rotation_rule_factor(F.col("gam__gam_leq_GB"), F.col("x"), F.col("q"), F.col("smag"), F.col("gammaE_GB"))
    s = s.withColumnRenamed("flux__efiITG_GB", "efiITG_GB")
    return S.apply_rotation_rule(s, ["efiITG_GB"], fac).select("dimx", _r(F.col("efiITG_GB")).alias("efiITG_GB"))


@register("shear_conversion", with_bridge(
    "SELECT dimx, round(-g * (3e0 * sqrt((1.602176565e-19 * Te * 1e3) / (2e0 * 1.672621777e-27))) / "
    "(1e0 * sqrt(1.602176565e-19 * 1e3 / 1.672621777e-27)), 9) AS gammaE_sim FROM "
    "(SELECT dimx, Machtor * 2e0 - 1e-1 AS g, 1e0 + q AS Te FROM bridge)"))
def shear_conversion(spark, sf):
    """I-16: shear in gyro-Bohm units to the simulator's units (deuterium, Te from q)."""
    b = bridge(spark, sf).select("dimx", (F.col("Machtor") * 2.0 - 0.1).alias("g"), (1.0 + F.col("q")).alias("Te"))
    return b.select("dimx", _r(S.gammaE_GB_to_sim(F.col("g"), F.col("Te"), F.lit(2.0)), 9).alias("gammaE_sim"))


NET_LESS = S.make_network(["Ati", "Ate", "Ati0", "Zeff", "normni1"], ["efiITG_GB"], hidden=(2,), seed=6)
SQL_LESS = S.network_sql(NET_LESS)


@register("score_fewer_inputs", with_bridge(
    "SELECT dimx, round(" + SQL_LESS["efiITG_GB"] + ", 6) AS efiITG_GB FROM (SELECT dimx, Ati, Ate, Ati AS Ati0, "
    "1.5e0 AS Zeff, (1.5e0 - 1e0) / (6e0 * 6e0 - 6e0 * 1e0) AS normni1 FROM bridge)"))
def score_fewer_inputs(spark, sf):
    """I-08: copy an input to its species column, add a constant and two-ion densities, then score."""
    b = bridge(spark, sf).select("dimx", "Ati", "Ate")
    p = S.fewer_inputs(b, copies={"Ati": ["Ati0"]}, constants={"Zeff": 1.5}, normni_from_zeff=(1.0, 6.0))
    s = S.score(p, {"less": NET_LESS})
    return s.select("dimx", _r(F.col("efiITG_GB")).alias("efiITG_GB"))


def _rms_sql():
    parts = []
    for net, sq in (("a", SQL_A), ("b", SQL_B), ("c", SQL_C)):
        parts.append(f"SELECT '{net}' AS net, 'efiITG_GB' AS target, ({sq['efiITG_GB']}) - efiITG_GB AS d FROM s")
    parts.append(f"SELECT 'a', 'efeITG_GB', ({SQL_A['efeITG_GB']}) - efeITG_GB FROM s")
    return ("SELECT net, target, round(sqrt(avg(d * d)), 6) AS rms, CAST(count(*) AS BIGINT) AS n FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY net, target")


@register("residual_rms", with_bridge(_rms_sql(), "s AS (SELECT * FROM bridge WHERE efe_GB >= 0e0 AND efi_GB >= 0e0 "
                                                   "AND efe_GB < 1e2 AND efi_GB < 1e2)"))
def residual_rms(spark, sf):
    """R-09: regime rows, every network scored in one pass, RMS per (network, target)
    (truth columns ride along with the scores: no join back)."""
    b = bridge(spark, sf).filter("efe_GB >= 0 AND efi_GB >= 0 AND efe_GB < 100 AND efi_GB < 100")
    s = S.score(b, {"a": NET_A, "b": NET_B, "c": NET_C}, keep=("dimx", "efiITG_GB", "efeITG_GB"))
    pairs = [(c.split("__")[0], c.split("__")[1], c) for c in s.columns if "__" in c]
    r = S.residual_rms_wide(s, pairs)
    return r.select("net", "target", _r(F.col("rms")).alias("rms"), F.col("n").cast("bigint").alias("n"))


@register("best_network", with_bridge(
    "SELECT net, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, net = (SELECT arg_min(net, mse) FROM m) AS best "
    "FROM m", "m AS (SELECT net, avg(d * d) AS mse FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS net, ({sq['efiITG_GB']}) - efiITG_GB AS d FROM bridge" for n, sq in
        (("a", SQL_A), ("b", SQL_B), ("c", SQL_C))) + ") GROUP BY net)"))
def best_network(spark, sf):
    """R-10: MSE / RMSE per network on the same rows and the best one (argmin)."""
    b = bridge(spark, sf)
    s = S.score(b, {"a": NET_A, "b": NET_B, "c": NET_C}, keep=("dimx", "efiITG_GB"))
    long = s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("net"),
                                                 (F.col(f"{n}__efiITG_GB") - F.col("efiITG_GB")).alias("d"))
                                        for n in ("a", "b", "c")])).alias("p")).select("p.*")
    m = long.groupBy("net").agg(F.avg(F.col("d") * F.col("d")).alias("mse"))
    from pyspark.sql import Window
    best = F.min_by("net", "mse").over(Window.partitionBy())  # over the per-network rows only
    return m.select("net", _r(F.col("mse")).alias("mse"), _r(F.sqrt("mse")).alias("rmse"),
                    (F.col("net") == best).alias("best"))


@register("scan_grid", with_bridge(
    "SELECT a.Ate, n.An, CAST(count(b.dimx) AS BIGINT) AS n_points FROM (SELECT DISTINCT Ate FROM bridge) a "
    "CROSS JOIN (SELECT DISTINCT An FROM bridge) n LEFT JOIN bridge b ON b.Ate = a.Ate AND b.An = n.An "
    "GROUP BY a.Ate, n.An"))
def scan_grid(spark, sf):
    """I-17: product grid of the data's (Ate, An) axes, then points counted per grid cell (empty cells included)."""
    from ..operators.slices import product_grid
    b = bridge(spark, sf)
    g = product_grid(b, ["Ate", "An"])
    counts = b.groupBy("Ate", "An").agg(F.count(F.lit(1)).alias("n"))
    return g.join(counts, ["Ate", "An"], "left").select("Ate", "An", F.coalesce("n", F.lit(0)).cast("bigint")
                                                          .alias("n_points"))


@register("dedupe_mean", with_bridge(
    "SELECT Ate, An, round(CAST(sum(CAST(efiITG_GB AS DECIMAL(38,2))) AS DOUBLE) / count(efiITG_GB), 6) AS efiITG_GB FROM bridge GROUP BY Ate, An"))
def dedupe_mean(spark, sf):
    """I-18: equal keys reduced to their mean."""
    from ..functions.numeric import exact_mean
    return bridge(spark, sf).groupBy("Ate", "An").agg(_r(exact_mean(F.col("efiITG_GB"), 2)).alias("efiITG_GB"))


def _pivot_sql():
    cols = ", ".join(f"round(max(CASE WHEN An = {float(v)!r} THEN m END), 6) AS \"{float(v)!r}\"" for v in range(0, 9))
    return with_bridge(f"SELECT Ate, {cols} FROM (SELECT Ate, An, CAST(sum(CAST(efiITG_GB AS DECIMAL(38,2))) AS DOUBLE) / count(efiITG_GB) AS m FROM bridge GROUP BY Ate, An) "
                       "GROUP BY Ate")


@register("pivot_table", _pivot_sql())
def pivot_table(spark, sf):
    """I-20: Ate x An table of the mean flux."""
    from ..functions.numeric import exact_mean
    b = bridge(spark, sf).groupBy("Ate", "An").agg(exact_mean(F.col("efiITG_GB"), 2).alias("m"))
    p = b.groupBy("Ate").pivot("An").agg(F.first("m"))                 # the levels are those of the data
    return p.select("Ate", *[_r(F.col(f"`{c}`")).alias(c) for c in p.columns if c != "Ate"])


@register("match_nearness", with_bridge(
    "SELECT b.dimx, g.v AS grid_value FROM bridge b JOIN (SELECT DISTINCT Ati * 1.0004e0 AS v FROM bridge) g "
    "ON abs(b.Ati - g.v) <= 1e-8 + 1e-3 * abs(g.v)"))
def match_nearness(spark, sf):
    """I-21 / C-22: band join of scan values to grid values by closeness (bucket equi-join + exact test)."""
    b = bridge(spark, sf).select("dimx", "Ati")
    g = b.select((F.col("Ati") * 1.0004).alias("v")).distinct()
    return join.band_join(b, "Ati", g, "v", atol=1e-8, rtol=1e-3).select("dimx", F.col("v").alias("grid_value"))


@register("compare_with_without_rule", with_bridge(
    f"SELECT dimx, round({SQL_A['efiITG_GB']} * {_rotation_rule_sql()}, 6) AS efiITG_GB_with, "
    f"round({SQL_A['efiITG_GB']}, 6) AS efiITG_GB_without FROM "
    "(SELECT *, An / 4e0 AS smag, Machtor * 2e0 - 1e-1 AS gammaE_GB FROM bridge)"))
def compare_with_without_rule(spark, sf):
    """R-15: scores with and without the rotation rule side by side on the id."""
    b = bridge(spark, sf).withColumns({"smag": F.col("An") / 4.0, "gammaE_GB": F.col("Machtor") * 2.0 - 0.1})
    s = S.score(b, {"flux": NET_A, "gam": NET_GAM}, keep=("dimx", "x", "q", "smag", "gammaE_GB"))   # scored once, both columns from it
    fac = S.rotation_rule_factor(F.col("gam__gam_leq_GB"), F.col("x"), F.col("q"), F.col("smag"), F.col("gammaE_GB"))
    flux = F.col("flux__efiITG_GB")
    return s.select("dimx", _r(flux * fac).alias("efiITG_GB_with"), _r(flux).alias("efiITG_GB_without"))
