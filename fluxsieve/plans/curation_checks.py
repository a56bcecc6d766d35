"""Registered queries for filters (C), masks (D), derivations (E) and reports (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.numeric import exact_mean
from ..operators import derive, filters, masks, report
from .checks import bridge, register, sql_ieee_div, sql_tf, with_bridge

BASE = derive.DIV_NAMES_BASE
LESS = 100.0 / 3.0


def _ratios_sql() -> str:
    return ", ".join(f"{sql_ieee_div(a, b)} AS {n}" for n, (a, b) in
                     ((n, n.split("_div_")) for n in BASE))


DIVSUM_CTE = f"d AS (SELECT bridge.*, {_ratios_sql()} FROM bridge)"

# columns of bridge + base ratios, by role (schema-derived, fixed for the fixture)
ZERO_COLS = ["efiITG_GB", "efeITG_GB", "efeTEM_GB", "efiTEM_GB", "efeETG_GB", "efe_GB", "efi_GB",
             "efeITG_GB_div_efiITG_GB", "efiTEM_GB_div_efeTEM_GB"]
FEMTO_COLS = ["efiITG_GB", "efeITG_GB", "efeTEM_GB", "efiTEM_GB", "efeETG_GB", "pfeITG_GB", "pfeTEM_GB",
              "efe_GB", "efi_GB"]
NEG_COLS = ["efiITG_GB", "efeITG_GB", "efeTEM_GB", "efiTEM_GB", "efeETG_GB", "efe_GB", "efi_GB"]
GATES = {
    "efiITG_GB": "ITG", "efeITG_GB": "ITG", "pfeITG_GB": "ITG", "efeTEM_GB": "TEM", "efiTEM_GB": "TEM",
    "pfeTEM_GB": "TEM", "efeETG_GB": "ETG", "efe_GB": "(ITG OR TEM OR ETG)", "efi_GB": "(ITG OR TEM OR ETG)",
    "efeITG_GB_div_efiITG_GB": "ITG", "pfeITG_GB_div_efiITG_GB": "ITG",
    "efiTEM_GB_div_efeTEM_GB": "TEM", "pfeTEM_GB_div_efeTEM_GB": "TEM",
}


def sql_abs_lt(c, b):
    return sql_tf(f"{c} > -{b} AND {c} < {b}")


def sql_zero_cte(src: str, name: str = "z") -> str:
    neg = "NOT (" + " AND ".join(sql_tf(f"{c} >= 0") for c in ZERO_COLS) + ")"
    keep = "dimx, scan_id, Ati, Ate, An, q, x, Machtor, Nustar, c, pfeITG_GB, pfeTEM_GB, absambi, cke, cki, " \
           "ITG, TEM, ETG, pfeITG_GB_div_efiITG_GB, pfeTEM_GB_div_efeTEM_GB"
    zs = ", ".join(f"CASE WHEN {neg} THEN 0e0 ELSE {c} END AS {c}" for c in ZERO_COLS)
    return f"{name} AS (SELECT {keep}, {zs} FROM {src})"


SEPTOT_SQL = " AND ".join(sql_tf(f"abs({s}) <= 1.5e0 * abs({t})") for t, seps in
                          (("efi_GB", ["efiITG_GB", "efiTEM_GB"]),
                           ("efe_GB", ["efeETG_GB", "efeITG_GB", "efeTEM_GB"])) for s in seps)
AMBI0_SQL = sql_tf("absambi < 1.5e0 AND absambi > 1e0/1.5e0")
AMBI1_SQL = sql_tf("(absambi - 1e0) < 1.5e0 AND (absambi - 1e0) > -1.5e0")
FEMTO_SQL = "NOT (" + " OR ".join(sql_tf(f"abs({c}) < 1e-4 AND {c} <> 0") for c in FEMTO_COLS) + ")"
CK_SQL = f"{sql_abs_lt('cke', '50e0')} AND {sql_abs_lt('cki', '50e0')}"
REGIME_SQL = sql_tf("efe_GB < 100e0/3e0 AND efi_GB < 100e0/3e0 AND efe_GB >= 0e0 AND efi_GB >= 0e0")


def chain_9d():
    return filters.sanity_chain(1.5, 1.5, 1e-4, cke_bound=50.0, cki_bound=50.0, ambipolar_version=0)


def curated(spark, sf):
    """M-02 core on the bridge: E-01, C-15, C-02, D-01, D-03."""
    d = derive.divsum(bridge(spark, sf), BASE)
    d = chain_9d().apply(d)
    d = filters.regime_filter(d, 0.0, LESS)
    d = masks.stability_mask(d)
    return masks.div_bounds_mask(d, masks.DIV_BOUNDS_9D)


def _gate_sql(c):
    return f"CASE WHEN {sql_tf(GATES[c])} THEN {c} END"


def _div_sql(c, lo, hi):
    zero = f" OR {c} = 0e0" if (lo > 0 or hi < 0) else ""
    lo_s = "CAST('-inf' AS DOUBLE)" if lo == -float("inf") else repr(lo)
    hi_s = "CAST('inf' AS DOUBLE)" if hi == float("inf") else repr(hi)
    return f"CASE WHEN {sql_tf(f'({lo_s} < {c} AND {c} < {hi_s}){zero}')} THEN {c} END"


CURATED_SQL_CTES = ",\n".join([
    DIVSUM_CTE,
    f"c1 AS (SELECT * FROM d WHERE {CK_SQL})",
    sql_zero_cte("c1"),
    f"s AS (SELECT * FROM z WHERE {SEPTOT_SQL} AND {AMBI0_SQL} AND {FEMTO_SQL} AND {REGIME_SQL})",
    "m AS (SELECT dimx, ITG, TEM, ETG, " + ", ".join(f"{_gate_sql(c)} AS {c}" for c in GATES) + " FROM s)",
    "k AS (SELECT dimx, ITG, TEM, ETG, efi_GB, efe_GB, " + ", ".join(
        f"{_div_sql(n, *masks.DIV_BOUNDS_9D[n])} AS {n}" for n in BASE) + " FROM m)",
])


@register("curated_breakdown", with_bridge(
    "SELECT ITG, TEM, ETG, CAST(count(*) AS BIGINT) AS n, "
    "round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct, "
    "CAST(count(efeITG_GB_div_efiITG_GB) AS BIGINT) AS n_efeITG_div, "
    "CAST(count(pfeTEM_GB_div_efeTEM_GB) AS BIGINT) AS n_pfeTEM_div, "
    "round(CAST(sum(CAST(efi_GB AS DECIMAL(38,2))) AS DOUBLE) / count(efi_GB), 6) AS avg_efi FROM k GROUP BY ITG, TEM, ETG", CURATED_SQL_CTES))
def curated_breakdown(spark, sf):
    """Flagship: curated set -> R-02 breakdown with masked-target counts."""
    from pyspark.sql import Window
    c = curated(spark, sf)
    g = c.groupBy("ITG", "TEM", "ETG").agg(
        F.count(F.lit(1)).alias("n"), F.count("efeITG_GB_div_efiITG_GB").alias("n_efeITG_div"),
        F.count("pfeTEM_GB_div_efeTEM_GB").alias("n_pfeTEM_div"),
        exact_mean(F.col("efi_GB"), 2).alias("avg_efi"))  # exact: order-independent
    return g.select("ITG", "TEM", "ETG", F.col("n").cast("bigint").alias("n"),
                    F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("pct"),
                    F.col("n_efeITG_div").cast("bigint").alias("n_efeITG_div"),
                    F.col("n_pfeTEM_div").cast("bigint").alias("n_pfeTEM_div"),
                    F.round("avg_efi", 6).alias("avg_efi"))


@register("curated_rows", with_bridge(
    "SELECT dimx, efi_GB, efe_GB, " + ", ".join(BASE) + " FROM k", CURATED_SQL_CTES))
def curated_rows(spark, sf):
    return curated(spark, sf).select("dimx", "efi_GB", "efe_GB", *BASE)


@register("divsum_ratios", with_bridge("SELECT dimx, " + ", ".join(BASE) + " FROM d", DIVSUM_CTE))
def divsum_ratios(spark, sf):
    return derive.divsum(bridge(spark, sf), BASE).select("dimx", *BASE)


_LEGACY = [("efiITG_GB", "efeITG_GB"), ("efiTEM_GB", "efeTEM_GB"), ("efi_GB", "efe_GB")]
_LEGACY_PF = [("pfeITG_GB", "efiITG_GB", "efeITG_GB"), ("pfeTEM_GB", "efiTEM_GB", "efeTEM_GB")]


def _legacy_sql():
    cols = []
    for a, b in _LEGACY:
        cols += [f"{a} + {b} AS {a}_plus_{b}", f"{sql_ieee_div(a, b)} AS {a}_div_{b}",
                 f"{sql_ieee_div(b, a)} AS {b}_div_{a}"]
    for a, b, c in _LEGACY_PF:
        cols += [f"{a} + {b} + {c} AS {a}_plus_{b}_plus_{c}", f"{sql_ieee_div(a, b)} AS {a}_div_{b}",
                 f"{sql_ieee_div(a, c)} AS {a}_div_{c}"]
    return "SELECT dimx, " + ", ".join(cols) + " FROM bridge"


@register("divsum_legacy", with_bridge(_legacy_sql()))
def divsum_legacy(spark, sf):
    b = bridge(spark, sf)
    out = derive.divsum_legacy(b)
    return out.select("dimx", *[c for c in out.columns if c not in b.columns])


@register("combine_expression", with_bridge(
    f"SELECT dimx, efeITG_GB + {sql_ieee_div('efiITG_GB', 'efi_GB')} AS efeITG_GB_plus_efiITG_GB_div_efi_GB, "
    f"{sql_ieee_div('efeITG_GB + efiITG_GB', 'efi_GB')} AS l2r FROM bridge"))
def combine_expression(spark, sf):
    b = bridge(spark, sf)
    name = "efeITG_GB_plus_efiITG_GB_div_efi_GB"
    return b.select("dimx", derive.expression_column(b, name).alias(name),
                    derive.expression_column(b, name, "left_to_right").alias("l2r"))


ROT_FEATS = ["Ati", "Ate", "An", "q", "x", "Nustar", "Machtor"]


def dedupe_points(df, keys, order="dimx"):
    """Keep the lowest-id row per feature tuple (grid points must be unique)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


@register("rotdiv_ratios", with_bridge(
    "SELECT dimx, "
    "CASE WHEN b0 = 0 THEN 0e0 ELSE efi_GB / b0 END AS efi_GB_div_efi_GB_rot0, "
    "CASE WHEN efeITG_GB = 0 THEN 0e0 ELSE e0 / efeITG_GB END AS efeITG_GB_rot0_div_efeITG_GB "
    "FROM (SELECT *, max(CASE WHEN Machtor = 0 THEN efi_GB END) OVER (PARTITION BY Ati, Ate, An, q, x, Nustar) AS b0, "
    "max(CASE WHEN Machtor = 0 THEN efeITG_GB END) OVER (PARTITION BY Ati, Ate, An, q, x, Nustar) AS e0 "
    "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Ati, Ate, An, q, x, Nustar, Machtor "
    "ORDER BY dimx) AS rn FROM bridge) WHERE rn = 1))"))
def rotdiv_ratios(spark, sf):
    b = dedupe_points(bridge(spark, sf), ROT_FEATS)
    r1 = derive.rotdiv(b, ROT_FEATS, columns=["efi_GB"])
    r2 = derive.rotdiv(r1, ROT_FEATS, rot_over_norot=False, columns=["efeITG_GB"])
    return r2.select("dimx", "efi_GB_div_efi_GB_rot0", "efeITG_GB_rot0_div_efeITG_GB")


@register("negative_zeroed", with_bridge("SELECT dimx, " + ", ".join(ZERO_COLS) + " FROM z",
                                         DIVSUM_CTE + ",\n" + sql_zero_cte("d")))
def negative_zeroed(spark, sf):
    z = filters.negative_to_zero(derive.divsum(bridge(spark, sf), BASE))
    return z.select("dimx", *ZERO_COLS)


@register("stability_masked", with_bridge(
    "SELECT dimx, " + ", ".join(f"{_gate_sql(c)} AS {c}" for c in GATES) + " FROM d", DIVSUM_CTE))
def stability_masked(spark, sf):
    return masks.stability_mask(derive.divsum(bridge(spark, sf), BASE)).select("dimx", *GATES)


@register("div_bounds_masked", with_bridge(
    "SELECT dimx, " + ", ".join(f"{_div_sql(n, *masks.DIV_BOUNDS_9D[n])} AS {n}" for n in BASE) + " FROM d",
    DIVSUM_CTE))
def div_bounds_masked(spark, sf):
    return masks.div_bounds_mask(derive.divsum(bridge(spark, sf), BASE), masks.DIV_BOUNDS_9D).select("dimx", *BASE)


@register("finite_masked", with_bridge(
    "SELECT dimx, " + ", ".join(f"CASE WHEN isfinite({n}) THEN {n} END AS {n}" for n in BASE) + " FROM d",
    DIVSUM_CTE))
def finite_masked(spark, sf):
    return masks.finite_mask(derive.divsum(bridge(spark, sf), BASE), BASE).select("dimx", *BASE)


@register("null_by_ids", with_bridge(
    "SELECT dimx, CASE WHEN c % 11 = 0 THEN NULL ELSE efiITG_GB END AS efiITG_GB, "
    "CASE WHEN c % 11 = 0 THEN NULL ELSE efeITG_GB END AS efeITG_GB FROM bridge"))
def null_by_ids(spark, sf):
    """D-06 with an id list derived from the data (``c % 11 = 0``)."""
    b = bridge(spark, sf)
    ids = b.filter(F.col("c") % 11 == 0).select("dimx")
    return masks.null_by_ids(b, ids, ["efiITG_GB", "efeITG_GB"]).select("dimx", "efiITG_GB", "efeITG_GB")


def _filter_query(name, pred_sql, pred_fn, src="bridge", ctes=""):
    @register(name, with_bridge(f"SELECT dimx FROM {src} WHERE {pred_sql}", ctes))
    def q(spark, sf):
        df = bridge(spark, sf)
        if src == "d":
            df = derive.divsum(df, BASE)
        return filters.apply(df, pred_fn).select("dimx")
    q.__name__ = name
    return q


_filter_query("filter_ck", CK_SQL, filters.ck_ok(50.0))
_filter_query("filter_cke", sql_abs_lt("cke", "20e0"), filters.cke_ok(20.0))
_filter_query("filter_septot", SEPTOT_SQL, filters.septot_ok(1.5))
_filter_query("filter_ambipolar_v0", AMBI0_SQL, filters.ambipolar_ok(1.5, 0))
_filter_query("filter_ambipolar_v1", sql_tf("(absambi - 1e0) < 1e0 AND (absambi - 1e0) > -1e0"),
              filters.ambipolar_ok(1.0, 1))
_filter_query("filter_femtoflux", FEMTO_SQL.replace("1e-4", "5e-2"), filters.femtoflux_ok(5e-2))
_filter_query("filter_negative", " AND ".join(sql_tf(f"{c} >= 0") for c in NEG_COLS), filters.nonnegative_ok())
_filter_query("filter_regime", REGIME_SQL, filters.regime_ok(0.0, LESS))
_filter_query("filter_finite", " AND ".join(f"isfinite({n})" for n in BASE),
              lambda df: filters.all_of(filters.is_finite(F.col(n)) for n in BASE), src="d", ctes=DIVSUM_CTE)
_filter_query("filter_isclose", "abs(Nustar - 1e-2) <= 1e-5 + 1e-3 * abs(1e-2) AND "
              "(abs(x - 3e-1) <= 1e-8 + 1e-5 * abs(3e-1) OR abs(x - 7e-1) <= 1e-8 + 1e-5 * abs(7e-1))",
              lambda df: filters.approx_equal(F.col("Nustar"), 1e-2)
              & filters.fuzzy_is_in(F.col("x"), [0.3, 0.7]))


@register("filter_input_range", with_bridge(
    "SELECT dimx FROM bridge WHERE x IS NOT NULL AND COALESCE(Ati >= 10e0 AND Ati <= 40e0, FALSE) "
    "AND COALESCE(Ate >= 2e0 AND Ate <= 8e0, FALSE)"))
def filter_input_range(spark, sf):
    b = bridge(spark, sf)
    inp = b.select("dimx", "Ati", "Ate", "x")
    data = b.select("dimx", "efi_GB")
    return filters.input_range_filter(inp, data, {"Ati": (10.0, 40.0), "Ate": (2.0, 8.0)}).select("dimx")


@register("drop_nulls", with_bridge("SELECT dimx FROM d WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in BASE),
                                    DIVSUM_CTE))
def drop_nulls(spark, sf):
    return filters.drop_nulls(derive.divsum(bridge(spark, sf), BASE).select("dimx", *BASE)).select("dimx")


@register("sanity_chain", with_bridge(
    "SELECT dimx, efi_GB, efe_GB, efeITG_GB_div_efiITG_GB FROM z "
    f"WHERE {SEPTOT_SQL} AND {AMBI0_SQL} AND {FEMTO_SQL}",
    DIVSUM_CTE + f",\nc1 AS (SELECT * FROM d WHERE {CK_SQL}),\n" + sql_zero_cte("c1")))
def sanity_chain(spark, sf):
    d = chain_9d().apply(derive.divsum(bridge(spark, sf), BASE))
    return d.select("dimx", "efi_GB", "efe_GB", "efeITG_GB_div_efiITG_GB")


GEN2_NEG = " AND ".join(sql_tf(f"{c} >= 0") for c in NEG_COLS)
GEN2_FEMTO = FEMTO_SQL


@register("sanity_chain_gen2", with_bridge(
    f"SELECT dimx FROM bridge WHERE {GEN2_NEG} AND {CK_SQL} AND {SEPTOT_SQL} AND {AMBI0_SQL} AND {GEN2_FEMTO}"))
def sanity_chain_gen2(spark, sf):
    return filters.sanity_chain_gen2(50.0, 1.5, 1.5, 1e-4).apply(bridge(spark, sf)).select("dimx")


@register("yield_report", with_bridge(
    "SELECT step, step_no, CAST(rows_left AS BIGINT) AS rows_left, round(rows_left * 100e0 / total, 6) AS pct_left "
    "FROM (SELECT (SELECT count(*) FROM d) AS total, * FROM ("
    "SELECT 'cke' AS step, 1 AS step_no, count(*) AS rows_left FROM d WHERE " + sql_abs_lt("cke", "50e0") +
    " UNION ALL SELECT 'cki', 2, count(*) FROM c1"
    " UNION ALL SELECT 'septot', 3, count(*) FROM z WHERE " + SEPTOT_SQL +
    " UNION ALL SELECT 'ambipolar', 4, count(*) FROM z WHERE " + SEPTOT_SQL + " AND " + AMBI0_SQL +
    " UNION ALL SELECT 'femtoflux', 5, count(*) FROM z WHERE " + SEPTOT_SQL + " AND " + AMBI0_SQL +
    " AND " + FEMTO_SQL + "))",
    DIVSUM_CTE + f",\nc1 AS (SELECT * FROM d WHERE {CK_SQL}),\n" + sql_zero_cte("c1")))
def yield_report(spark, sf):
    return report.yield_report(derive.divsum(bridge(spark, sf), BASE), chain_9d())


@register("stability_breakdown", with_bridge(
    "SELECT ITG, TEM, ETG, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct "
    "FROM bridge GROUP BY ITG, TEM, ETG"))
def stability_breakdown(spark, sf):
    return report.stability_breakdown(bridge(spark, sf))


STAT_COLS = ["efiITG_GB", "efeITG_GB", "efeTEM_GB", "efiTEM_GB", "efeETG_GB", "pfeITG_GB", "pfeTEM_GB"]


def _long_sql(cols, exprs, names, src):
    sel = " UNION ALL ".join(
        f"SELECT '{c}' AS name, " + ", ".join(f"{e.format(c=c)} AS {n}" for e, n in zip(exprs, names)) + f" FROM {src}"
        for c in cols)
    return sel


@register("mean_median", with_bridge(_long_sql(
    STAT_COLS, ["round(CAST(sum(CAST({c} AS DECIMAL(38,2))) AS DOUBLE) / count({c}), 6)",
                "round(quantile_cont({c}, 0.5), 6)"], ["mean", "median"], "m"),
    "m AS (SELECT " + ", ".join(f"{_gate_sql(c)} AS {c}" for c in STAT_COLS) + " FROM bridge)"))
def mean_median(spark, sf):
    """R-03 with missing values (points stable in a mode nulled by its mask)."""
    return report.mean_median(masks.stability_mask(bridge(spark, sf)), STAT_COLS, decimals=2)


@register("standardization", with_bridge(_long_sql(
    ["Ati", "Ate", "An", "q", "x", "efi_GB", "efe_GB"],
    ["round(CAST(sum(CAST({c} AS DECIMAL(38,2))) AS DOUBLE) / count({c}), 6)",
     "round(sqrt(greatest((CAST(sum(CAST({c} AS DECIMAL(18,2)) * CAST({c} AS DECIMAL(18,2))) AS DOUBLE) - "
     "CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) * CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c})) "
     "/ (count({c}) - 1), 0e0)), 6)"],
    ["mean", "std"], "bridge")))
def standardization(spark, sf):
    return report.standardization_table(bridge(spark, sf), ["Ati", "Ate", "An", "q", "x", "efi_GB", "efe_GB"],
                                        decimals=2)


@register("special_values", with_bridge(_long_sql(
    BASE, ["CAST(count_if({c} = 0) AS BIGINT)", "CAST(count_if({c} = CAST('inf' AS DOUBLE)) AS BIGINT)",
           "CAST(count_if({c} = CAST('-inf' AS DOUBLE)) AS BIGINT)", "CAST(count_if({c} IS NULL) AS BIGINT)"],
    ["zeros", "posinf", "neginf", "nulls"], "d"), DIVSUM_CTE))
def special_values(spark, sf):
    return report.special_value_counts(derive.divsum(bridge(spark, sf), BASE), BASE)


HIST_SQL = """
v AS (SELECT efiITG_GB AS v, ITG, TEM FROM bridge
      WHERE efiITG_GB IS NOT NULL AND efiITG_GB <> 0 AND isfinite(efiITG_GB)),
p AS (SELECT CAST(ceil(log10(abs(max(v)))) AS INTEGER) AS mp FROM v),
b AS (SELECT v.*, p.mp, floor(log10(abs(v))) AS up0, ceil(log10(abs(v))) AS dn FROM v, p
      WHERE v >= -power(10e0, p.mp) AND v <= power(10e0, p.mp)),
e AS (SELECT *, CASE WHEN up0 >= mp THEN mp - 1 ELSE up0 END AS up FROM b),
f AS (SELECT ITG, TEM,
      CASE WHEN v > 0 THEN (CASE WHEN up < -3 THEN 0e0 ELSE power(10e0, up) END)
           ELSE (CASE WHEN dn <= -3 THEN -1e-3 ELSE -power(10e0, dn) END) END AS bin_lo,
      CASE WHEN v > 0 THEN (CASE WHEN up < -3 THEN 1e-3 ELSE power(10e0, up + 1) END)
           ELSE (CASE WHEN dn <= -3 THEN 0e0 ELSE -power(10e0, dn - 1) END) END AS bin_hi FROM e)
"""


@register("signed_log_histogram", with_bridge(
    "SELECT 'all' AS subset, bin_lo, bin_hi, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY bin_lo, bin_hi "
    "UNION ALL SELECT 'ITG', bin_lo, bin_hi, CAST(count_if(ITG) AS BIGINT) FROM f GROUP BY bin_lo, bin_hi "
    "UNION ALL SELECT 'TEM', bin_lo, bin_hi, CAST(count_if(TEM) AS BIGINT) FROM f GROUP BY bin_lo, bin_hi",
    HIST_SQL.strip()))
def signed_log_histogram(spark, sf):
    """R-05 / R-07 (subsets by instability flag, the fixture's stand-in for growth filters)."""
    return report.signed_log_histogram(bridge(spark, sf), "efiITG_GB",
                                       {"all": F.lit(True), "ITG": F.col("ITG"), "TEM": F.col("TEM")})


@register("plain_histogram", with_bridge(
    "SELECT CAST(CASE WHEN efeTEM_GB = 25e0 THEN 9 ELSE floor((efeTEM_GB - 0e0) / (25e0 / 10)) END AS INTEGER) "
    "AS bucket, CAST(count(*) AS BIGINT) AS n FROM bridge WHERE efeTEM_GB IS NOT NULL AND efeTEM_GB >= 0e0 "
    "AND efeTEM_GB <= 25e0 GROUP BY 1"))
def plain_histogram(spark, sf):
    return report.plain_histogram(bridge(spark, sf), "efeTEM_GB", 0.0, 25.0, 10)


@register("dataset_difference", with_bridge(
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count_if(s.dimx IS NULL) AS BIGINT) AS only_left, "
    "CAST(count_if(bridge.dimx IS NULL) AS BIGINT) AS only_right, "
    "CAST(count_if(s.dimx IS NOT NULL AND bridge.dimx IS NOT NULL AND "
    "(bridge.efi_GB IS DISTINCT FROM s.efi_GB OR bridge.efe_GB IS DISTINCT FROM s.efe_GB)) AS BIGINT) AS differing "
    "FROM bridge FULL JOIN (SELECT dimx, efi_GB, efe_GB FROM z WHERE "
    f"{SEPTOT_SQL} AND {AMBI0_SQL} AND {FEMTO_SQL}) s ON bridge.dimx = s.dimx",
    DIVSUM_CTE + f",\nc1 AS (SELECT * FROM d WHERE {CK_SQL}),\n" + sql_zero_cte("c1")))
def dataset_difference(spark, sf):
    """R-14: the bridge against its sanity-filtered copy."""
    b = bridge(spark, sf)
    s = chain_9d().apply(derive.divsum(b, BASE))
    return report.dataset_difference(b.select("dimx", "efi_GB", "efe_GB"), s.select("dimx", "efi_GB", "efe_GB"))


# fixed values: scale and leading role of each transport column, as the rules have them
_FAMILIES = {"efiITG_GB": ("ITG", True, True), "efeITG_GB": ("ITG", True, True), "efeTEM_GB": ("TEM", True, True), "efiTEM_GB": ("TEM", True, True),
             "efeETG_GB": ("ETG", True, True), "pfeITG_GB": ("ITG", True, False), "pfeTEM_GB": ("TEM", True, False), "efe_GB": ("unknown", True, True),
             "efi_GB": ("unknown", True, True)}


@register("name_family_stats", with_bridge(" UNION ALL ".join(
    f"SELECT '{c}' AS name, '{mode}' AS mode_scale, {leading} AS is_leading, {heat} AS is_pure_heat, CAST(count({c}) AS BIGINT) AS n, round(sum({c}), 6) AS total FROM bridge"
    for c, (mode, leading, heat) in _FAMILIES.items())))
def name_family_stats(spark, sf):
    """F catalogue as a job: unpivot transport columns to (dimx, name, value), classify the
    distinct names with the Spark-expression catalogue, join back and aggregate per name."""
    from ..functions.name_columns import name_catalog
    b = bridge(spark, sf)
    cols = N.columns_where(b.columns, N.is_transport)
    long = b.unpivot("dimx", cols, "name", "value")
    # the catalogue has one row per column name: its size is bounded by the schema width
    cat = name_catalog(spark.createDataFrame([(c,) for c in cols], "name string")).select(
        "name", "mode_scale", "is_leading", "is_pure_heat")
    j = long.join(F.broadcast(cat), "name")
    return j.groupBy("name", "mode_scale", "is_leading", "is_pure_heat").agg(
        F.count("value").cast("bigint").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@register("axis_values", with_bridge(
    "SELECT DISTINCT CAST(Ati AS VARCHAR) AS value, CAST(CAST(Ati AS VARCHAR) AS DOUBLE) AS numeric FROM bridge"))
def axis_values(spark, sf):
    """R-13: distinct axis values as strings in numeric order."""
    return report.sorted_axis_values(bridge(spark, sf), "Ati")
