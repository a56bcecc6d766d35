"""Registered queries for composed jobs (M) and the streaming form of the row-local curation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import jobs
from ..sources.store import load_dataset
from .checks import bridge, register, sql_ieee_div, with_bridge
from .curation_checks import (AMBI0_SQL, AMBI1_SQL, BASE, CK_SQL, CURATED_SQL_CTES, DIVSUM_CTE, FEMTO_SQL, NEG_COLS, REGIME_SQL, ROT_FEATS,
                              SEPTOT_SQL, _div_sql, _gate_sql, dedupe_points, sql_abs_lt, sql_zero_cte)
from .slice_checks import MODE_COLS, _breakdown_ctes
from ..operators import masks

MD5 = "md5(concat_ws('|', '42', CAST(dimx AS VARCHAR)))"
SETS_CTE = ("t AS (SELECT s.*, row_number() OVER (ORDER BY " + MD5 + ", dimx) <= "
            "CAST(floor(1e-1 * count(*) OVER ()) AS BIGINT) AS is_test FROM s)")


@register("job_curation_sets", with_bridge(
    "SELECT dimx, is_test, " + ", ".join(f"{_gate_sql(c)} AS {c}" for c in ["efiITG_GB", "efeTEM_GB"]) + ", "
    + _div_sql("efeITG_GB_div_efiITG_GB", *masks.DIV_BOUNDS_9D["efeITG_GB_div_efiITG_GB"])
    .replace("efeITG_GB_div_efiITG_GB", "(" + _gate_sql("efeITG_GB_div_efiITG_GB") + ")")
    + " AS efeITG_GB_div_efiITG_GB FROM t", CURATED_SQL_CTES + ",\n" + SETS_CTE))
def job_curation_sets(spark, sf):
    """M-02 with the 9-D preset: sane set (materialised once), exact 10% test split, masks."""
    res = jobs.curate(bridge(spark, sf), preset=jobs.PRESET_9D)
    return res.sets.select("dimx", "is_test", "efiITG_GB", "efeTEM_GB", "efeITG_GB_div_efiITG_GB")


def _yield_sql():
    steps = [("cke", "d", sql_abs_lt("cke", "50e0")), ("cki", "c1", "TRUE"), ("septot", "z", SEPTOT_SQL),
             ("ambipolar", "z", f"{SEPTOT_SQL} AND {AMBI0_SQL}"), ("femtoflux", "z", f"{SEPTOT_SQL} AND {AMBI0_SQL} AND {FEMTO_SQL}"),
             ("regime", "z", f"{SEPTOT_SQL} AND {AMBI0_SQL} AND {FEMTO_SQL} AND {REGIME_SQL}")]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS step, {i + 1} AS step_no, count(*) AS rows_left FROM {src} WHERE {cond}"
                              for i, (n, src, cond) in enumerate(steps))
    return with_bridge("SELECT step, step_no, CAST(rows_left AS BIGINT) AS rows_left, round(rows_left * 100e0 / (SELECT count(*) FROM d), 6) "
                       f"AS pct_left FROM ({rows})", DIVSUM_CTE + f",\nc1 AS (SELECT * FROM d WHERE {CK_SQL}),\n" + sql_zero_cte("c1"))


@register("job_yield_report", _yield_sql())
def job_yield_report(spark, sf):
    """M-02 yield: R-01 including the regime step."""
    return jobs.curate(bridge(spark, sf), preset=jobs.PRESET_9D, materialize=False).report


@register("stream_curated_rows", with_bridge(
    "SELECT dimx, efi_GB, efe_GB, " + ", ".join(BASE) + " FROM k", CURATED_SQL_CTES))
def stream_curated_rows(spark, sf):
    """Row-local curation as a Structured Streaming query over the bridge written as files
    (available-now trigger), read back from the Parquet sink."""
    from ..streaming.curate_stream import start
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    b = bridge(spark, sf)
    b.write.parquet(f"{base}/in")
    q = start(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", b.schema, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("dimx", "efi_GB", "efe_GB", *BASE)


def _set_flag(src: str) -> str:
    return (f"SELECT s.*, row_number() OVER (ORDER BY {MD5}, dimx) <= CAST(floor(1e-1 * count(*) OVER ()) AS BIGINT) AS is_test FROM {src} s")


def _zeroed(src: str, keep: str) -> str:
    neg = "NOT (" + " AND ".join(f"COALESCE({c} >= 0, FALSE)" for c in NEG_COLS) + ")"
    return f"SELECT {keep}, " + ", ".join(f"CASE WHEN {neg} THEN 0e0 ELSE {c} END AS {c}" for c in NEG_COLS) + f" FROM {src}"


_KEEP = "dimx, scan_id, Ati, absambi, cke, cki, ITG, TEM, ETG, pfeITG_GB, pfeTEM_GB"
_RATIO = "efeITG_GB_div_efiITG_GB"
_AFTER = f"{{septot}} AND {AMBI0_SQL} AND {FEMTO_SQL}"


def _edge6_sql():
    ctes, outs = _breakdown_ctes()
    names = [c for cols in MODE_COLS.values() for c in cols]
    rest = "dimx, scan_id, Ati, absambi, cke, cki, ITG, TEM, ETG, efe_GB, efi_GB"
    gate = lambda c: f"(CASE WHEN COALESCE(ITG, FALSE) THEN {c} END)"
    return with_bridge(
        f"SELECT dimx, is_test, {gate('efiITG_GB')} AS efiITG_GB, "
        + _div_sql("r", *masks.DIV_BOUNDS_9D[_RATIO]) + f" AS {_RATIO} FROM (SELECT *, {sql_ieee_div(gate('efeITG_GB'), gate('efiITG_GB'))} AS r FROM t)",
        ctes + f",\nbd AS (SELECT {rest}, {outs} FROM c),\nck AS (SELECT * FROM bd WHERE {CK_SQL}),\n"
        + f"z AS ({_zeroed('ck', _KEEP)}),\nok AS (SELECT * FROM z WHERE " + _AFTER.format(septot=SEPTOT_SQL.replace("1.5e0", "50e0"))
        + f"),\nt AS ({_set_flag('ok')})") if names else None


@register("job_edge6_sets", _edge6_sql())
def job_edge6_sets(spark, sf):
    """M-03: slice breakdown before the chain, ratios after the split."""
    b = bridge(spark, sf).drop("c")
    return jobs.edge6_job(b, slice_features=["scan_id"], sliced_dim="Ati").select("dimx", "is_test", "efiITG_GB", _RATIO)


@register("job_edge8_sets", with_bridge(
    "SELECT dimx, is_test, CASE WHEN COALESCE(ITG, FALSE) THEN efiITG_GB END AS efiITG_GB, "
    f"CASE WHEN COALESCE(ITG, FALSE) THEN {_RATIO} END AS {_RATIO} FROM t",
    DIVSUM_CTE + ",\nfull_rows AS (SELECT * FROM d WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in BASE) + "),\n"
    + sql_zero_cte("full_rows") + f",\nok AS (SELECT * FROM z WHERE {SEPTOT_SQL} AND {AMBI1_SQL} AND {FEMTO_SQL}),\nt AS ({_set_flag('ok')})"))
def job_edge8_sets(spark, sf):
    """M-05: incomplete rows dropped before the chain; no convergence bounds, the second ambipolarity rule."""
    return jobs.edge8_job(bridge(spark, sf)).select("dimx", "is_test", "efiITG_GB", _RATIO)


@register("job_gen2_sets", with_bridge(
    "SELECT dimx, is_test, CASE WHEN COALESCE(ITG, FALSE) THEN efiITG_GB END AS efiITG_GB, CASE WHEN gg <> 0 THEN efeETG_GB END AS efeETG_GB, "
    "CASE WHEN gl <> 0 THEN efi_GB END AS efi_GB FROM t",
    "b2 AS (SELECT *, CAST(c % 4 AS DOUBLE) / 1e1 AS gl, CAST(c % 3 AS DOUBLE) / 1e1 AS gg FROM bridge),\nok AS (SELECT * FROM b2 WHERE "
    + " AND ".join(f"COALESCE({c} >= 0, FALSE)" for c in NEG_COLS) + f" AND {CK_SQL} AND {SEPTOT_SQL} AND {AMBI0_SQL} AND {FEMTO_SQL} "
    "AND efe_GB < 100e0 AND efi_GB < 100e0 AND efe_GB >= 0 AND efi_GB >= 0),\n" + f"t AS ({_set_flag('ok')})"))
def job_gen2_sets(spark, sf):
    """M-06."""
    b = bridge(spark, sf).withColumn("gam_leq_GB", (F.col("c") % 4).cast("double") / 10.0) \
        .withColumn("gam_great_GB", (F.col("c") % 3).cast("double") / 10.0)
    return jobs.gen2_job(b).select("dimx", "is_test", "efiITG_GB", "efeETG_GB", "efi_GB")


@register("job_split_dims", with_bridge(
    "SELECT dimx, 6 AS dims, efi_GB FROM bridge WHERE abs(Nustar - 1e-3) <= 1e-5 + 1e-3 * 1e-3 UNION ALL "
    "SELECT dimx, 3, efi_GB FROM bridge WHERE abs(Nustar - 1e-3) <= 1e-5 + 1e-3 * 1e-3 AND abs(Ate - 5e0) <= 1e-5 + 1e-3 * 5e0 "
    "AND abs(An - 2e0) <= 1e-5 + 1e-3 * 2e0 AND abs(x - 4e-1) <= 1e-5 + 1e-3 * 4e-1"))
def job_split_dims(spark, sf):
    """G-04: the sub-dimension sets written as stores and read back."""
    b = bridge(spark, sf)
    inp = b.select("dimx", "Ati", "Ate", "An", "q", "x", "Machtor", "Nustar")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dims-{uuid.uuid4().hex}"
    folders = jobs.split_dims(inp, b.select("dimx", "efi_GB"), [{"Nustar": 1e-3}, {"Ate": 5.0, "An": 2.0, "x": 0.4}], base)
    sets = [load_dataset(spark, f, ["efi_GB"]).data.withColumn("dims", F.lit(int(f.rsplit("/", 1)[1][:-1]))) for f in folders]
    return sets[0].unionByName(sets[1]).select("dimx", "dims", "efi_GB")


@register("job_rotation_sets", with_bridge(
    "SELECT dimx, is_test, CASE WHEN e0 = 0 THEN 0e0 ELSE efeITG_GB / e0 END AS efeITG_GB_div_efeITG_GB_rot0 FROM t",
    "one AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY Ati, Ate, An, q, x, Nustar, Machtor ORDER BY dimx) AS rn FROM bridge) WHERE rn = 1),\n"
    f"ck AS (SELECT * FROM one WHERE {CK_SQL}),\nz AS ({_zeroed('ck', _KEEP + ', Ate, An, q, x, Nustar, Machtor')}),\n"
    f"ok AS (SELECT * FROM z WHERE {SEPTOT_SQL} AND {AMBI1_SQL} AND {FEMTO_SQL} AND efe_GB < 100e0 AND efi_GB < 100e0 AND efe_GB >= 0 AND efi_GB >= 0),\n"
    "rot AS (SELECT *, max(CASE WHEN Machtor = 0 THEN efeITG_GB END) OVER (PARTITION BY Ati, Ate, An, q, x, Nustar) AS e0 FROM ok),\n"
    f"t AS ({_set_flag('rot')})"))
def job_rotation_sets(spark, sf):
    """M-01: targets relative to the point without rotation, after the chain (such names carry no stability gate)."""
    b = dedupe_points(bridge(spark, sf), ROT_FEATS)
    return jobs.rotation_job(b, features=ROT_FEATS).select("dimx", "is_test", "efeITG_GB_div_efeITG_GB_rot0")
