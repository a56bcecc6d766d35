"""Registered queries for stores (A): every query writes the bridge-derived dataset into the
shared checkpoint folder and reads it back through the store API."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import store as ST
from ..sources.bridge import FEATURES
from .checks import bridge, register, with_bridge

TG = ["efiITG_GB", "efeITG_GB", "efeTEM_GB"]


def _saved(spark, sf, style="both", mask_nulls=True):
    b = bridge(spark, sf)
    data = b.select("dimx", *[F.when(F.col("ITG") | (F.lit(c) != "efiITG_GB"), F.col(c)).alias(c) for c in TG]) \
        if mask_nulls else b.select("dimx", *TG)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    const = spark.createDataFrame([("Zeff", "1.0"), ("nions", "0")], "name string, value string")
    ST.save_dataset(ST.Dataset(b.select("dimx", *FEATURES), data, const), path, style=style)
    return path


@register("store_flat_columns", with_bridge(
    "SELECT dimx, CASE WHEN ITG THEN efiITG_GB END AS efiITG_GB, efeTEM_GB FROM bridge"))
def store_flat_columns(spark, sf):
    """A-02 / A-12 / A-13: save both layouts, load two targets (the wide table is chosen)."""
    ds = ST.load_dataset(spark, _saved(spark, sf), ["efiITG_GB", "efeTEM_GB"])
    return ds.data


@register("store_separate_bare", with_bridge(
    "SELECT dimx, CASE WHEN ITG THEN efiITG_GB END AS efiITG_GB, efeITG_GB FROM bridge"))
def store_separate_bare(spark, sf):
    """A-14 / A-10: separate columns (nulls dropped on save) reindexed to the input ids."""
    path = _saved(spark, sf, style="sep")
    # efeITG_GB has every id; the first column must match the input exactly
    ds = ST.load_dataset(spark, path, ["efeITG_GB", "efiITG_GB"], mode="bare", prefer_flat=False)
    return ds.data


@register("store_separate_concat", with_bridge(
    "SELECT dimx, CASE WHEN ITG THEN efiITG_GB END AS efiITG_GB, efeTEM_GB FROM bridge"))
def store_separate_concat(spark, sf):
    """A-06: separate columns glued with outer alignment (one pivot, not n joins)."""
    ds = ST.load_dataset(spark, _saved(spark, sf, style="sep"), ["efiITG_GB", "efeTEM_GB"], mode="concat",
                         prefer_flat=False)
    return ds.data


@register("store_separate_inner", with_bridge(
    "SELECT dimx, efiITG_GB, efeTEM_GB FROM bridge WHERE ITG"))
def store_separate_inner(spark, sf):
    """A-07: ``mode='join'``, ``how='inner'``."""
    ds = ST.load_dataset(spark, _saved(spark, sf, style="sep"), ["efiITG_GB", "efeTEM_GB"], mode="join",
                         how="inner", prefer_flat=False)
    return ds.data


@register("store_input_lognustar", with_bridge(
    "SELECT dimx, Ati, log10(Nustar) AS logNustar FROM bridge"))
def store_input_lognustar(spark, sf):
    """A-02 input group with B-27 (``Nustar`` -> ``logNustar``)."""
    ds = ST.load_dataset(spark, _saved(spark, sf), False)
    return ds.input.select("dimx", "Ati", "logNustar")


@register("store_column_map", with_bridge(
    "SELECT name, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'efiITG_GB' AS name FROM bridge WHERE ITG "
    "UNION ALL SELECT 'efeITG_GB' FROM bridge UNION ALL SELECT 'efeTEM_GB' FROM bridge) GROUP BY name"))
def store_column_map(spark, sf):
    """A-04 / A-05: stored separate names and their non-null counts."""
    path = _saved(spark, sf, style="sep")
    names = ST.filter_column_map(ST.column_map(spark, path), TG)
    long = spark.read.parquet(f"{path}/output").filter(F.col("name").isin(names))
    return long.groupBy("name").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("dataset_names", with_bridge(
    "SELECT DISTINCT 'gen' || CAST(CAST(q AS INTEGER) AS VARCHAR) || '_' || CAST(CAST(Ate AS INTEGER) AS VARCHAR) "
    "|| 'D_set' || CAST(CAST(An AS INTEGER) AS VARCHAR) || '_filter' || CAST(CAST(x * 10 AS INTEGER) AS VARCHAR) AS name, "
    "CAST(q AS INTEGER) AS gen, CAST(Ate AS INTEGER) AS dim, 'set' || CAST(CAST(An AS INTEGER) AS VARCHAR) AS dataset, "
    "CAST(x * 10 AS INTEGER) AS filter_id FROM bridge"))
def dataset_names(spark, sf):
    """A-17 / A-18: names built from data columns and parsed back with one regex."""
    b = bridge(spark, sf)
    name = F.concat(F.lit("gen"), F.col("q").cast("int").cast("string"), F.lit("_"),
                    F.col("Ate").cast("int").cast("string"), F.lit("D_set"), F.col("An").cast("int").cast("string"),
                    F.lit("_filter"), (F.col("x") * 10).cast("int").cast("string"))
    d = b.select(name.alias("name")).distinct()
    p = ST.parse_dataset_name(F.col("name"))
    return d.select("name", p["gen"].alias("gen"), p["dim"].alias("dim"), p["dataset"].alias("dataset"),
                    p["filter_id"].alias("filter_id"))


@register("threshold_store", with_bridge(
    "SELECT b.dimx, b.Ati, t.thresh AS efiITG_thresh FROM bridge b JOIN (SELECT scan_id, "
    "min(CASE WHEN efiITG_GB > 0 THEN Ati END) AS thresh FROM bridge GROUP BY scan_id HAVING thresh IS NOT NULL) t "
    "ON b.scan_id = t.scan_id"))
def threshold_store(spark, sf):
    """A-22: input rows with a threshold, joined to the leading-flux threshold."""
    from ..operators import weights as W
    b = bridge(spark, sf)
    t = W.expand_thresholds(b.select("dimx", "scan_id"), W.thresholds(b, ["scan_id"], "Ati", "efiITG_GB"),
                            ["scan_id"]).filter(F.col("thresh").isNotNull()).select("dimx", "thresh")
    return ST.combine_input_threshold(b.select("dimx", "Ati"), t, "ITG")


@register("glue_runs", with_bridge(
    "SELECT dimx, Ati, efiITG_GB, NULL::DOUBLE AS efeTEM_GB FROM bridge WHERE q <= 3 "
    "UNION ALL SELECT dimx, Ati, NULL::DOUBLE, efeTEM_GB FROM bridge WHERE q > 3"))
def glue_runs(spark, sf):
    """A-01: two run files with different columns glued along the point dimension."""
    b = bridge(spark, sf)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    b.filter("q <= 3").select("dimx", "Ati", "efiITG_GB", "cke").write.parquet(f"{base}/run1")
    b.filter("q > 3").select("dimx", "Ati", "efeTEM_GB", "cki").write.parquet(f"{base}/run2")
    return ST.glue_runs(spark, [f"{base}/run1", f"{base}/run2"], drop_columns=["cke", "cki"])
