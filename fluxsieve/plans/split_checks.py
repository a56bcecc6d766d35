"""Registered queries for splits, sampling and dimension reduction (G) and rank trims (C-20/21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split
from .checks import bridge, register, with_bridge

MD5 = "md5(concat_ws('|', '42', CAST(dimx AS VARCHAR)))"


@register("test_split", with_bridge(
    "SELECT dimx, (rn <= CAST(floor(1e-1 * n) AS BIGINT)) AS is_test FROM "
    f"(SELECT dimx, row_number() OVER (ORDER BY {MD5}, dimx) AS rn, count(*) OVER () AS n FROM bridge)"))
def test_split(spark, sf):
    """G-05: exact-count reproducible test flag."""
    return split.test_flag(bridge(spark, sf).select("dimx"), 0.1, seed=42)


@register("train_val_test", with_bridge(
    "SELECT dimx, CASE WHEN rn <= kt THEN 'test' WHEN rn <= kt + kv THEN 'validation' ELSE 'train' END AS set FROM "
    f"(SELECT dimx, row_number() OVER (ORDER BY {MD5}, dimx) AS rn, "
    "CAST(floor(1e-1 * count(*) OVER ()) AS BIGINT) AS kt, CAST(floor(5e-2 * count(*) OVER ()) AS BIGINT) AS kv "
    "FROM bridge)"))
def train_val_test(spark, sf):
    """G-06 / G-07: test, validation, train sets with exact sizes."""
    return split.train_val_test(bridge(spark, sf).select("dimx"), 0.05, 0.1, seed=42).select("dimx", "set")


@register("minibatch", with_bridge(
    "SELECT dimx, CAST(('0x' || substr(md5(concat_ws('|', '42', '3', CAST(dimx AS VARCHAR))), 1, 8))::BIGINT % 10 "
    "AS BIGINT) AS batch FROM bridge"))
def minibatch(spark, sf):
    """G-08: minibatch index for epoch 3 of 10 batches."""
    b = bridge(spark, sf)
    return b.select("dimx", split.minibatch(b, 10, epoch=3, seed=42).cast("bigint").alias("batch"))


@register("head_sample", with_bridge("SELECT dimx, efi_GB FROM bridge ORDER BY dimx LIMIT 4000"))
def head_sample(spark, sf):
    """G-10: first rows by id (sampling operator; the limit is the feature)."""
    return split.head_sample(bridge(spark, sf).select("dimx", "efi_GB"), 4000)


@register("join_cast", with_bridge(
    "SELECT i.dimx, CAST(i.Ati AS FLOAT) AS Ati, CAST(i.Ate AS FLOAT) AS Ate, CAST(t.efiITG_GB AS FLOAT) AS efiITG_GB "
    "FROM (SELECT dimx, Ati, Ate FROM bridge WHERE Ati > 10e0) i "
    "JOIN (SELECT dimx, efiITG_GB FROM bridge WHERE efiITG_GB > 0e0) t ON i.dimx = t.dimx"))
def join_cast(spark, sf):
    """G-11 + G-12: inner join of features to targets, cast to float32."""
    b = bridge(spark, sf)
    inp = b.select("dimx", "Ati", "Ate").filter("Ati > 10")
    tgt = b.select("dimx", "efiITG_GB").filter("efiITG_GB > 0")
    return split.cast_float(split.join_features_targets(inp, tgt))


@register("constant_slices", with_bridge(
    "SELECT dimx, Ati, q, Machtor, 7 AS dims FROM bridge WHERE abs(Nustar - 1e-3) <= 1e-5 + 1e-3 * abs(1e-3) "
    "UNION ALL SELECT dimx, Ati, q, Machtor, 4 FROM bridge WHERE abs(Nustar - 1e-3) <= 1e-5 + 1e-3 * abs(1e-3) "
    "AND abs(Ate - 5e0) <= 1e-5 + 1e-3 * 5e0 AND abs(An - 2e0) <= 1e-5 + 1e-3 * 2e0 "
    "AND abs(x - 4e-1) <= 1e-5 + 1e-3 * 4e-1"))
def constant_slices(spark, sf):
    """G-01, G-02, G-03: nested 7-D and 4-D constant slices, sliced features dropped."""
    inp = bridge(spark, sf).select("dimx", "Ati", "Ate", "An", "q", "x", "Machtor", "Nustar")
    levels = split.nested_split(inp, [{"Nustar": 1e-3}, {"Ate": 5.0, "An": 2.0, "x": 0.4}])
    (_i7, f7, _c7), (_i4, f4, _c4) = levels
    return f7.select("dimx", "Ati", "q", "Machtor", F.lit(7).alias("dims")).unionByName(
        f4.select("dimx", "Ati", "q", "Machtor", F.lit(4).alias("dims")))


@register("outlier_trim_rank", with_bridge(
    "SELECT dimx FROM (SELECT dimx, row_number() OVER (ORDER BY efiITG_GB, efeITG_GB, dimx) - 1 AS r, "
    "count(*) OVER () AS n FROM bridge) WHERE r >= floor(n * 5e-2) AND r < floor(n * 9e-1)"))
def outlier_trim_rank(spark, sf):
    """C-20: rank-based trim on the lexicographic order of two targets."""
    b = bridge(spark, sf).select("dimx", "efiITG_GB", "efeITG_GB")
    return split.outlier_trim_rank(b, ["efiITG_GB", "efeITG_GB"], above=0.9, below=0.05).select("dimx")


@register("outlier_trim_quantile", with_bridge(
    "SELECT dimx, a AS efiITG_GB, b AS efeTEM_GB FROM ("
    "SELECT dimx, CASE WHEN a1 > (SELECT quantile_cont(a1, 0.1) FROM s1) THEN a1 END AS a, "
    "CASE WHEN b1 > (SELECT quantile_cont(b1, 0.1) FROM s1) THEN b1 END AS b FROM s1) WHERE a IS NOT NULL "
    "AND b IS NOT NULL",
    "s1 AS (SELECT dimx, CASE WHEN efiITG_GB < (SELECT quantile_cont(efiITG_GB, 0.9) FROM bridge) THEN efiITG_GB END "
    "AS a1, CASE WHEN efeTEM_GB < (SELECT quantile_cont(efeTEM_GB, 0.9) FROM bridge) THEN efeTEM_GB END AS b1 "
    "FROM bridge)"))
def outlier_trim_quantile(spark, sf):
    """C-21: quantile-based trim per column, then drop rows with missing values."""
    b = bridge(spark, sf).select("dimx", "efiITG_GB", "efeTEM_GB")
    return split.outlier_trim_quantile(b, ["efiITG_GB", "efeTEM_GB"], above=0.9, below=0.1)


@register("slice_fraction", with_bridge(
    "SELECT dimx FROM bridge WHERE CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(scan_id AS VARCHAR))), 1, 8))"
    "::BIGINT AS DOUBLE) / 4294967296e0 < 2e-1"))
def slice_fraction(spark, sf):
    """G-16: a reproducible 20% of whole slices."""
    return split.slice_fraction(bridge(spark, sf), ["scan_id"], 0.2, seed=42).select("dimx")
