"""Gridded simulator output to point rows (2.B).

The gridded set arrives in long form: one row per (scan point, inner dims), e.g.
``(<scan dims>, kthetarhos, numsols, gam_GB, ome_GB)`` and per ion
``(<scan dims>, nions, pfi_GB, normni, Zi)``.  Reductions over the inner dims are
one ``groupBy(<scan dims>)`` each with conditional aggregates (partial aggregation
map-side, one shuffle keyed by the scan point), never a pivot to wide arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.numeric import safe_div

ROTATION_COLUMNS = ["vfiTEM_GB", "vfiITG_GB", "vriTEM_GB", "vriITG_GB"]


def growth_rates(modes: DataFrame, scan_dims, k: str = "kthetarhos", gam: str = "gam_GB", bound: float = 2.0,
                 skip_first_above: bool = False) -> DataFrame:
    """B-09: ``gam_leq_GB`` = max growth rate over numsols and ``k <= bound``; ``gam_great_GB``
    = max over ``k > bound`` (absent when no wavenumber lies above the bound).

    ``skip_first_above=True`` reproduces the gen4 indexing, which leaves out the first
    wavenumber above the bound.
    """
    above = modes.filter(F.col(k) > bound).agg(F.min(k).alias("m")).first()["m"]
    aggs = [F.max(F.when(F.col(k) <= bound, F.col(gam))).alias("gam_leq_GB")]
    if above is not None:
        cond = F.col(k) > bound
        if skip_first_above:
            cond = cond & (F.col(k) != F.lit(above))
        aggs.append(F.max(F.when(cond, F.col(gam))).alias("gam_great_GB"))
    return modes.groupBy(*scan_dims).agg(*aggs)


def stability_flags(modes: DataFrame, scan_dims, k: str = "kthetarhos", gam: str = "gam_GB", ome: str = "ome_GB",
                    bound: float = 2.0, skip_first_above: bool = False) -> DataFrame:
    """B-09 + B-11 in one grouped pass:
    ``TEM = gam_leq != 0 AND any(ome > 0)``, ``ITG = gam_leq != 0 AND any(ome < 0)`` over
    ``k <= bound`` and all solutions."""
    above = modes.filter(F.col(k) > bound).agg(F.min(k).alias("m")).first()["m"]
    low = F.col(k) <= bound
    aggs = [F.max(F.when(low, F.col(gam))).alias("gam_leq_GB"),
            F.bool_or(low & (F.col(ome) > 0)).alias("__pos"),
            F.bool_or(low & (F.col(ome) < 0)).alias("__neg")]
    if above is not None:
        cond = F.col(k) > bound
        if skip_first_above:
            cond = cond & (F.col(k) != F.lit(above))
        aggs.append(F.max(F.when(cond, F.col(gam))).alias("gam_great_GB"))
    g = modes.groupBy(*scan_dims).agg(*aggs)
    unstable = F.coalesce(F.col("gam_leq_GB") != 0, F.lit(False))
    out = g.withColumn("TEM", unstable & F.coalesce(F.col("__pos"), F.lit(False))) \
        .withColumn("ITG", unstable & F.coalesce(F.col("__neg"), F.lit(False)))
    if "gam_great_GB" in out.columns:
        out = out.withColumn("ETG", F.coalesce(F.col("gam_great_GB") != 0, F.lit(False)))  # B-13 (inferred)
    return out.drop("__pos", "__neg")


def stability_flags_gen2(modes: DataFrame, scan_dims, k: str = "kthetarhos", gam: str = "gam_GB", ome: str = "ome_GB",
                         bound: float = 2.0) -> DataFrame:
    """B-12: as B-11, but growth and direction must meet at one wavenumber: ``TEM`` if at some
    ``k <= bound`` the largest growth rate is not 0 and some solution has ``ome > 0`` (``ITG``: ``< 0``)."""
    per_k = modes.groupBy(*scan_dims, k).agg(
        F.max(gam).alias("__gam"), F.bool_or(F.col(ome) > 0).alias("__pos"), F.bool_or(F.col(ome) < 0).alias("__neg"))
    low = F.col(k) <= bound
    live = F.coalesce(low & (F.col("__gam") != 0), F.lit(False))
    return per_k.groupBy(*scan_dims).agg(
        F.max(F.when(low, F.col("__gam"))).alias("gam_leq_GB"), F.max(F.when(F.col(k) > bound, F.col("__gam"))).alias("gam_great_GB"),
        F.coalesce(F.bool_or(live & F.col("__pos")), F.lit(False)).alias("TEM"),
        F.coalesce(F.bool_or(live & F.col("__neg")), F.lit(False)).alias("ITG"))


def ion_densities(Z0: Column, Z1: Column, Zeff: Column) -> tuple[Column, Column]:
    """B-14: two-ion normalised densities from Zeff."""
    n1 = (Zeff - Z0) / (Z1 * Z1 - Z1 * Z0)
    n0 = (F.lit(1.0) - Z1 * n1) / Z0
    return n0, n1


def with_densities(ions: DataFrame, points: DataFrame, scan_dims) -> DataFrame:
    """B-14 where ``normni`` is missing: the densities of the two ions of each point from their charges and its ``Zeff``;
    a third ion is an error."""
    charge = lambda k: F.max(F.when(F.col("nions") == k, F.col("Zi")))
    both = ions.groupBy(*scan_dims).agg(charge(0).alias("__z0"), charge(1).alias("__z1")).join(points.select(*scan_dims, "Zeff"), list(scan_dims))
    n0, n1 = ion_densities(F.col("__z0"), F.col("__z1"), F.col("Zeff"))
    third = F.raise_error(F.lit("densities follow from Zeff for two ions only")).cast("double")
    return ions.join(both.select(*scan_dims, n0.alias("__n0"), n1.alias("__n1")), list(scan_dims), "left") \
        .withColumn("normni", F.when(F.col("nions") == 0, F.col("__n0")).when(F.col("nions") == 1, F.col("__n1")).otherwise(third)).drop("__n0", "__n1")


def ambipolarity(ions: DataFrame, points: DataFrame, scan_dims, absolute: bool = False, strict: bool = False) -> DataFrame:
    """B-15 / B-16: ``absambi = sum_ions(pfi * normni * Zi) / pfe``; 1 where ``pfe == 0``.

    ``ions`` has one row per (point, ion); ``points`` carries ``pfe_GB``.  The ion sum is a
    partial aggregate before the join, so only one row per point is shuffled to it.  ``strict`` (gen2): a missing
    result where ``pfe`` is not 0 is an error.
    """
    s = ions.groupBy(*scan_dims).agg(F.sum(F.col("pfi_GB") * F.col("normni") * F.col("Zi")).alias("__s"))
    j = points.join(s, list(scan_dims), "left")
    val = safe_div(F.col("__s"), F.col("pfe_GB"))
    if absolute:
        val = F.abs(val)
    if strict:
        val = F.coalesce(val, F.raise_error(F.lit("no ambipolarity where the electron flux is not 0")).cast("double"))
    return j.withColumn("absambi", F.when(F.col("pfe_GB") == 0, F.lit(1.0)).otherwise(val)).drop("__s")


def sum_pf(df_: Column, vt: Column, vc: Column, An: Column, vr: Column | None = None) -> Column:
    """B-17: particle flux from diffusivity and pinches: ``df*An + vt + vr + vc``."""
    return df_ * An + vt + (vr if vr is not None else F.lit(0.0)) + vc


def fill_particle_fluxes(df: DataFrame, An: str = "An", always: bool = False) -> DataFrame:
    """B-18: ``pf<s><mode>_GB`` from its parts for e / i x ITG / TEM (``vr`` ions only),
    only when the column is missing (gen2: always)."""
    new = {}
    for s in ("e", "i"):
        for m in ("ITG", "TEM"):
            name = f"pf{s}{m}_GB"
            parts = {p: f"{p}{s}{m}_GB" for p in ("df", "vt", "vc", "vr")}
            if (name in df.columns and not always) or any(
                    parts[p] not in df.columns for p in ("df", "vt", "vc")):
                continue
            vr = F.col(parts["vr"]) if (s == "i" and parts["vr"] in df.columns) else None
            new[name] = sum_pf(F.col(parts["df"]), F.col(parts["vt"]), F.col(parts["vc"]), F.col(An), vr)
    return df.withColumns(new) if new else df


def sum_pinches(df: DataFrame) -> DataFrame:
    """B-19: ``vae = vte + vce``, ``vai = vti + vci (+ vri)`` for modes '', ITG, TEM."""
    new = {}
    for m in ("", "ITG", "TEM"):
        if f"vte{m}_GB" in df.columns and f"vce{m}_GB" in df.columns:
            new[f"vae{m}_GB"] = F.col(f"vte{m}_GB") + F.col(f"vce{m}_GB")
        if f"vti{m}_GB" in df.columns and f"vci{m}_GB" in df.columns:
            v = F.col(f"vti{m}_GB") + F.col(f"vci{m}_GB")
            if f"vri{m}_GB" in df.columns:
                v = v + F.col(f"vri{m}_GB")
            new[f"vai{m}_GB"] = v
    return df.withColumns(new) if new else df


def axis_index(df: DataFrame, dims) -> DataFrame:
    """B-03: row-major linear cell index ``dimx = sum(pos_i * stride_i)`` from the grid axes.

    Each axis is the table of one dim's distinct values with their places, broadcast where it is small, joined otherwise.
    """
    from .slices import join_positions
    sizes, out = [], df
    for d in dims:
        out, n = join_positions(out, d, f"__p_{d}")
        sizes.append(n)
    strides, acc = [], 1
    for n in reversed(sizes):
        strides.append(acc)
        acc *= n
    strides = list(reversed(strides))
    idx = reduce(lambda a, b: a + b, [F.col(f"__p_{d}").cast("long") * F.lit(s) for d, s in zip(dims, strides)])
    return out.withColumn("dimx", idx).drop(*[f"__p_{d}" for d in dims])


def unfold_arrays(df: DataFrame, point_cols, coord: str, coord_values, array_cols) -> DataFrame:
    """B-02: one row per (point, inner coordinate) from per-point ``ARRAY`` columns.

    ``coord_values`` is a short list of the coordinate's values in order, or an axis of any length as
    ``(table, length)`` from :func:`slices.axis_positions`.
    """
    from .slices import values_at
    zipped = F.arrays_zip(*[F.col(c) for c in array_cols])
    e = df.select(*point_cols, F.posexplode(zipped).alias("__i", "__v"))
    if isinstance(coord_values, tuple):
        e = values_at(e.withColumn("__i", F.col("__i").cast("long")), "__i", *coord_values, coord)
        value = F.col(coord)
    else:
        value = F.element_at(F.array(*[F.lit(v) for v in coord_values]), F.col("__i") + 1).alias(coord)
    return e.select(*point_cols, value, *[F.col(f"__v.{c}").alias(c) for c in array_cols])


def keep_hypercube(df: DataFrame, scan_dims, allowed_extra=()) -> DataFrame:
    """B-04: drop columns that are neither scan dims nor point variables (inner-dim columns)."""
    inner = {"kthetarhos", "numsols", "nions", "ecoefs", "dimn"} - set(allowed_extra)
    return df.select(*[c for c in df.columns if c not in inner])


def pick_ion(df: DataFrame, ion: int = 0, col: str = "nions") -> DataFrame:
    """B-05: keep one ion, drop the dimension."""
    return df.filter(F.col(col) == ion).drop(col)


def metadatize(df: DataFrame, columns=None, keep=()) -> tuple[DataFrame, DataFrame]:
    """B-06: move constant columns to a ``(name, value)`` constants table.  A column is constant if it has one value in
    every row, or none in any; one value beside missing ones is data.  Columns in ``keep`` (targets, flags) stay."""
    cols = [c for c in columns or df.columns if c not in keep]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (
        F.count(c).alias(f"c{i}"), (F.min(c) == F.max(c)).alias(f"s{i}"), F.min(c).cast("string").alias(f"v{i}"))]).first()
    const = [(c, row[f"v{i}"]) for i, c in enumerate(cols) if row["n"] and (row[f"c{i}"] == 0 or (row[f"s{i}"] and row[f"c{i}"] == row["n"]))]
    return df.drop(*[c for c, _ in const]), df.sparkSession.createDataFrame(const, "name string, value string")


def drop_si(df: DataFrame) -> DataFrame:
    """B-07: drop every column ending in ``_SI``."""
    return df.drop(*[c for c in df.columns if c.endswith("_SI")])


def remove_rotation(df: DataFrame) -> DataFrame:
    """B-08: drop the rotation fluxes (absent is fine)."""
    return df.drop(*[c for c in ROTATION_COLUMNS if c in df.columns])


def drop_growth(df: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """B-22: split off ``gam_GB, ome_GB`` as their own set (keyed like the main set)."""
    g = [c for c in ("gam_GB", "ome_GB") if c in df.columns]
    return df.drop(*g), df.select(*keys, *g)


def merge_groups(a: DataFrame, b: DataFrame, scan_dims, dedupe: bool = True) -> DataFrame:
    """B-01 / B-23: full outer merge of two variable groups on the scan dims, duplicate
    rows dropped and duplicate-named columns taken from the left."""
    extra = [c for c in b.columns if c not in a.columns or c in scan_dims]
    j = a.join(b.select(*extra), list(scan_dims), "full")
    return j.dropDuplicates() if dedupe else j


def nearest_ids(df: DataFrame, targets: list[float], key: str = "dimx") -> DataFrame:
    """B-24: rows whose id is nearest to each target (ties to the lower id).

    One aggregate finds, per target, the closest id at or below and at or above it
    (2 x len(targets) conditional min / max in a single scan, no join of points to
    targets); the chosen ids (<= len(targets)) then select their rows.
    """
    aggs = []
    for i, t in enumerate(targets):
        aggs += [F.max(F.when(F.col(key) <= t, F.col(key))).alias(f"lo{i}"),
                 F.min(F.when(F.col(key) >= t, F.col(key))).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    chosen = set()
    for i, t in enumerate(targets):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        cands = [x for x in (lo, hi) if x is not None]
        if cands:
            chosen.add(min(cands, key=lambda x: (abs(x - t), x)))
    return df.filter(F.col(key).isin(sorted(chosen)))


def equality_slice(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """B-25: exact-equality slice, sliced dims dropped."""
    cond = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in values.items()])
    return df.filter(cond).drop(*values)


def rotation_ratios_grid(df: DataFrame, scan_dims, rotdim: str = "Machtor") -> DataFrame:
    """B-20: per transport column, value at ``rotdim = 0`` divided by the value (0 where the value is 0)."""
    from .derive import rotdiv
    return rotdiv(df, list(scan_dims), rotvar=rotdim, rot_over_norot=False,
                  columns=N.columns_where(df.columns, N.is_transport))
