"""Per-column masks (2.D): null one target, keep the row.

All masks are a single projection: ``select(*[when(keep, c).alias(c)])`` so that a
mask over ~50 targets is one codegen'd expression list, not 50 ``withColumn``.
The slice breakdown mask (D-05) needs a window and lives in ``slices.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.numeric import INF, is_finite, true_or_false


def _flag(name: str) -> Column:
    return true_or_false(F.col(name))


def _replace(df: DataFrame, repl: dict[str, Column]) -> DataFrame:
    return df.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in df.columns])


def stability_gate(col: str) -> Column | None:
    """D-01 rule for one column: which flags must hold for the value to stay."""
    cls = N.stability_class(col)
    if cls in ("TEM", "ITG", "ETG"):
        return _flag(cls)
    if cls == "ion":
        return _flag("ITG") | _flag("TEM")
    if cls == "multi":
        return _flag("ITG") | _flag("TEM") | _flag("ETG")
    return None


def stability_mask(df: DataFrame) -> DataFrame:
    """D-01: null each transport column unless the matching instability flag is set."""
    repl = {}
    for c in df.columns:
        gate = stability_gate(c)
        if gate is not None:
            repl[c] = F.when(gate, F.col(c))
    return _replace(df, repl)


def growth_stability_mask(df: DataFrame, leq: str = "gam_leq_GB", great: str = "gam_great_GB") -> DataFrame:
    """D-02 (gen2 / gen4): gates from growth rates instead of flags.

    ion-scale -> ``gam_leq != 0``; ETG -> ``gam_great != 0``; electron heat without
    mode -> either (only ``leq`` when ``great`` is absent); TEM / ITG -> their flags.
    """
    has_great = great in df.columns
    ion_unstable = true_or_false(F.col(leq) != 0)
    etg_unstable = true_or_false(F.col(great) != 0) if has_great else F.lit(False)
    repl = {}
    for c in df.columns:
        if not N.is_transport(c):
            continue
        head = N.parse(c).parts[0]  # combined names are classified by their first part
        if head.mode == "TEM":
            gate = _flag("TEM")
        elif head.mode == "ITG":
            gate = _flag("ITG")
        elif head.mode == "ETG":
            gate = etg_unstable
        elif head.transp in N.HEAT and head.species == "e":
            gate = (ion_unstable | etg_unstable) if has_great else ion_unstable
        else:
            gate = ion_unstable
        repl[c] = F.when(gate, F.col(c))
    return _replace(df, repl)


def div_bounds_mask(df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None,
                    zero_clause: bool = True, abs_families: bool = False) -> DataFrame:
    """D-03: keep a ratio only when ``low < v < high``; 0 also passes when the range excludes 0.

    Names are matched exactly (the store-name prefix bug of the original is not kept).
    ``abs_families`` compares ``|v|`` for particle / momentum ratios (documented, off by default).
    """
    repl = {}
    for name, (low, high) in (bounds or {}).items():
        if name not in df.columns:
            continue
        v = F.col(name)
        if abs_families and (N.is_partial_particle(name) or N.is_partial_momentum(name)):
            v = F.abs(v)
        keep = (F.lit(low) < v) & (v < F.lit(high))
        if zero_clause and (low > 0.0 or high < 0.0):
            keep = keep | (v == 0.0)
        repl[name] = F.when(true_or_false(keep), F.col(name))
    return _replace(df, repl)


def null_by_ids(df: DataFrame, ids: DataFrame, columns, key: str = "dimx") -> DataFrame:
    """D-06: null ``columns`` on rows whose id is listed (the row itself survives)."""
    flagged = ids.select(F.col(key), F.lit(True).alias("__hit")).dropDuplicates([key])
    j = df.join(flagged, key, "left")
    repl = {c: F.when(F.col("__hit").isNull(), F.col(c)) for c in columns}
    return _replace(j, repl).drop("__hit").select(*df.columns)


def finite_mask(df: DataFrame, columns=None) -> DataFrame:
    """D-07: null inf / -inf / NaN values of the chosen (default: transport) columns."""
    cols = columns if columns is not None else N.columns_where(df.columns, N.is_transport)
    return _replace(df, {c: F.when(is_finite(F.col(c)), F.col(c)) for c in cols})


# fixed values: ratio bound presets (D-03) of the reference's jobs
DIV_BOUNDS_UNBOUNDED = {n: (-INF, INF) for n in [
    "efeITG_GB_div_efiITG_GB", "pfeITG_GB_div_efiITG_GB", "efiTEM_GB_div_efeTEM_GB", "pfeTEM_GB_div_efeTEM_GB",
    "dfeITG_GB_div_efiITG_GB", "dfiITG_GB_div_efiITG_GB", "vceITG_GB_div_efiITG_GB", "vciITG_GB_div_efiITG_GB",
    "vteITG_GB_div_efiITG_GB", "vtiITG_GB_div_efiITG_GB", "dfeTEM_GB_div_efeTEM_GB", "dfiTEM_GB_div_efeTEM_GB",
    "vceTEM_GB_div_efeTEM_GB", "vciTEM_GB_div_efeTEM_GB", "vteTEM_GB_div_efeTEM_GB", "vtiTEM_GB_div_efeTEM_GB"]}
DIV_BOUNDS_9D = {
    "efeITG_GB_div_efiITG_GB": (0.05, 1.5),
    "pfeITG_GB_div_efiITG_GB": (0.02, 0.6),
    "efiTEM_GB_div_efeTEM_GB": (0.05, 2.0),
    "pfeTEM_GB_div_efeTEM_GB": (0.03, 0.8),
    "dfeITG_GB_div_efiITG_GB": (0.02, INF),
    "dfiITG_GB_div_efiITG_GB": (0.15, INF),
    "vceITG_GB_div_efiITG_GB": (-INF, INF),
    "vciITG_GB_div_efiITG_GB": (0.1, INF),
    "vteITG_GB_div_efiITG_GB": (0.02, INF),
    "vtiITG_GB_div_efiITG_GB": (-INF, INF),
    "dfeTEM_GB_div_efeTEM_GB": (0.10, INF),
    "dfiTEM_GB_div_efeTEM_GB": (0.05, INF),
    "vceTEM_GB_div_efeTEM_GB": (0.07, INF),
    "vciTEM_GB_div_efeTEM_GB": (-INF, INF),
    "vteTEM_GB_div_efeTEM_GB": (-INF, INF),
    "vtiTEM_GB_div_efeTEM_GB": (-INF, INF),
}
