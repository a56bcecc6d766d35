"""Composed curation jobs (2.M) with presets.

Each job is a plain function composing the operators into one lazy plan; the only
materialisation is where a result is re-used (the sane set feeds both splits), and
it goes to the shared checkpoint folder.  Arguments are keyword-only, so the
shifted-positional mistakes of the original scripts cannot happen; presets carry
the intended values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF
from ..operators import derive, filters, masks, report, split
from ..session import cut_lineage


@dataclass(frozen=True)
class SanityPreset:
    septot_factor: float = 1.5
    ambi_bound: float = 1.5
    femto_bound: float = 1e-4
    cke_bound: float = INF
    cki_bound: float = INF
    ambipolar_version: int = 1


@dataclass(frozen=True)
class JobPreset:
    sanity: SanityPreset
    regime: tuple[float, float] | None = None
    div_bounds: dict = field(default_factory=dict)
    divnames: tuple = tuple(derive.DIV_NAMES_BASE)
    test_fraction: float = 0.1


# fixed values: presets of the reference's jobs
PRESET_9D = JobPreset(SanityPreset(1.5, 1.5, 1e-4, 50.0, 50.0, 0), (0.0, 100.0 / 3.0), masks.DIV_BOUNDS_9D)
ROTATION = JobPreset(SanityPreset(1.5, 1.5, 1e-4, 50.0, 50.0, 1), (0.0, 100.0), masks.DIV_BOUNDS_9D)
EDGE6 = JobPreset(SanityPreset(50.0, 1.5, 1e-4, 50.0, 50.0, 0), None, masks.DIV_BOUNDS_9D)
EDGE7 = JobPreset(SanityPreset(1.5, 1.5, 1e-4, 50.0), None, {})
EDGE8 = JobPreset(SanityPreset(1.5, 1.5, 1e-4), None, {})
GEN2 = JobPreset(SanityPreset(1.5, 1.5, 1e-4, 50.0, 50.0, 0), (0.0, 100.0), {})


@dataclass
class CurationResult:
    sane: DataFrame              # filtered points (before the split)
    report: DataFrame            # R-01 yield per step
    breakdown: DataFrame         # R-02 on the sane set
    sets: DataFrame              # sane points with ``is_test`` and masked targets


def curate(points: DataFrame, *, preset: JobPreset = PRESET_9D, key: str = "dimx", seed=42,
           materialize: bool = True) -> CurationResult:
    """M-02 / M-05 core: ratio targets, sanity chain, regime, split, stability and ratio masks."""
    d = derive.divsum(points, list(preset.divnames), skip_missing=True)
    s = preset.sanity
    chain = filters.sanity_chain(s.septot_factor, s.ambi_bound, s.femto_bound, cke_bound=s.cke_bound,
                                 cki_bound=s.cki_bound, ambipolar_version=s.ambipolar_version)
    if preset.regime is not None:
        geq, less = preset.regime
        chain.steps.append(filters.Step("regime", filters.regime_ok(geq, less)))
    rep = report.yield_report(d, chain, key)
    sane = chain.apply(d, key)
    if materialize:
        sane = cut_lineage(sane)   # re-used by the breakdown and both sets
    br = report.stability_breakdown(sane)
    sets = split.test_flag(sane, preset.test_fraction, seed=seed, key=key)
    sets = masks.div_bounds_mask(masks.stability_mask(sets), preset.div_bounds)
    return CurationResult(sane, rep, br, sets)


def write_sets(res: CurationResult, path: str) -> None:
    """M-01 / M-02 tail: the sets as one Parquet table partitioned by ``is_test`` (partition
    pruning replaces the separate files of the original)."""
    res.sets.withColumn("set", F.when(F.col("is_test"), "test").otherwise("train")).write.mode("overwrite") \
        .partitionBy("set").parquet(path)


def grid_to_store(modes: DataFrame, ions: DataFrame, points: DataFrame, scan_dims, path: str, *, gen2: bool = False, ion: int = 0,
                  axis: tuple | None = None, style: str = "both") -> DataFrame:
    """M-07 / B-21: the prepared grid (:func:`prepare_grid`) as a store: scan dims as inputs under the row-major cell
    index (B-03), everything else as outputs, constants as attributes.  ``axis``: ``modes`` holds arrays along an inner
    coordinate ``(name, values)``, values as for :func:`grid.unfold_arrays`, which are unfolded first (B-02).  Returns the stored points."""
    from ..operators import grid
    from ..sources import store
    scan_dims = list(scan_dims)
    if axis is not None:
        name, values = axis
        arrays = [c for c, t in modes.dtypes if t.startswith("array")]
        modes = grid.unfold_arrays(modes, [c for c in modes.columns if c not in arrays], name, values, arrays)
    rest, _growth, consts = prepare_grid(modes, ions, points, scan_dims, gen2=gen2, ion=ion)
    indexed = cut_lineage(grid.axis_index(rest, scan_dims))
    store.save_dataset(store.Dataset(indexed.select("dimx", *scan_dims), indexed.drop(*scan_dims), consts), path, style=style)
    return indexed


def _sane(points: DataFrame, preset: JobPreset) -> DataFrame:
    """The preset's sanity chain and regime, materialised (it feeds several outputs)."""
    q = preset.sanity
    chain = filters.sanity_chain(q.septot_factor, q.ambi_bound, q.femto_bound, cke_bound=q.cke_bound, cki_bound=q.cki_bound,
                                 ambipolar_version=q.ambipolar_version)
    if preset.regime is not None:
        chain.steps.append(filters.Step("regime", filters.regime_ok(*preset.regime)))
    return cut_lineage(chain.apply(points))


def _simulator_points(points: DataFrame) -> DataFrame:
    from ..operators import grid
    return grid.remove_rotation(grid.drop_si(points))


def rotation_job(points: DataFrame, *, features, preset: JobPreset = ROTATION, key: str = "dimx", seed=42) -> DataFrame:
    """M-01: sanity and regime, targets relative to the point without rotation (E-04), split, D-01, D-03."""
    sets = split.test_flag(derive.rotdiv(_sane(points, preset), list(features)), preset.test_fraction, seed=seed, key=key)
    return masks.div_bounds_mask(masks.stability_mask(sets), preset.div_bounds)


def edge6_job(points: DataFrame, *, slice_features, sliced_dim: str = "At", preset: JobPreset = EDGE6,
              modes=("ITG", "TEM", "ETG"), patience: int = 6, key: str = "dimx", seed=42) -> DataFrame:
    """M-03: unit copies and rotation fluxes dropped, slice breakdown (D-05), sanity, split, D-01, then E-01 and D-03."""
    from ..operators import slices
    d = slices.breakdown_mask(_simulator_points(points), list(slice_features), sliced_dim, modes=modes, patience=patience, key=key)
    sets = masks.stability_mask(split.test_flag(_sane(d, preset), preset.test_fraction, seed=seed, key=key))
    return masks.div_bounds_mask(derive.divsum(sets, list(preset.divnames), skip_missing=True), preset.div_bounds)


def edge7_job(points: DataFrame, *, slice_features, sliced_dim: str = "At", preset: JobPreset = EDGE7,
              modes=("ITG", "TEM", "ETG"), patience: int = 6, key: str = "dimx", seed=42) -> DataFrame:
    """M-04: E-01 before the sanity chain, slice breakdown after it, then split and D-01."""
    from ..operators import slices
    d = _sane(derive.divsum(_simulator_points(points), list(preset.divnames), skip_missing=True), preset)
    d = slices.breakdown_mask(d, list(slice_features), sliced_dim, modes=modes, patience=patience, key=key)
    return masks.stability_mask(split.test_flag(d, preset.test_fraction, seed=seed, key=key))


def edge8_job(points: DataFrame, *, preset: JobPreset = EDGE8, key: str = "dimx", seed=42) -> DataFrame:
    """M-05: repeated rows dropped, E-01, incomplete rows dropped (C-16), sanity, split, D-01."""
    prepared = cut_lineage(derive.divsum(points.dropDuplicates(), list(preset.divnames), skip_missing=True))   # the saved copy
    d = filters.drop_nulls(prepared)
    return masks.stability_mask(split.test_flag(_sane(d, preset), preset.test_fraction, seed=seed, key=key))


def gen2_job(points: DataFrame, *, preset: JobPreset = GEN2, key: str = "dimx", seed=42) -> DataFrame:
    """M-06: the gen2 chain (row filters only), regime, split, masks from growth rates (D-02)."""
    q = preset.sanity
    chain = filters.sanity_chain_gen2(q.cke_bound, q.septot_factor, q.ambi_bound, q.femto_bound)
    chain.steps.append(filters.Step("regime", filters.regime_ok(*preset.regime)))
    return masks.growth_stability_mask(split.test_flag(cut_lineage(chain.apply(points)), preset.test_fraction, seed=seed, key=key))


def split_dims(inp: DataFrame, data: DataFrame, levels: list[dict[str, float]], path: str, key: str = "dimx") -> list[str]:
    """G-04: the nested sub-dimension sets (all but the largest) as stores ``<path>/<n features>D``, with the
    outputs of their points and the sliced values as constants."""
    from ..sources import store
    out = []
    for ids, features, consts in split.nested_split(inp, levels, key):
        folder = f"{path}/{len(features.columns) - 1}D"
        store.save_dataset(store.Dataset(features, data.join(ids, key, "left_semi"), consts), folder)
        out.append(folder)
    return out


def prepare_grid(modes: DataFrame, ions: DataFrame, points: DataFrame, scan_dims, *, gen2: bool = False, ion: int = 0):
    """B-28 / B-29: growth rates and flags (B-10, B-11; gen2 B-12), ion densities where they are missing (B-14),
    ambipolarity (B-15; gen2 B-16), merged (B-01), particle fluxes and pinches where their parts are there (B-18, B-19),
    rotation fluxes and unit copies dropped, growth rates apart (B-22), one ion (B-05), constant columns apart (B-06; targets
    and flags stay).  Each join is written before the next one: all are by point, so that one task would hold the sorted
    sides of every join at once.  Returns (points, growth rates, constants)."""
    from ..functions import names as N
    from ..operators import grid
    scan_dims = list(scan_dims)
    if "normni" not in ions.columns:
        ions = cut_lineage(grid.with_densities(ions, points, scan_dims))
    flags = (grid.stability_flags_gen2 if gen2 else grid.stability_flags)(modes, scan_dims)
    balance = cut_lineage(grid.ambipolarity(ions, points, scan_dims, absolute=gen2, strict=gen2))
    merged = cut_lineage(grid.merge_groups(flags, balance, scan_dims, dedupe=False))
    merged = grid.merge_groups(merged, grid.pick_ion(ions, ion), scan_dims, dedupe=False)
    full = cut_lineage(_simulator_points(grid.sum_pinches(grid.fill_particle_fluxes(merged, always=gen2))))
    kept = [c for c in full.columns if N.is_transport(c) or N.is_growth(c) or c in ("ITG", "TEM", "ETG", "absambi")]
    rest, consts = grid.metadatize(full, [c for c in full.columns if c not in scan_dims], keep=kept)
    return rest, modes.select(*scan_dims, *[c for c in ("kthetarhos", "numsols", "gam_GB", "ome_GB") if c in modes.columns]), consts


def thinning_job(df: DataFrame, settings: str, path: str, *, key: str = "dimx") -> DataFrame:
    """H-08: the settings document at ``settings`` (A-19) names the dims and the loop's bounds; its columns are chosen (A-24),
    rows with missing or infinite ones dropped (C-17), the set thinned (H-07) and the kept rows stored, features as one table and
    each target as its own (A-23).  Returns the kept rows."""
    from ..operators import thin
    from ..sources import store
    got = store.read_settings(df.sparkSession, settings).first().asDict()
    known = {f for f in thin.ThinSettings.__dataclass_fields__ if f in got and got[f] is not None}
    s = thin.ThinSettings(**{f: got[f] for f in known})
    targets = [c for c in got.get("targets") or [] if c not in s.dims]
    chosen = store.select_dims(df, [key, *s.dims, *targets], got.get("format"))
    s.num_dim = s.num_dim or len(s.dims)
    chosen = cut_lineage(filters.finite_rows(chosen, s.dims))
    kept = cut_lineage(thin.two_step_thinning(chosen, s, key))
    store.save_dataset(store.Dataset(kept.select(key, *s.dims), kept.select(key, *targets) if targets else None, None), path, style="sep", key=key)
    return kept
