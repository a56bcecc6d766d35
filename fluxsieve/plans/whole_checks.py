"""Registered queries for the name catalogue (F), whole jobs (M-04, M-07, B-28, B-29, H-08) and the remaining parts
of the stores, filters, splits and training aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.name_columns import name_catalog
from ..operators import filters, grid, report, score as S, slices, thin, train as T
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import store as ST
from . import jobs
from .checks import bridge, register, sql_ieee_div, with_bridge
from .curation_checks import AMBI1_SQL, BASE, DIVSUM_CTE, FEMTO_SQL, ROT_FEATS, SEPTOT_SQL, dedupe_points, sql_abs_lt, sql_zero_cte
from .grid_checks import IONS_SQL, MODES_SQL, POINTS_SQL, ions, modes, points
from .jobs_checks import SETS_CTE, _set_flag
from .score_checks import NET_A, SQL_A
from .slice_checks import MODE_COLS, _breakdown_ctes
from .thin_checks import COLUMNS, RUNS, _PASSES, SETTINGS, columns_apart


def _folder(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ names (F)

# fixed values: names, their parts and operations, and what every rule says of them
NAMES = {
    "pfe_GB": ["pfe_GB"], "pfeETG_SI": ["pfeETG_SI"], "efe_GB": ["efe_GB"], "chiee_GB": ["chiee_GB"], "gam_GB": ["gam_GB"],
    "pfeITG_SI_div_efeETG_GB": ["pfeITG_SI", "_div_", "efeETG_GB"], "pfeITG_SI_div_pfeTEM_GB": ["pfeITG_SI", "_div_", "pfeTEM_GB"],
    "efe_GB_plus_efiITG_GB": ["efe_GB", "_plus_", "efiITG_GB"], "efeTEM_GB_plus_efiTEM_GB": ["efeTEM_GB", "_plus_", "efiTEM_GB"],
    "efeTEM_GB_plus_efi_GB": ["efeTEM_GB", "_plus_", "efi_GB"], "efeITG_GB_plus_efiITG_GB": ["efeITG_GB", "_plus_", "efiITG_GB"],
    "efeITG_GB_plus_efi_GB": ["efeITG_GB", "_plus_", "efi_GB"], "efeETG_GB_plus_efiETG_GB": ["efeETG_GB", "_plus_", "efiETG_GB"],
    "efeETG_GB_plus_efi_GB": ["efeETG_GB", "_plus_", "efi_GB"],
    "efiITG_GB_fake_chiei_GB_triple_pfe_SI": ["efiITG_GB", "_fake_", "chiei_GB", "_triple_", "pfe_SI"],
    "vriITG_GB": ["vriITG_GB"], "vfiTEM_GB": ["vfiTEM_GB"], "dfeETG_GB": ["dfeETG_GB"],
    "efeITG_GB_div_efiITG_GB": ["efeITG_GB", "_div_", "efiITG_GB"], "pfiITG_GB_div_efiITG_GB": ["pfiITG_GB", "_div_", "efiITG_GB"],
    "gam_leq_GB": None, "efeITG_GB_div_efeITG_GB_rot0": None,
}
FIELDS = {
    "pfe_GB": ("pf", "e", "", "GB"), "pfeETG_SI": ("pf", "e", "ETG", "SI"), "efe_GB": ("ef", "e", "", "GB"), "chiee_GB": ("chie", "e", "", "GB"),
    "gam_GB": ("ga", "m", "", "GB"), "vriITG_GB": ("vr", "i", "ITG", "GB"), "vfiTEM_GB": ("vf", "i", "TEM", "GB"), "dfeETG_GB": ("df", "e", "ETG", "GB"),
}
HEAT = {"efe_GB", "chiee_GB", "efe_GB_plus_efiITG_GB", "efeTEM_GB_plus_efiTEM_GB", "efeTEM_GB_plus_efi_GB", "efeITG_GB_plus_efiITG_GB",
        "efeITG_GB_plus_efi_GB", "efeETG_GB_plus_efiETG_GB", "efeETG_GB_plus_efi_GB", "efeITG_GB_div_efiITG_GB"}
RULES = {
    "is_pure": set(FIELDS),
    "is_flux": {n for n, p in NAMES.items() if p} - {"chiee_GB", "gam_GB", "vriITG_GB", "dfeETG_GB", "efiITG_GB_fake_chiei_GB_triple_pfe_SI"},
    "is_transport": {n for n, p in NAMES.items() if p} - {"gam_GB"},
    "is_pure_flux": {"pfe_GB", "pfeETG_SI", "efe_GB", "vfiTEM_GB"},
    "is_growth": {"gam_leq_GB"},
    "contains_sep": set(NAMES) - {"pfe_GB", "efe_GB", "chiee_GB", "gam_GB", "gam_leq_GB"},
    "is_full_transport": {"pfe_GB", "efe_GB", "chiee_GB"},
    "is_pure_diffusion": {"vriITG_GB", "dfeETG_GB"},
    "is_pure_heat": HEAT,
    "is_pure_particle": {"pfe_GB", "pfeETG_SI", "pfeITG_SI_div_pfeTEM_GB", "vriITG_GB", "dfeETG_GB"},
    "is_pure_rot": {"vriITG_GB"},
    "is_pure_momentum": {"vfiTEM_GB"},
    "is_partial_diffusion": {"vriITG_GB", "dfeETG_GB"},
    "is_partial_heat": HEAT | {"pfeITG_SI_div_efeETG_GB", "efiITG_GB_fake_chiei_GB_triple_pfe_SI", "pfiITG_GB_div_efiITG_GB"},
    "is_partial_particle": {"pfe_GB", "pfeETG_SI", "pfeITG_SI_div_efeETG_GB", "pfeITG_SI_div_pfeTEM_GB", "vriITG_GB", "dfeETG_GB",
                            "efiITG_GB_fake_chiei_GB_triple_pfe_SI", "pfiITG_GB_div_efiITG_GB"},
    "is_partial_rot": {"vriITG_GB"},
    "is_partial_momentum": {"vfiTEM_GB"},
    "is_ion_scale": {"pfeITG_SI_div_pfeTEM_GB", "efeTEM_GB_plus_efiTEM_GB", "efeITG_GB_plus_efiITG_GB", "vriITG_GB", "vfiTEM_GB",
                     "efeITG_GB_div_efiITG_GB", "pfiITG_GB_div_efiITG_GB"},
    "is_electron_scale": {"pfeETG_SI", "efeETG_GB_plus_efiETG_GB", "dfeETG_GB"},
    "is_multi_scale": {"pfe_GB", "efe_GB", "chiee_GB", "pfeITG_SI_div_efeETG_GB", "efe_GB_plus_efiITG_GB", "efeTEM_GB_plus_efi_GB",
                       "efeITG_GB_plus_efi_GB", "efeETG_GB_plus_efi_GB", "efiITG_GB_fake_chiei_GB_triple_pfe_SI"},
    "is_leading": {"pfe_GB", "efe_GB", "chiee_GB", "pfeETG_SI", "efeETG_GB_plus_efiETG_GB", "efeETG_GB_plus_efi_GB", "vriITG_GB", "vfiTEM_GB",
                   "dfeETG_GB", "efiITG_GB_fake_chiei_GB_triple_pfe_SI", "efeITG_GB_div_efiITG_GB"},
}
MODE_OF = {"TEM": {"efeTEM_GB_plus_efiTEM_GB", "vfiTEM_GB"},
           "ITG": {"efeITG_GB_plus_efiITG_GB", "vriITG_GB", "efeITG_GB_div_efiITG_GB", "pfiITG_GB_div_efiITG_GB"},
           "ETG": {"pfeETG_SI", "efeETG_GB_plus_efiETG_GB", "dfeETG_GB"}}


def _text(x) -> str:
    return "NULL" if x is None else f"'{x}'"


def _catalogue_rows() -> str:
    rows = []
    for n, p in NAMES.items():
        mode = next((m for m, names in MODE_OF.items() if n in names), "unknown")
        gradient = {"TEM": "Ate", "ETG": "Ate", "ITG": "Ati"}.get(mode, "")
        cells = [_text(n), *[_text(None if p is None else "|".join(x)) for x in (p, (p or [])[::2], (p or [])[1::2])],
                 *[_text(x) for x in FIELDS.get(n, (None,) * 4)], *[str(n in names).upper() for names in RULES.values()], _text(mode), _text(gradient)]
        rows.append(f"({', '.join(cells)})")
    return ", ".join(rows)


_AT = "list_extract([" + ", ".join(f"'{n}'" for n in NAMES) + f"], CAST(c % {len(NAMES)} AS INTEGER) + 1)"


@register("name_catalogue", with_bridge(
    f"SELECT r.*, CAST(b.n AS BIGINT) AS n FROM (SELECT {_AT} AS name, count(*) AS n FROM bridge GROUP BY 1) b JOIN (VALUES {_catalogue_rows()}) "
    f"r(name, parts, part_names, operations, transp, species, mode, norm, {', '.join(RULES)}, mode_scale, driving_gradients) USING (name)"))
def name_catalogue(spark, sf):
    """F-01..F-21: every column of the catalogue over the names that occur, against expectations written out."""
    at = (F.col("c") % len(NAMES)).cast("int") + 1
    found = bridge(spark, sf).groupBy(F.element_at(F.array(*[F.lit(x) for x in NAMES]), at).alias("name")).agg(F.count("*").cast("bigint").alias("n"))
    cat = name_catalog(found)
    joined = [F.array_join(c, "|").alias(c) for c in ("parts", "part_names", "operations")]
    return cat.select("name", "n", *joined, "transp", "species", "mode", "norm", *RULES, "mode_scale", F.array_join("driving_gradients", "|").alias("driving_gradients"))


# ------------------------------------------------------------------ stores (A)

@register("store_separate_assign", with_bridge("SELECT dimx, efiITG_GB, CASE WHEN TEM THEN efeTEM_GB END AS efeTEM_GB FROM bridge WHERE ITG"))
def store_separate_assign(spark, sf):
    """A-08: ``assign`` aligns the other columns to the rows of the first."""
    b, path = bridge(spark, sf), _folder(spark, "store")
    data = b.select("dimx", F.when(F.col("ITG"), F.col("efiITG_GB")).alias("efiITG_GB"), F.when(F.col("TEM"), F.col("efeTEM_GB")).alias("efeTEM_GB"))
    ST.save_dataset(ST.Dataset(None, data, None), path, style="sep")
    return ST.load_dataset(spark, path, ["efiITG_GB", "efeTEM_GB"], mode="assign", load_input=False, load_const=False, prefer_flat=False).data


@register("store_legacy_prefix", with_bridge("SELECT dimx, log10(Nustar) AS logNustar, efi_GB FROM bridge"))
def store_legacy_prefix(spark, sf):
    """A-11: all groups of a store below one prefix."""
    b, path = bridge(spark, sf), _folder(spark, "store")
    ST.save_dataset(ST.Dataset(b.select("dimx", "Nustar"), b.select("dimx", "efi_GB", "efe_GB"), None), path, prefix="/megarun1")
    ds = ST.load_dataset(spark, path, "efi_GB", prefix="/megarun1")
    return ds.input.join(ds.data, "dimx").select("dimx", "logNustar", "efi_GB")


@register("store_manifest", with_bridge(
    "SELECT 'output' AS kind, 'efiITG_GB' AS name, CAST(count(*) AS BIGINT) AS rows, 'double' AS type FROM bridge WHERE ITG UNION ALL "
    "SELECT 'output', 'efe_GB', count(*), 'double' FROM bridge UNION ALL SELECT 'input', 'Ati', count(*), 'double' FROM bridge"))
def store_manifest(spark, sf):
    """A-04: what a store holds, as its manifest says."""
    b, path = bridge(spark, sf), _folder(spark, "store")
    data = b.select("dimx", F.when(F.col("ITG"), F.col("efiITG_GB")).alias("efiITG_GB"), "efe_GB")
    ST.save_dataset(ST.Dataset(b.select("dimx", "Ati"), data, None), path, style="sep")
    return ST.read_manifest(spark, path).select("kind", "name", "rows", "type")


@register("glue_catalogued_runs", with_bridge(
    "SELECT dimx, 'run' || CAST(CAST(q AS INTEGER) AS VARCHAR) AS run, CASE WHEN q <= 3 THEN efiITG_GB END AS efiITG_GB, CASE WHEN q > 3 THEN efeTEM_GB END AS efeTEM_GB "
    "FROM bridge"))
def glue_catalogued_runs(spark, sf):
    """A-01: run files of two schemas, glued by their manifest: one scan a schema."""
    b, base = bridge(spark, sf), _folder(spark, "runs")
    levels = [r[0] for r in b.select("q").distinct().orderBy("q").limit(100).collect()]            # a run each
    ST.save_runs({f"run{int(q)}": b.filter(F.col("q") == q).select("dimx", "cke", "efiITG_GB" if q <= 3 else "efeTEM_GB") for q in levels}, base)
    out = ST.glue_runs(spark, base, drop_columns=["cke"], with_source=True)
    return out.select("dimx", F.regexp_extract("source_file", "/(run[0-9]+)/", 1).alias("run"), "efiITG_GB", "efeTEM_GB")


_SET_NAMES = ["", "sane", "test", "training"]


@register("dataset_names_built", with_bridge(
    "SELECT DISTINCT CASE WHEN ITG THEN 'unstable_' ELSE '' END || CASE WHEN s <> '' THEN s || '_' ELSE '' END || 'gen' || CAST(g AS VARCHAR) || '_' || CAST(d AS VARCHAR) "
    "|| 'D_nions0_filter' || CAST(f AS VARCHAR) AS name, ITG AS unstable, s AS \"set\", g AS gen, d AS dim, f AS filter_id FROM (SELECT ITG, list_extract(["
    + ", ".join(f"'{s}'" for s in _SET_NAMES) + "], CAST(c % 4 AS INTEGER) + 1) AS s, CAST(q AS INTEGER) AS g, CAST(Ate AS INTEGER) AS d, CAST(An AS INTEGER) AS f FROM bridge)"))
def dataset_names_built(spark, sf):
    """A-18: names built from their parts, and read back (A-17) to the same parts."""
    kind = F.element_at(F.array(*[F.lit(s) for s in _SET_NAMES]), (F.col("c") % 4).cast("int") + 1)
    name = ST.dataset_names(F.col("q").cast("int"), F.col("Ate").cast("int"), F.lit("nions0"), F.col("An").cast("int"), kind, F.col("ITG"))
    p = ST.parse_dataset_name(F.col("name"))
    return bridge(spark, sf).select(name.alias("name")).distinct().select("name", *[p[k].alias(k) for k in ("unstable", "set", "gen", "dim", "filter_id")])


@register("settings_documents", with_bridge(
    "SELECT CAST(q AS INTEGER) AS generation, round(max(Ati), 3) AS upper, CAST(count(*) AS BIGINT) AS points, 'efi_GB' AS target FROM bridge GROUP BY q"))
def settings_documents(spark, sf):
    """A-19: one settings document per run, written as JSON over several lines and read back as rows."""
    path = _folder(spark, "settings")
    runs = bridge(spark, sf).groupBy("q").agg(F.round(F.max("Ati"), 3).alias("upper"), F.count("*").alias("points"))
    doc = F.to_json(F.struct(F.col("q").cast("int").alias("generation"), "upper", "points", F.array(F.lit("efi_GB")).alias("train_dims")))
    runs.select(F.regexp_replace(doc, ",", ",\n").alias("value")).repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(path)
    got = ST.read_settings(spark, path)
    return got.select(F.col("generation").cast("int").alias("generation"), "upper", F.col("points").cast("bigint").alias("points"),
                      F.col("train_dims")[0].alias("target"))


@register("csv_export", with_bridge(" UNION ALL ".join(
    f"SELECT '{c}' AS name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM bridge" for c in ("efi_GB", "efe_GB", "Ati"))))
def csv_export(spark, sf):
    """A-21 / R-04: the standardization table as a CSV file, read back."""
    path = _folder(spark, "csv")
    ST.export_csv(report.standardization_table(bridge(spark, sf), ["efi_GB", "efe_GB", "Ati"], decimals=2), path)
    return spark.read.option("header", True).schema("name string, mean double, std double").csv(path)


# ------------------------------------------------------------------ filters and splits (C, G)

@register("filters_by_name", with_bridge(
    f"SELECT dimx FROM bridge WHERE {sql_abs_lt('cke', '50e0')} AND {sql_abs_lt('cki', '20e0')} AND {SEPTOT_SQL} AND {AMBI1_SQL} AND {FEMTO_SQL} "
    "AND efe_GB >= 0e0 AND efi_GB >= 0e0 AND efe_GB < 2e1 AND efi_GB < 2e1"))
def filters_by_name(spark, sf):
    """C-19: a chain named by strings, with defaults, own bounds and several arguments."""
    chain = {"cke": 50.0, "cki": 20.0, "septot": None, "ambipolar": None, "femtoflux": None, "regime": (0.0, 20.0)}
    return filters.apply_named(bridge(spark, sf), chain).select("dimx")


@register("written_sets", with_bridge("SELECT dimx, CASE WHEN is_test THEN 'test' ELSE 'train' END AS \"set\", efi_GB FROM t",
                                      "s AS (SELECT dimx, efi_GB FROM bridge),\n" + SETS_CTE))
def written_sets(spark, sf):
    """G-06: test and training set written, one folder each, and read back."""
    from ..operators.split import test_flag
    b, path = bridge(spark, sf).select("dimx", "efi_GB"), _folder(spark, "sets")
    jobs.write_sets(jobs.CurationResult(b, None, None, test_flag(b, 0.1)), path)
    return spark.read.parquet(path).select("dimx", "set", "efi_GB")


# ------------------------------------------------------------------ grid (B, M-07)

@register("grid_rotation_ratios", with_bridge(
    "SELECT dimx, CASE WHEN efi_GB = 0 THEN 0e0 ELSE b / efi_GB END AS efi_GB_rot0_div_efi_GB FROM (SELECT *, max(CASE WHEN Machtor = 0 THEN efi_GB END) OVER "
    "(PARTITION BY Ati, Ate, An, q, x, Nustar) AS b FROM (SELECT *, row_number() OVER (PARTITION BY Ati, Ate, An, q, x, Nustar, Machtor ORDER BY dimx) AS rn FROM bridge) WHERE rn = 1)"))
def grid_rotation_ratios(spark, sf):
    """B-20."""
    b = dedupe_points(bridge(spark, sf), ROT_FEATS).select("dimx", *ROT_FEATS, "efi_GB")
    return grid.rotation_ratios_grid(b, ROT_FEATS).select("dimx", "efi_GB_rot0_div_efi_GB")


_ORDER_IONS = "own AS (SELECT DISTINCT point FROM ions)"
_AMBI = "SELECT p.point, CASE WHEN p.pfe_GB = 0 THEN 1e0 ELSE {f}(s.s / NULLIF(p.pfe_GB, 0)) END AS absambi FROM points p JOIN (SELECT point, sum(pfi_GB * {n} * Zi) AS s FROM {i} GROUP BY point) s ON p.point = s.point"


@register("grid_ambipolarity_gen2", "WITH " + IONS_SQL + ",\n" + POINTS_SQL + " " + _AMBI.format(f="abs", n="normni", i="ions"))
def grid_ambipolarity_gen2(spark, sf):
    """B-16: absolute, and an error where a point with an electron flux has no result."""
    own = ions(spark, sf)
    with_ions = points(spark, sf).join(own.select("point").distinct(), "point", "left_semi")
    return grid.ambipolarity(own, with_ions, ["point"], absolute=True, strict=True).select("point", "absambi")


# the prepared grid: modes by part, ions and points by order; ions without densities
_TWO = ("two AS (SELECT point, nions, max(pfi_GB) AS pfi_GB, max(Zi) AS Zi FROM ions GROUP BY point, nions),\n"
        "zs AS (SELECT point, max(CASE WHEN nions = 0 THEN Zi END) AS z0, max(CASE WHEN nions = 1 THEN Zi END) AS z1 FROM two GROUP BY point),\n"
        "dens AS (SELECT t.*, CASE WHEN nions = 0 THEN (1e0 - z1 * ((Zeff - z0) / (z1 * z1 - z1 * z0))) / z0 ELSE (Zeff - z0) / (z1 * z1 - z1 * z0) END AS normni "
        "FROM two t JOIN zs USING (point) JOIN points USING (point))")
_FLAGS = ("fl AS (SELECT point, gam_leq_GB, gam_great_GB, COALESCE(gam_leq_GB <> 0, FALSE) AND COALESCE(pos, FALSE) AS TEM, COALESCE(gam_leq_GB <> 0, FALSE) AND COALESCE(neg, FALSE) AS ITG, "
          "COALESCE(gam_great_GB <> 0, FALSE) AS ETG FROM (SELECT point, max(CASE WHEN kthetarhos <= 2e0 THEN gam_GB END) AS gam_leq_GB, max(CASE WHEN kthetarhos > 2e0 THEN gam_GB END) AS gam_great_GB, "
          "bool_or(kthetarhos <= 2e0 AND ome_GB > 0) AS pos, bool_or(kthetarhos <= 2e0 AND ome_GB < 0) AS neg FROM modes GROUP BY point))")
_FLAGS2 = ("fl AS (SELECT point, max(CASE WHEN kthetarhos <= 2 THEN gam END) AS gam_leq_GB, max(CASE WHEN kthetarhos > 2 THEN gam END) AS gam_great_GB, "
           "bool_or(kthetarhos <= 2 AND gam <> 0 AND pos) AS TEM, bool_or(kthetarhos <= 2 AND gam <> 0 AND neg) AS ITG FROM "
           "(SELECT point, kthetarhos, max(gam_GB) AS gam, bool_or(ome_GB > 0) AS pos, bool_or(ome_GB < 0) AS neg FROM modes GROUP BY ALL) GROUP BY point)")
_PREPARED = ("am AS (SELECT p.point, p.pfe_GB, p.Zeff, CASE WHEN p.pfe_GB = 0 THEN 1e0 ELSE {f}(s.s / NULLIF(p.pfe_GB, 0)) END AS absambi FROM {p} p LEFT JOIN "
             "(SELECT point, sum(pfi_GB * normni * Zi) AS s FROM dens GROUP BY point) s ON p.point = s.point),\n"
             "full_grid AS (SELECT COALESCE(f.point, a.point, i.point) AS point, f.* EXCLUDE (point), a.* EXCLUDE (point), i.pfi_GB, i.normni FROM fl f FULL JOIN am a ON f.point = a.point "
             "FULL JOIN (SELECT * FROM dens WHERE nions = 0) i ON i.point = COALESCE(f.point, a.point))")


def _bare_ions(spark, sf):
    own = ions(spark, sf).groupBy("point", "nions").agg(F.max("pfi_GB").alias("pfi_GB"), F.max("Zi").alias("Zi"))
    return cut_lineage(own.join(points(spark, sf).select("point"), "point", "left_semi"))         # read several times


@register("grid_prepare_whole", "WITH " + ",\n".join([MODES_SQL, IONS_SQL, POINTS_SQL, _TWO, _FLAGS, _PREPARED.format(f="", p="points")])
          + " SELECT point, gam_leq_GB, gam_great_GB, TEM, ITG, ETG, pfe_GB, Zeff, round(absambi, 6) AS absambi, pfi_GB, round(normni, 9) AS normni FROM full_grid")
def grid_prepare_whole(spark, sf):
    """B-28: the whole preparation job; densities are missing, so they follow from Zeff."""
    rest, _growth, _consts = jobs.prepare_grid(modes(spark, sf), _bare_ions(spark, sf), points(spark, sf), ["point"])
    return rest.select("point", "gam_leq_GB", "gam_great_GB", "TEM", "ITG", "ETG", "pfe_GB", "Zeff", F.round("absambi", 6).alias("absambi"), "pfi_GB",
                       F.round("normni", 9).alias("normni"))


_BOTH = "both_ions AS (SELECT * FROM points WHERE point IN (SELECT point FROM zs WHERE z0 IS NOT NULL AND z1 IS NOT NULL))"


@register("grid_prepare_gen2", "WITH " + ",\n".join([MODES_SQL, IONS_SQL, POINTS_SQL, _TWO, _BOTH, _FLAGS2, _PREPARED.format(f="abs", p="both_ions")
                                                     .replace("FROM dens WHERE nions = 0", "FROM dens WHERE nions = 0 AND point IN (SELECT point FROM both_ions)")])
          + " SELECT point, gam_leq_GB, TEM, ITG, pfe_GB, round(absambi, 6) AS absambi FROM full_grid")
def grid_prepare_gen2(spark, sf):
    """B-29: the gen2 preparation of the points with both ions (a missing result would be an error)."""
    own = _bare_ions(spark, sf)
    both = cut_lineage(own.groupBy("point").agg(F.count("nions").alias("k")).filter("k = 2").select("point"))     # an ion has one row
    own, pts = (cut_lineage(d.join(both, "point", "left_semi")) for d in (own, points(spark, sf)))
    rest, _growth, _consts = jobs.prepare_grid(modes(spark, sf), own, pts, ["point"], gen2=True)
    return rest.select("point", "gam_leq_GB", "TEM", "ITG", "pfe_GB", F.round("absambi", 6).alias("absambi"))


@register("job_grid_store", "WITH " + ",\n".join([MODES_SQL, IONS_SQL, POINTS_SQL, _TWO, _FLAGS, _PREPARED.format(f="", p="points")])
          + " SELECT row_number() OVER (ORDER BY point) - 1 AS dimx, point, ITG, pfe_GB, round(absambi, 6) AS absambi FROM full_grid")
def job_grid_store(spark, sf):
    """M-07 / B-21: growth rates given as arrays along the wavenumbers unfolded, prepared, stored, and loaded again."""
    m, path = modes(spark, sf), _folder(spark, "grid")
    axis, n = slices.axis_positions(m, "kthetarhos")
    m = m.join(axis, "kthetarhos")
    per_k = m.groupBy("point", "numsols", "__pos").agg(F.max("gam_GB").alias("g"), F.max("ome_GB").alias("o"), F.min("ome_GB").alias("u"))
    cells = per_k.groupBy("point", "numsols").agg(F.map_from_entries(F.collect_list(F.struct("__pos", F.struct("g", "o", "u")))).alias("m"))
    # two rows of arrays: the largest and the least frequency beside the largest growth rate
    places = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    both = cells.select("point", F.explode(F.array(F.lit("o"), F.lit("u"))).alias("which"), "m").select(
        "point", F.transform(places, lambda k: F.element_at("m", k)["g"]).alias("gam_GB"),
        F.transform(places, lambda k: F.when(F.col("which") == "o", F.element_at("m", k)["o"]).otherwise(F.element_at("m", k)["u"])).alias("ome_GB"))
    jobs.grid_to_store(both, _bare_ions(spark, sf), points(spark, sf), ["point"], path, axis=("kthetarhos", (axis, n)))
    ds = ST.load_dataset(spark, path, ["ITG", "pfe_GB", "absambi"])
    return ds.input.join(ds.data, "dimx").select("dimx", "point", "ITG", "pfe_GB", F.round("absambi", 6).alias("absambi"))


# ------------------------------------------------------------------ jobs (M, H)

def _edge7_sql():
    ctes, outs = _breakdown_ctes()
    ratio = "efeITG_GB_div_efiITG_GB"
    return with_bridge(
        f"SELECT dimx, is_test, CASE WHEN COALESCE(ITG, FALSE) THEN efiITG_GB END AS efiITG_GB, CASE WHEN COALESCE(ETG, FALSE) THEN efeETG_GB END AS efeETG_GB, "
        f"CASE WHEN COALESCE(ITG, FALSE) THEN {ratio} END AS {ratio} FROM t",
        DIVSUM_CTE + f",\nc1 AS (SELECT * FROM d WHERE {sql_abs_lt('cke', '50e0')}),\n" + sql_zero_cte("c1")
        + f",\nok AS (SELECT * FROM z WHERE {SEPTOT_SQL} AND {AMBI1_SQL} AND {FEMTO_SQL}),\n" + ctes.replace("bridge", "ok")
        + f",\nbd AS (SELECT dimx, ITG, ETG, CASE WHEN COALESCE(prim AND pos > cuti, FALSE) THEN NULL ELSE {ratio} END AS {ratio}, {outs} FROM c),\nt AS ({_set_flag('bd')})")


@register("job_edge7_sets", _edge7_sql())
def job_edge7_sets(spark, sf):
    """M-04: ratios first, the chain, then the slice breakdown, split and stability gates."""
    b = bridge(spark, sf)
    out = jobs.edge7_job(b, slice_features=["scan_id"], sliced_dim="Ati")
    return out.select("dimx", "is_test", "efiITG_GB", "efeETG_GB", "efeITG_GB_div_efiITG_GB")


@register("job_thinning", with_bridge(
    "SELECT k.dimx, x.Ate, x.Ati, x.z, x.t AS efiITG_GB FROM (SELECT dimx FROM way WHERE cls = 'keep' UNION ALL SELECT arg_min(dimx, {'d': (z - m) * (z - m), 'i': dimx}) FROM "
    "(SELECT *, avg(z) OVER (PARTITION BY t, Ate, Ati, run) AS m FROM way WHERE cls = 'reduce') GROUP BY t, Ate, Ati, run) k JOIN "
    "(SELECT p.dimx, p.Ate * 3e0 AS Ate, p.Ati * 3e0 AS Ati, p.z, b.efiITG_GB AS t FROM p JOIN bridge b USING (dimx)) x USING (dimx)",
    COLUMNS + ",\nlevel AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {e!r}::DOUBLE)" for t, e in enumerate(_PASSES)) + ") v(t, eps)),\n"
    "sized AS (SELECT *, count(*) OVER (PARTITION BY t, Ate, Ati, run) AS size FROM (" + RUNS.format(by="t, ", eps="eps", rows="p, level") + ")),\n"
    "leaves AS (SELECT dimx, coalesce(min(t) FILTER (size <= 51), " + str(len(_PASSES) - 1) + ") AS t FROM sized GROUP BY dimx),\n"
    "way AS (SELECT s.*, CASE WHEN size = 1 AND t = 0 THEN 'toss' WHEN size > 6 THEN 'reduce' ELSE 'keep' END AS cls FROM sized s JOIN leaves USING (dimx, t))"))
def job_thinning(spark, sf):
    """H-08: settings document, columns by its dims, the loop, and the kept rows stored by column and loaded again."""
    base = _folder(spark, "thin")
    s = {**SETTINGS, "initial_eps": 0.995, "min_reduction": 10 ** 9}
    doc = F.to_json(F.struct(F.array(*map(F.lit, ["Ate", "Ati", "z"])).alias("dims"), F.array(F.lit("efiITG_GB")).alias("targets"), F.lit("parquet").alias("format"),
                             *[F.lit(v).alias(k) for k, v in s.items()]))
    spark.range(1).select(doc.alias("value")).coalesce(1).write.text(f"{base}/settings")
    pts = columns_apart(spark, sf).join(bridge(spark, sf).select("dimx", "efiITG_GB"), "dimx")
    jobs.thinning_job(pts, f"{base}/settings", f"{base}/kept")
    ds = ST.load_dataset(spark, f"{base}/kept", ["efiITG_GB"], mode="bare", prefer_flat=False)
    return ds.input.join(ds.data, "dimx").select("dimx", "Ate", "Ati", "z", "efiITG_GB")


# ------------------------------------------------------------------ training (J)

_W = [float(w) for m in NET_A.weights for w in m.ravel()]
_L2, _L1 = "0.5 * (SELECT sum(w * w) FROM wt)", "(SELECT sum(abs(w)) FROM wt)"


@register("loss_parts", with_bridge(
    f"SELECT round(g, 6) AS goodness, round(8e-6 * {_L2}, 9) AS l2_loss, round(2e-6 * {_L1}, 9) AS l1_loss, round(g + 8e-6 * {_L2} + 2e-6 * {_L1}, 6) AS loss "
    f"FROM (SELECT avg(({SQL_A['efiITG_GB']} - efiITG_GB) * ({SQL_A['efiITG_GB']} - efiITG_GB)) AS g FROM bridge)",
    "wt AS (SELECT * FROM (VALUES " + ", ".join(f"({w!r}::DOUBLE)" for w in _W) + ") v(w))"))
def loss_parts(spark, sf):
    """J-06: mean square residual of a network and the scaled norms of its weights."""
    s = S.score(bridge(spark, sf), {"a": NET_A})
    j = s.select("dimx", F.col("efiITG_GB").alias("pred")).join(bridge(spark, sf).select("dimx", "efiITG_GB"), "dimx")
    d = F.col("pred") - F.col("efiITG_GB")
    parts = T.total_loss(j.agg(F.avg(d * d)).first()[0], NET_A, 8e-6, 2e-6)
    return spark.createDataFrame([(round(parts["goodness"], 6), round(parts["l2_loss"], 9), round(parts["l1_loss"], 9), round(parts["loss"], 6))],
                                 "goodness double, l2_loss double, l1_loss double, loss double")


@register("model_records", with_bridge(
    "SELECT CAST(q AS INTEGER) AS q, 5 AS features, 2 AS targets, 'efiITG_GB' AS first_target, round(sqrt(avg(" + f"({SQL_A['efiITG_GB']} - efiITG_GB) * ({SQL_A['efiITG_GB']} - efiITG_GB)"
    + ")), 6) AS rms, '50' AS minibatches FROM bridge GROUP BY q"))
def model_records(spark, sf):
    """J-09: a record of the network for each generation of points, its residual in the metadata; written and read as documents."""
    path = _folder(spark, "records")
    s = S.score(bridge(spark, sf), {"a": NET_A}).select("dimx", F.col("efiITG_GB").alias("pred"))
    d = F.col("pred") - F.col("efiITG_GB")
    rms = s.join(bridge(spark, sf).select("dimx", "q", "efiITG_GB"), "dimx").groupBy("q").agg(F.sqrt(F.avg(d * d)).alias("rms"))
    record = T.model_record(NET_A, {"minibatches": 50})
    body = F.lit(record[:-1])                                            # the document, its closing brace left off
    doc = F.concat(body, F.lit(', "_metadata": '), F.to_json(F.struct(F.round("rms", 6).cast("string").alias("rms"), F.col("q").cast("int").cast("string").alias("q"))), F.lit("}"))
    rms.select(doc.alias("value")).repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(path)
    docs = spark.read.option("wholetext", True).text(path).select("value", F.from_json("value", ST.NETWORK_SCHEMA).alias("d"))
    return docs.select(F.col("d._metadata")["q"].cast("int").alias("q"), F.size("d.feature_names").alias("features"), F.size("d.target_names").alias("targets"),
                       F.col("d.target_names")[0].alias("first_target"), F.col("d._metadata")["rms"].cast("double").alias("rms"),
                       F.get_json_object("value", "$._parsed_settings.minibatches").alias("minibatches"))
