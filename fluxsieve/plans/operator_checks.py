"""Registered queries for operators that the other check modules do not reach, each with an
oracle written from the operator's definition."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.name_columns import name_catalog
from ..operators import derive, filters, grid, masks, rank, report, score as S, split
from ..session import ensure_checkpoint_dir
from ..sources import store as ST
from .checks import bridge, register, with_bridge
from .grid_checks import IONS_SQL, MODES_SQL, ions, modes
from .score_checks import NET_B
from .whole_checks import MODE_OF, RULES

MD5 = "md5(concat_ws('|', '42', CAST(dimx AS VARCHAR)))"


def _folder(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ names (F)

# fixed values: the names of the flags' expectations, which whole_checks.RULES and MODE_OF hold
_ORDERED = ["pfe_GB", "pfeETG_SI", "pfeITG_SI_div_efeETG_GB", "pfeITG_SI_div_pfeTEM_GB", "efe_GB", "efe_GB_plus_efiITG_GB",
            "efeTEM_GB_plus_efiTEM_GB", "efeTEM_GB_plus_efi_GB", "efeITG_GB_plus_efiITG_GB", "efeITG_GB_plus_efi_GB",
            "efeETG_GB_plus_efiETG_GB", "efeETG_GB_plus_efi_GB", "chiee_GB", "gam_GB"]
NAME_FLAGS = ["is_transport", "is_partial_particle", "is_pure_heat", "tem", "itg", "etg", "is_ion_scale", "is_electron_scale",
              "is_multi_scale", "is_pure_flux"]


def _flagged(flag: str) -> str:
    """The flag as SQL: is the name one of those it holds for?"""
    names = MODE_OF[flag.upper()] if flag.upper() in MODE_OF else RULES[flag]
    return "b.name IN (" + ", ".join(f"'{n}'" for n in sorted(names)) + f") AS {flag}"


@register("name_rules", with_bridge(
    "SELECT b.name, CAST(b.n AS BIGINT) AS n, " + ", ".join(map(_flagged, NAME_FLAGS))
    + " FROM (SELECT list_extract([" + ", ".join(f"'{x}'" for x in _ORDERED) + f"], CAST(c % {len(_ORDERED)} AS INTEGER) + 1) AS name, "
    "count(*) AS n FROM bridge GROUP BY 1) b"))
def name_rules(spark, sf):
    """Ten flags of the catalogue over the names that occur (all columns: ``name_catalogue``)."""
    at = (F.col("c") % len(_ORDERED)).cast("int") + 1
    found = bridge(spark, sf).select(F.element_at(F.array(*[F.lit(x) for x in _ORDERED]), at).alias("name")) \
        .groupBy("name").agg(F.count("*").alias("n"))
    cat = name_catalog(found)
    scale = {m: F.col("mode_scale") == m.upper() for m in ("tem", "itg", "etg")}
    return cat.select("name", "n", *[scale[f].alias(f) if f in scale else F.col(f) for f in NAME_FLAGS])


# ------------------------------------------------------------------ gridded output (B)

@register("grid_stability_gen2", "WITH " + MODES_SQL + """,
k AS (SELECT point, kthetarhos, max(gam_GB) AS gam, bool_or(ome_GB > 0) AS pos, bool_or(ome_GB < 0) AS neg FROM modes GROUP BY ALL)
SELECT point, max(CASE WHEN kthetarhos <= 2 THEN gam END) AS gam_leq_GB, max(CASE WHEN kthetarhos > 2 THEN gam END) AS gam_great_GB,
       bool_or(kthetarhos <= 2 AND gam <> 0 AND pos) AS TEM, bool_or(kthetarhos <= 2 AND gam <> 0 AND neg) AS ITG FROM k GROUP BY point""")
def grid_stability_gen2(spark, sf):
    """B-12: growth and direction at the same wavenumber."""
    return grid.stability_flags_gen2(modes(spark, sf), ["point"])


@register("grid_pick_ion", "WITH " + IONS_SQL + " SELECT point, pfi_GB, Zi FROM ions WHERE nions = 1")
def grid_pick_ion(spark, sf):
    """B-05."""
    return grid.pick_ion(ions(spark, sf), 1).select("point", "pfi_GB", "Zi")


@register("grid_drop_columns", "WITH " + MODES_SQL + " SELECT point, gam_GB AS keep_GB, kthetarhos FROM modes")
def grid_drop_columns(spark, sf):
    """B-04, B-07, B-08, B-22: inner dims, unit copies, rotation fluxes and growth rates leave the set."""
    m = modes(spark, sf).withColumn("keep_GB", F.col("gam_GB")).withColumn("gam_SI", F.col("gam_GB")) \
        .withColumn("vfiTEM_GB", F.col("ome_GB"))
    main, _growth = grid.drop_growth(grid.remove_rotation(grid.drop_si(m)), ["point"])
    return grid.keep_hypercube(main, ["point"], allowed_extra=["kthetarhos"])


@register("grid_growth_set", "WITH " + MODES_SQL + " SELECT point, kthetarhos, numsols, gam_GB, ome_GB FROM modes")
def grid_growth_set(spark, sf):
    """B-22: growth rates as their own set."""
    return grid.drop_growth(modes(spark, sf), ["point", "kthetarhos", "numsols"])[1]


@register("grid_merge_dedupe", with_bridge(
    "SELECT DISTINCT COALESCE(a.scan_id, b.scan_id) AS scan_id, COALESCE(a.q, b.q) AS q, a.Ate, b.An FROM "
    "(SELECT scan_id, q, Ate FROM bridge WHERE x <= 5e-1) a FULL JOIN (SELECT DISTINCT scan_id, q, An FROM bridge WHERE x >= 4e-1) b "
    "ON a.scan_id = b.scan_id AND a.q = b.q"))
def grid_merge_dedupe(spark, sf):
    """B-23: merge of two groups with repeated rows, duplicates dropped."""
    b = bridge(spark, sf)
    return grid.merge_groups(b.filter("x <= 0.5").select("scan_id", "q", "Ate"),
                             b.filter("x >= 0.4").select("scan_id", "q", "An").distinct(), ["scan_id", "q"])


_PF = [("dfeITG_GB", "cke"), ("vteITG_GB", "cki"), ("vceITG_GB", "absambi"), ("dfiTEM_GB", "cki"), ("vtiTEM_GB", "cke"),
       ("vciTEM_GB", "absambi"), ("vriTEM_GB", "x"), ("vte_GB", "cke"), ("vce_GB", "cki"), ("vti_GB", "cki"), ("vci_GB", "absambi"), ("vri_GB", "q")]


@register("grid_particle_fluxes", with_bridge(
    "SELECT dimx, cke * An + cki + absambi AS pfeITG_GB, cki * An + cke + x + absambi AS pfiTEM_GB, cke + cki AS vae_GB, "
    "cki + absambi + q AS vai_GB FROM bridge"))
def grid_particle_fluxes(spark, sf):
    """B-17..B-19: particle fluxes from their parts, sums of pinches."""
    b = bridge(spark, sf).select("dimx", "An", *[F.col(src).alias(new) for new, src in _PF])
    return grid.sum_pinches(grid.fill_particle_fluxes(b, always=True)).select("dimx", "pfeITG_GB", "pfiTEM_GB", "vae_GB", "vai_GB")


# ------------------------------------------------------------------ filters and masks (C, D)

@register("stored_filter", with_bridge("SELECT dimx, cke FROM bridge WHERE cke > -2e1 AND cke < 2e1"))
def stored_filter(spark, sf):
    """C-12..C-14: ids that a predicate removes are stored, read back and taken out."""
    b, path = bridge(spark, sf).select("dimx", "cke"), _folder(spark, "filter")
    filters.create_stored_filter(b, filters.cke_ok(20.0), path)
    return filters.apply_stored_filter(b, filters.load_stored_filter(spark, path))


@register("align_input", with_bridge("SELECT dimx, Ati, q FROM bridge WHERE efe_GB >= 1e1 AND efi_GB >= 1e1 AND efe_GB < 3e1 AND efi_GB < 3e1"))
def align_input(spark, sf):
    """C-18: the inputs of the rows that passed a filter."""
    b = bridge(spark, sf)
    return filters.align_input(b.select("dimx", "Ati", "q"), filters.regime_filter(b, 10.0, 30.0))


@register("filter_septot_gen2", with_bridge(
    "SELECT dimx FROM (SELECT *, pfeITG_GB + pfeTEM_GB AS pfe_GB FROM bridge) WHERE abs(efiITG_GB) <= 9e-1 * abs(efi_GB) "
    "AND abs(efiTEM_GB) <= 9e-1 * abs(efi_GB) AND abs(efeITG_GB) <= 9e-1 * abs(efe_GB) AND abs(efeTEM_GB) <= 9e-1 * abs(efe_GB) "
    "AND abs(efeETG_GB) <= 9e-1 * abs(efe_GB) AND abs(pfeITG_GB) <= 9e-1 * abs(pfe_GB) AND abs(pfeTEM_GB) <= 9e-1 * abs(pfe_GB)"))
def filter_septot_gen2(spark, sf):
    """C-08 gen2: heat against all modes, particles against ITG and TEM only (an ETG column is not looked at)."""
    b = bridge(spark, sf).withColumn("pfe_GB", F.col("pfeITG_GB") + F.col("pfeTEM_GB")).withColumn("pfeETG_GB", F.lit(1e9))
    return filters.apply(b, filters.septot_ok(0.9, "gen2")).select("dimx")


@register("filter_gen4_chain", with_bridge(
    "SELECT dimx FROM bridge WHERE " + " AND ".join(f"{c} >= 0" for c in ["efiITG_GB", "efeITG_GB", "efeTEM_GB", "efiTEM_GB", "efeETG_GB", "efe_GB", "efi_GB"])
    + " AND " + " AND ".join(f"NOT (abs({c}) < 2e-1 AND {c} <> 0)" for c in
                             ["efiITG_GB", "efeITG_GB", "efeTEM_GB", "efiTEM_GB", "efeETG_GB", "pfeITG_GB", "pfeTEM_GB", "efe_GB", "efi_GB"])))
def filter_gen4_chain(spark, sf):
    """C-04 and C-11 with the gen4 column policies."""
    b = bridge(spark, sf)
    return filters.apply(filters.apply(b, filters.nonnegative_ok("gen4")), filters.femtoflux_ok(0.2, "gen4")).select("dimx")


_GROWTH = "(SELECT *, CAST(c % 4 AS DOUBLE) / 1e1 AS gl, CAST(c % 3 AS DOUBLE) / 1e1 AS gg FROM bridge)"


@register("growth_stability_masked", with_bridge(
    "SELECT dimx, CASE WHEN ITG THEN efiITG_GB END AS efiITG_GB, CASE WHEN TEM THEN efeTEM_GB END AS efeTEM_GB, "
    "CASE WHEN gg <> 0 THEN efeETG_GB END AS efeETG_GB, CASE WHEN gl <> 0 OR gg <> 0 THEN efe_GB END AS efe_GB, "
    f"CASE WHEN gl <> 0 THEN efi_GB END AS efi_GB FROM {_GROWTH}"))
def growth_stability_masked(spark, sf):
    """D-02: gates from growth rates."""
    b = bridge(spark, sf).withColumn("gam_leq_GB", (F.col("c") % 4).cast("double") / 10.0) \
        .withColumn("gam_great_GB", (F.col("c") % 3).cast("double") / 10.0)
    return masks.growth_stability_mask(b).select("dimx", "efiITG_GB", "efeTEM_GB", "efeETG_GB", "efe_GB", "efi_GB")


# ------------------------------------------------------------------ stores (A)

def _columns_store(spark, sf):
    b, path = bridge(spark, sf), _folder(spark, "store")
    data = b.select("dimx", F.when(F.col("ITG"), F.col("efiITG_GB")).alias("efiITG_GB"), F.when(F.col("TEM"), F.col("efeTEM_GB")).alias("efeTEM_GB"))
    ST.save_dataset(ST.Dataset(b.select("dimx", "Ati"), data, None), path, style="sep")
    return path


@register("store_separate_left", with_bridge(
    "SELECT dimx, efiITG_GB, CASE WHEN TEM THEN efeTEM_GB END AS efeTEM_GB FROM bridge WHERE ITG"))
def store_separate_left(spark, sf):
    """A-07: ``merge``, ``how='left'`` keeps the first column's ids."""
    return ST.load_dataset(spark, _columns_store(spark, sf), ["efiITG_GB", "efeTEM_GB"], mode="merge", how="left", prefer_flat=False).data


@register("store_update", with_bridge(
    "SELECT dimx, CASE WHEN q <= 4 THEN efiITG_GB END AS efiITG_GB, CASE WHEN q > 2 THEN efeTEM_GB END AS efeTEM_GB FROM bridge"))
def store_update(spark, sf):
    """A-09: values missing on one side are filled from the other; equal overlaps are no conflict."""
    b = bridge(spark, sf)
    old = b.select("dimx", F.when(F.col("q") <= 2, F.col("efiITG_GB")).alias("efiITG_GB"))
    new = b.select("dimx", F.when(F.col("q") <= 4, F.col("efiITG_GB")).alias("efiITG_GB"), F.when(F.col("q") > 2, F.col("efeTEM_GB")).alias("efeTEM_GB"))
    return ST.update_frames(old, new)


@register("store_put_column", with_bridge("SELECT dimx, efi_GB, CASE WHEN ITG THEN efe_GB END AS extra FROM bridge"))
def store_put_column(spark, sf):
    """A-15."""
    b = bridge(spark, sf)
    return ST.put_column(b.select("dimx", "efi_GB"), "extra", b.filter("ITG").select("dimx", "efe_GB"))


@register("store_constants", with_bridge("SELECT 'Zeff' AS name, CAST(min(q) AS VARCHAR) AS value FROM bridge UNION ALL "
                                         "SELECT 'rows', CAST(count(*) AS VARCHAR) FROM bridge"))
def store_constants(spark, sf):
    """A-16: constants written beside the data and read back."""
    b, path = bridge(spark, sf), _folder(spark, "store")
    const = b.agg(F.min("q").cast("string").alias("Zeff"), F.count("*").cast("string").alias("rows"))
    const = const.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("Zeff", "rows")])).alias("r")).select("r.*")
    ST.save_dataset(ST.Dataset(b.select("dimx", "Ati"), b.select("dimx", "efi_GB"), const), path)
    return ST.load_dataset(spark, path, False).const


@register("store_growth_family", with_bridge("SELECT dimx, absambi, cke FROM bridge"))
def store_growth_family(spark, sf):
    """E-05 / E-06: columns of a family, features in a given order."""
    b = bridge(spark, sf).select("cke", "dimx", "efi_GB", "absambi")
    return derive.order_features(derive.select_family(b, lambda c: not N.is_transport(c)), ["dimx", "absambi"])


_PREFIXES = ["", "sane_", "test_", "training_", "unstable_", "unstable_sane_"]


@register("dataset_names_prefixed", with_bridge(
    "SELECT DISTINCT p || 'gen' || CAST(CAST(q AS INTEGER) AS VARCHAR) || '_7D_nions0-flat.' || CAST(CAST(An AS INTEGER) AS VARCHAR) || '_filter8' AS name, "
    "p LIKE 'unstable%' AS unstable, replace(replace(p, 'unstable_', ''), '_', '') AS \"set\", CAST(q AS INTEGER) AS gen, "
    "'nions0-flat.' || CAST(CAST(An AS INTEGER) AS VARCHAR) AS dataset, true AS valid FROM (SELECT *, list_extract(["
    + ", ".join(f"'{p}'" for p in _PREFIXES) + "], CAST(c % 6 AS INTEGER) + 1) AS p FROM bridge) "
    "UNION ALL SELECT DISTINCT 'other_gen' || CAST(CAST(q AS INTEGER) AS VARCHAR) || '_7D_x_filter8', false, '', NULL, '', false FROM bridge"))
def dataset_names_prefixed(spark, sf):
    """A-17: the three set prefixes, data-set ids with dashes and dots, and names that are none."""
    b = bridge(spark, sf)
    q, an = F.col("q").cast("int").cast("string"), F.col("An").cast("int").cast("string")
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("c") % 6).cast("int") + 1)
    good = b.select(F.concat(prefix, F.lit("gen"), q, F.lit("_7D_nions0-flat."), an, F.lit("_filter8")).alias("name")).distinct()
    bad = b.select(F.concat(F.lit("other_gen"), q, F.lit("_7D_x_filter8")).alias("name")).distinct()
    p = ST.parse_dataset_name(F.col("name"))
    gen = F.when(p["valid"], F.regexp_extract("name", ST.DATASET_NAME, 3)).cast("int")
    return good.unionAll(bad).select("name", p["unstable"].alias("unstable"), p["set"].alias("set"), gen.alias("gen"),
                                     p["dataset"].alias("dataset"), p["valid"].alias("valid"))


# ------------------------------------------------------------------ splits and training sets (G)

@register("shuffled_positions", with_bridge(f"SELECT dimx, row_number() OVER (ORDER BY {MD5}, dimx) - 1 AS position FROM bridge"))
def shuffled_positions(spark, sf):
    """G-09: the reproducible permutation, as positions."""
    b = bridge(spark, sf).select("dimx").withColumn("h", rank.hash_key(42))
    return rank.global_rank(b, ["h"], out="position").select("dimx", "position")


@register("prep_training_set", with_bridge(
    "SELECT dimx, CAST(Ati AS FLOAT) AS Ati, CAST(log10(Nustar) AS FLOAT) AS logNustar, CAST(t AS FLOAT) AS efiITG_GB FROM ("
    "SELECT dimx, Ati, Nustar, CASE WHEN ITG THEN efiITG_GB END AS t, row_number() OVER (ORDER BY CASE WHEN ITG THEN efiITG_GB END NULLS LAST, dimx) - 1 AS r, "
    "count(*) OVER () AS n FROM bridge) WHERE r >= floor(n * 2e-2) AND r < floor(n * 9e-1) AND t IS NOT NULL"))
def prep_training_set(spark, sf):
    """G-13: trimmed, complete, joined and cast."""
    b = bridge(spark, sf)
    target = b.select("dimx", F.when(F.col("ITG"), F.col("efiITG_GB")).alias("efiITG_GB"))
    return split.prep_training_set(b.select("dimx", "Ati", "Nustar"), target, ["efiITG_GB"], above=0.9, below=0.02)


# ------------------------------------------------------------------ scoring and reports (I, R)

@register("range_intersection", with_bridge(
    "SELECT name, max(lo) AS min, min(hi) AS max, max(lo) > min(hi) AS empty FROM (SELECT scan_id, 'q' || CAST(CAST(q AS INTEGER) AS VARCHAR) AS name, "
    "min(Ati) AS lo, max(Ati) AS hi FROM bridge GROUP BY ALL) GROUP BY name"))
def range_intersection(spark, sf):
    """I-12: ranges valid for every network (here: every scan), per input."""
    b = bridge(spark, sf).select("scan_id", F.concat(F.lit("q"), F.col("q").cast("int").cast("string")).alias("name"), "Ati")
    return S.range_intersection(b.groupBy("scan_id", "name").agg(F.min("Ati").alias("min"), F.max("Ati").alias("max")))


@register("score_relu_missing", with_bridge(
    f"SELECT dimx, round({S.network_sql(NET_B)['efiITG_GB']}, 9) AS y FROM (SELECT * REPLACE (CASE WHEN ITG THEN Ati END AS Ati) FROM bridge)"))
def score_relu_missing(spark, sf):
    """I-01: a missing input gives a missing output through relu, natively as in the batched path."""
    b = bridge(spark, sf).withColumn("Ati", F.when(F.col("ITG"), F.col("Ati")))
    return b.select("dimx", F.round(S.network_columns(NET_B)["efiITG_GB"], 9).alias("y"))


@register("formatted_summary", with_bridge(
    "SELECT q, printf('%.2f', m) || ' +- ' || printf('%.2f', s) AS efi_GB_label FROM (SELECT q, avg(efi_GB) AS m, stddev_samp(efi_GB) AS s FROM bridge GROUP BY q)"))
def formatted_summary(spark, sf):
    """R-12: mean and spread as labels."""
    g = bridge(spark, sf).groupBy("q").agg(F.avg("efi_GB").alias("efi_GB"), F.stddev_samp("efi_GB").alias("efi_GB_std"))
    return report.formatted_summary(g, ["efi_GB"], digits=2).select("q", "efi_GB_label")


_AB = {"efeITG_GB": "(q * Ati)", "efiITG_GB": "(Ati - 2e1)", "efeTEM_GB": "(An - 4e0)", "pfeTEM_GB": "(x * 3e0)", "efeETG_GB": "(Ate - 5e0)"}


def _outputs(df):
    return {"efeITG_GB": F.col("q") * F.col("Ati"), "efiITG_GB": F.col("Ati") - 20.0, "efeTEM_GB": F.col("An") - 4.0,
            "pfeTEM_GB": F.col("x") * 3.0, "efeETG_GB": F.col("Ate") - 5.0}


@register("score_self_combo", with_bridge(f"SELECT dimx, {_AB['efeITG_GB']} * {_AB['efiITG_GB']} AS a, {_AB['efeTEM_GB']} AS b FROM bridge"))
def score_self_combo(spark, sf):
    """I-07: products of one network's outputs, and one passed through."""
    b = bridge(spark, sf)
    a, c = S.self_combine(_outputs(b), lambda x, y: x * y, [["efeITG_GB", "efiITG_GB"], ["efeTEM_GB", None]])
    return b.select("dimx", a.alias("a"), c.alias("b"))


@register("score_committee_product_padded", with_bridge(
    "SELECT dimx, round(greatest(least(Ati, 3e1), 5e0) * An, 9) AS v0, round(sqrt(power(greatest(least(Ati, 3e1), 5e0) * x, 2) + power(q * An, 2)), 9) AS e0, "
    "greatest(least(Ate, 3e1), 5e0) * 0e0 AS v1, 0e0 * An AS e1 FROM bridge"))
def score_committee_product_padded(spark, sf):
    """I-10: two targets times one, clipped on one side, padded with zeros on the other."""
    b = bridge(spark, sf)
    (v0, e0), (v1, e1) = S.committee_product_set([(F.col("Ati"), F.col("q")), (F.col("Ate"), F.col("q"))], [(F.col("An"), F.col("x"))],
                                                 bounds_x=(5.0, 30.0))
    return b.select("dimx", F.round(v0, 9).alias("v0"), F.round(e0, 9).alias("e0"), v1.alias("v1"), e1.alias("e1"))


_FAC = ("(CASE WHEN g0 = 1e-4 THEN 0e0 WHEN x <> 0 THEN greatest(1e0 + (0.13 * q + 0.09 / (x * (1e0 / 3e0)) + 0.41 * (An / 4e0) + -1.65) "
        "* (Machtor * 2e0 - 1e-1) / g0, 0e0) END)")
_LEAD = {"efeITG_GB": "efiITG_GB", "efiITG_GB": "efiITG_GB", "efeTEM_GB": "efeTEM_GB", "pfeTEM_GB": "efeTEM_GB", "efeETG_GB": "efeETG_GB"}


@register("score_layered", with_bridge(
    "SELECT dimx, " + ", ".join(f"round((CASE WHEN {_AB[lead]} <= 0 THEN 0e0 ELSE {_AB[n]} END)" + ("" if "ETG" in n else f" * {_FAC}") + f", 9) AS {n}"
                               for n, lead in _LEAD.items()) + " FROM (SELECT *, greatest(Ate / 1e1, 1e-4) AS g0 FROM bridge)"))
def score_layered(spark, sf):
    """I-14: stacked fluxes, leading-flux clipping, rotation rule."""
    b = bridge(spark, sf)
    out = S.layered(_outputs(b), F.col("Ate") / 10.0, F.col("x"), F.col("q"), F.col("An") / 4.0, F.col("Machtor") * 2.0 - 0.1)
    return b.select("dimx", *[F.round(c, 9).alias(n) for n, c in out.items()])
