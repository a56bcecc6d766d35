"""Column-expression operators of the gridded data, growth-rate masks and job helpers."""
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxsieve.functions import names as N
from fluxsieve.operators import derive, grid, masks, split
from fluxsieve.plans import jobs
from fluxsieve.session import ensure_checkpoint_dir
from fluxsieve.sources.bridge import bridge_view


def test_particle_flux_parts_and_pinches(spark):
    df = spark.createDataFrame([(2.0, 1.0, 0.5, 0.25, 0.1, 3.0, 0.2, 0.3)],
                               "dfeITG_GB double, vteITG_GB double, vceITG_GB double, dfiITG_GB double, "
                               "vriITG_GB double, An double, vtiITG_GB double, vciITG_GB double")
    out = grid.sum_pinches(grid.fill_particle_fluxes(df)).first()
    assert out.pfeITG_GB == pytest.approx(2.0 * 3.0 + 1.0 + 0.5)
    assert out.pfiITG_GB == pytest.approx(0.25 * 3.0 + 0.2 + 0.1 + 0.3)  # ions include the rotation pinch
    assert out.vaeITG_GB == pytest.approx(1.5)
    assert out.vaiITG_GB == pytest.approx(0.2 + 0.3 + 0.1)


def test_rotation_ratios_on_grid(spark):
    df = spark.createDataFrame([(1.0, 0.0, 4.0), (1.0, 0.1, 2.0), (1.0, 0.2, 0.0)], "Ati double, Machtor double, efe_GB double")
    r = {row.Machtor: row.efe_GB_rot0_div_efe_GB for row in grid.rotation_ratios_grid(df, ["Ati", "Machtor"]).collect()}
    assert r == {0.0: 1.0, 0.1: 2.0, 0.2: 0.0}


def test_growth_mask(spark):
    df = spark.createDataFrame([(0.0, 1.0, True, False, 5.0, 6.0, 7.0, 8.0), (2.0, 0.0, False, True, 5.0, 6.0, 7.0, 8.0)],
                               "gam_leq_GB double, gam_great_GB double, ITG boolean, TEM boolean, "
                               "efe_GB double, efiITG_GB double, efeETG_GB double, pfe_GB double")
    rows = masks.growth_stability_mask(df).collect()
    assert (rows[0].efe_GB, rows[0].efiITG_GB, rows[0].efeETG_GB, rows[0].pfe_GB) == (5.0, 6.0, 7.0, None)
    assert (rows[1].efe_GB, rows[1].efiITG_GB, rows[1].efeETG_GB, rows[1].pfe_GB) == (5.0, None, None, 8.0)


def test_family_selection_and_order(spark, sf_small):
    b = bridge_view(spark, sf_small)
    fam = derive.select_family(b, N.is_pure_heat)
    assert fam.columns[0] == "dimx" and all(N.is_pure_heat(c) for c in fam.columns[1:])
    o = derive.order_features(b.withColumn("nions", F.lit(0)), ["x", "Ati"])
    assert o.columns[:2] == ["x", "Ati"] and "nions" not in o.columns


def test_training_set_and_sets(spark, sf_small):
    b = bridge_view(spark, sf_small)
    t = split.prep_training_set(b.select("dimx", "Ati", "Ate", "Nustar"), b.select("dimx", "efiITG_GB"), ["efiITG_GB"],
                                above=0.99, below=0.01)
    n = b.count()
    assert t.count() == int(n * 0.99) - int(n * 0.01)
    assert dict(t.dtypes)["Ati"] == "float" and "logNustar" in t.columns
    res = jobs.curate(b)
    path = f"{ensure_checkpoint_dir(spark)}/sets-{uuid.uuid4().hex}"
    jobs.write_sets(res, path)
    back = spark.read.parquet(path)
    assert back.filter("set = 'test'").count() == res.sets.filter("is_test").count()
    assert back.filter("set = 'test'").count() == int(0.1 * res.sane.count())


def test_input_range_and_alignment(spark, sf_small):
    b = bridge_view(spark, sf_small)
    inp, data = b.select("dimx", "Ati", "x"), b.select("dimx", "efi_GB")
    kept = set(r.dimx for r in grid_free(inp, data).collect())
    exp = set(r.dimx for r in b.filter("Ati >= 10 AND Ati <= 20").collect())
    assert kept == exp
    assert set(r.dimx for r in __import__("fluxsieve.operators.filters", fromlist=["x"]).align_input(
        inp, data.filter("efi_GB > 5")).collect()) == set(r.dimx for r in b.filter("efi_GB > 5").collect())


def grid_free(inp, data):
    from fluxsieve.operators import filters
    return filters.input_range_filter(inp, data, {"Ati": (10.0, 20.0)})


def test_registry_depth_and_cycle(spark):
    """A chain of 100 compositions (each uses the one before and a pure network twice), and one that closes."""
    from fluxsieve.operators import registry
    rows = [(0, None, 0.5)] + [(i, [i - 1, 1000, 1000], None) for i in range(1, 101)] + [(1000, None, 2.0), (2000, [0, 555], None)]
    reg = spark.createDataFrame(rows, "id long, networks array<long>, l2 double")
    got = {(r.id, r.leaf): r.n for r in registry.leaves(reg).collect()}
    assert got == {**{(i, 0): 1 for i in range(1, 101)}, **{(i, 1000): 2 * i for i in range(1, 101)}, (2000, 0): 1, (2000, 555): 1}
    values = {r.id: r.l2 for r in registry.recursive_attribute(reg, "l2").collect()}
    assert values[100] == [0.5] + [2.0] * 200 and values[2000] == [0.5]
    assert {r.id: r.l2 for r in registry.recursive_attribute(reg, "l2", distinct=True).collect()}[100] == [0.5, 2.0]
    loop = reg.unionByName(spark.createDataFrame([(7000, [7001], None), (7001, [0, 7002], None), (7002, [7001, 7000], None)], reg.schema))
    with pytest.raises(ValueError, match=r"\[7000, 7001, 7002\]|\[7001, 7002\]"):
        registry.leaves(loop)


@pytest.mark.parametrize("rows", [50_000, 40])
def test_range_join_with_a_hot_value(spark, rows):
    """A third of the left rows are one value; ranges and parts of it do not change the result."""
    from fluxsieve.operators import join
    rng = np.random.RandomState(6)
    v = np.where(rng.rand(900) < 0.33, 2.5, np.round(rng.uniform(-5, 5, 900), 2))
    left = [(i, None if i % 50 == 0 else float("nan") if i % 51 == 0 else float(x)) for i, x in enumerate(v)]
    right = [(i, float(x)) for i, x in enumerate(np.round(rng.uniform(-5, 5, 120), 2))] + [(500, 2.5), (501, 2.5), (502, None), (503, float("inf")), (504, 0.0)]
    a, b = spark.createDataFrame(left, "i long, x double"), spark.createDataFrame(right, "j long, y double")
    got = sorted((r.i, r.j) for r in join.band_join(a, "x", b, "y", 0.02, 0.01, rows=rows).collect())
    want = sorted((i, j) for i, x in left for j, y in right if x is not None and y is not None and abs(y) < np.inf and abs(x - y) <= 0.02 + 0.01 * abs(y))
    assert got == want and len(got) > 900


def test_segments_do_not_change_a_slice(spark):
    """A slice longer than a segment breaks down across its border; missing points and copies in between."""
    from fluxsieve.operators import slices
    rng = np.random.RandomState(7)
    rows, i = [], 0
    for s in range(3):
        for p in range(120):
            for _ in range(1 + (p % 17 == 0)):
                value = 50.0 - 0.1 * p if s == 0 and 40 <= p < 60 else float(rng.randint(0, 9))
                rows.append((i, s, float(p), None if rng.rand() < 0.05 else value))
                i += 1
    df = spark.createDataFrame(rows, "dimx long, s long, At double, efiITG_GB double")
    plain = {r.dimx: r.d for r in slices.breakdown_drop_flags(df, ["s"], modes=("ITG",)).withColumnRenamed("__drop_ITG", "d").collect()}
    for segment in (1, 7, 45):
        got = {r.dimx: r.d for r in slices.breakdown_drop_flags(df, ["s"], modes=("ITG",), segment=segment).withColumnRenamed("__drop_ITG", "d").collect()}
        assert got == plain
    assert len(plain) == len(rows) and sum(plain.values()) > 30
    plan = slices.breakdown_drop_flags(df, ["s"], modes=("ITG",))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan


def test_reference_is_carried_over_ranges(spark):
    """One group holds nearly all rows, so its references pass from range to range."""
    from fluxsieve.operators import slices
    rng = np.random.RandomState(9)
    rows = [(i, "a" if i % 20 else "b", float(rng.randint(0, 50)), float(rng.randint(1, 9)) if rng.rand() < 0.9 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "dimx long, g string, level double, v double")
    got = {r.dimx: r.relative for r in slices.relative_to_reference(df, ["g"], ["level", "dimx"], "level", "v", 25.0).collect()}
    want = {}
    for g in "ab":
        ref = None
        for i, _, level, v in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]), reverse=True):
            ref = v if level == 25.0 and v is not None else ref
            want[i] = None if v is None or ref is None else v / ref
    assert got == want


def test_long_axes(spark):
    """An axis of 150,000 values: places, cell index, and slices as maps (too many columns for a wide table)."""
    from fluxsieve.operators import grid, slices
    n = 150_000
    df = spark.range(n).select(F.col("id").alias("point"), (F.col("id") * 7 % n).cast("double").alias("u"), (F.col("id") % 3).cast("double").alias("w"))
    got = grid.axis_index(df, ["u", "w"]).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("dimx") - (F.col("u") * 3 + F.col("w")))).alias("off")).first()
    assert (got.n, got.off) == (n, 0.0)
    with pytest.raises(ValueError, match="slice_maps"):
        slices.wide_slices(df, ["w"], "u", "point", key="point")
    maps = slices.slice_maps(df, ["w"], "u", "point", key="point")
    assert {r.w: r.n for r in maps.select("w", F.size("values").alias("n")).collect()} == {0.0: 50_000, 1.0: 50_000, 2.0: 50_000}


def test_constants_beside_missing_values(spark):
    """One value and missing ones is data; one value everywhere, or none anywhere, is a constant; kept columns stay."""
    from fluxsieve.operators import grid
    df = spark.createDataFrame([(1, 1.0, True, 2.0, None, 5.0), (2, None, None, 2.0, None, 5.0), (3, 1.0, True, 2.0, None, 5.0)],
                               "dimx long, v double, flag boolean, c double, none double, target double")
    rest, consts = grid.metadatize(df, keep=["target"])
    assert rest.columns == ["dimx", "v", "flag", "target"]
    assert {r.name: r.value for r in consts.collect()} == {"c": "2.0", "none": None}
    assert grid.metadatize(df.limit(0))[0].columns == df.columns


def test_grids_and_arrays_on_axes_of_any_size(spark, monkeypatch):
    """Product grids and unfolded arrays take their axes as tables, small (broadcast) or large (joined)."""
    from fluxsieve.operators import slices
    df = spark.createDataFrame([(1.5, 10, "a"), (0.5, 30, "b"), (1.5, 20, "a"), (None, 20, "c")], "x double, y long, z string")
    want = sorted((x, y, z) for x in (0.5, 1.5) for y in (10, 20, 30) for z in "abc")
    points = spark.range(3).select("id", F.expr("array(id * 1.0D, null, id + 2.0D)").alias("g"), F.expr("array(1, 2, 3)").alias("k"))
    for limit in (slices.AXIS_BROADCAST, 1):
        monkeypatch.setattr(slices, "AXIS_BROADCAST", limit)
        assert sorted(map(tuple, slices.product_grid(df, ["x", "y", "z"]).collect())) == want
        axis = slices.axis_positions(df, "y")
        by_table = grid.unfold_arrays(points, ["id"], "y", axis, ["g", "k"])
        by_list = grid.unfold_arrays(points, ["id"], "y", [10, 20, 30], ["g", "k"])
        assert by_table.columns == by_list.columns
        assert sorted(map(repr, by_table.collect())) == sorted(map(repr, by_list.withColumn("y", F.col("y").cast("long")).collect()))
    assert slices.product_grid(df.filter("z = 'none'"), ["x", "y"]).count() == 0


def test_a_long_axis_stays_off_the_driver(spark):
    from fluxsieve.operators import slices
    df = spark.range(150_000).select(F.col("id").alias("x"), F.lit(7).alias("y"))
    g = slices.product_grid(df, ["x", "y"])
    assert g.agg(F.count("*"), F.sum("x"), F.max("y")).first() == (150_000, 150_000 * 149_999 // 2, 7)


def test_preparation_joins_one_step_at_a_time(spark, monkeypatch):
    """No plan of the preparation sorts the sides of several joins in one task."""
    written = []
    monkeypatch.setattr(jobs, "cut_lineage", lambda df, cut=jobs.cut_lineage: written.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    modes = spark.createDataFrame([(1, 0.5, 0, 2.0, 1.0), (1, 3.0, 0, 4.0, -1.0), (3, 0.5, 0, 0.0, 1.0)], "point long, kthetarhos double, numsols int, gam_GB double, ome_GB double")
    ions = spark.createDataFrame([(1, 0, 2.0, 1.0), (1, 1, 3.0, 6.0), (2, 0, 2.0, 1.0), (2, 1, 5.0, 6.0)], "point long, nions int, pfi_GB double, Zi double")
    points = spark.createDataFrame([(1, 4.2, 1.5), (2, 0.0, 2.0)], "point long, pfe_GB double, Zeff double")
    for gen2 in (True, False):
        rest, _, _ = jobs.prepare_grid(modes, ions, points, ["point"], gen2=gen2)
        got = {r.point: (r.gam_leq_GB, r.TEM, r.ITG, r.pfe_GB, r.absambi and round(r.absambi, 9)) for r in rest.collect()}
        assert got == {1: (2.0, True, False, 4.2, 0.5), 2: (None, None, None, 0.0, 1.0), 3: (0.0, False, False, None, None)}
    # densities: charges and points to an ion; then one join a step
    joins = [sum("Join " in line or "JoinExec" in line for line in plan.splitlines()) for plan in written]
    assert joins == [2, 1, 1, 1] * 2
