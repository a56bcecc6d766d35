"""Unit tests of operators on hand-made micro tables (null rules, windows, ranks, scoring)."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxsieve.operators import derive, filters, masks, rank, score, select, slices, split


def test_null_rules_in_filters(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, -1.0, 0.0), (3, 2.0, 0.0)], "dimx long, efe_GB double, efi_GB double")
    kept = [r.dimx for r in filters.apply(df, filters.nonnegative_ok()).collect()]
    assert kept == [3]  # a missing heat flux fails the non-negative test
    femto = [r.dimx for r in filters.apply(df, filters.femtoflux_ok(5.0)).orderBy("dimx").collect()]
    assert femto == [1]  # missing counts as fine; |2| < 5 and |-1| < 5 are femto fluxes


def test_whole_row_zeroing(spark):
    df = spark.createDataFrame([(1, -1.0, 3.0, 1.0), (2, 2.0, 3.0, 1.0), (3, None, 3.0, 1.0)],
                               "dimx long, efeITG_GB double, efiITG_GB double, pfeITG_GB double")
    z = {r.dimx: r for r in filters.negative_to_zero(df).collect()}
    assert (z[1].efeITG_GB, z[1].efiITG_GB, z[1].pfeITG_GB) == (0.0, 0.0, 1.0)
    assert (z[2].efeITG_GB, z[2].efiITG_GB) == (2.0, 3.0)
    assert (z[3].efeITG_GB, z[3].efiITG_GB) == (0.0, 0.0)


def test_chain_symbolic_zeroing_equals_stepwise(spark, sf_small):
    from fluxsieve.sources.bridge import bridge_view
    d = derive.divsum(bridge_view(spark, sf_small), derive.DIV_NAMES_BASE)
    chain = filters.sanity_chain(1.5, 1.5, 1e-4, cke_bound=50.0, cki_bound=50.0, ambipolar_version=0)
    a = chain.apply(d).select("dimx", "efi_GB", "efe_GB").orderBy("dimx").collect()
    b = chain.apply_stepwise(d).select("dimx", "efi_GB", "efe_GB").orderBy("dimx").collect()
    assert a == b and len(a) > 0
    # idempotent
    again = chain.apply(chain.apply(d)).count()
    assert again == len(a)


def test_ieee_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "efeITG_GB double, efiITG_GB double")
    r = [x[0] for x in derive.divsum(df, ["efeITG_GB_div_efiITG_GB"]).select("efeITG_GB_div_efiITG_GB").collect()]
    assert r[0] == math.inf and r[1] == -math.inf and r[2] is None and r[3] == 0.5


def test_div_bounds_zero_clause(spark):
    df = spark.createDataFrame([(0.0,), (0.01,), (0.5,), (2.0,)], "efeITG_GB_div_efiITG_GB double")
    out = [x[0] for x in masks.div_bounds_mask(df, {"efeITG_GB_div_efiITG_GB": (0.05, 1.5)}).collect()]
    assert out == [0.0, None, 0.5, None]


def brute_breakdown(vals, patience):
    """Reference loop on one completed slice (None = missing grid point)."""
    if all(v == 0 for v in vals):
        return None
    w = [None if (v is None or v == 0) else v for v in vals]
    for i in range(len(w) - 1):
        if w[i] is not None and w[i + 1] is not None and w[i + 1] < w[i]:
            nxt = w[i + 1:i + 1 + patience]
            if all(x is not None and x < w[i] for x in nxt):
                return i + 1
    return None


def test_breakdown_mask_against_loop(spark):
    rng = np.random.RandomState(0)
    rows, grid = [], list(range(10))
    for s in range(300):
        for g in grid:
            if rng.rand() < 0.85:
                v = float(rng.choice([0.0, rng.uniform(0, 10)], p=[0.15, 0.85]))
                rows.append((s * 100 + g, float(s), float(g), v))
    df = spark.createDataFrame(rows, "dimx long, scan double, At double, efiITG_GB double")
    out = {r.dimx: r.efiITG_GB for r in slices.breakdown_mask(df, ["scan"], "At", modes=("ITG",), patience=3).collect()}
    pdf = pd.DataFrame(rows, columns=["dimx", "scan", "At", "v"])
    removed = 0
    for s, g in pdf.groupby("scan"):
        vals = [None] * len(grid)
        ids = [None] * len(grid)
        for _, r in g.iterrows():
            vals[int(r.At)], ids[int(r.At)] = r.v, int(r.dimx)
        cut = brute_breakdown(vals, 3)
        for k, i in enumerate(ids):
            if i is None:
                continue
            exp_null = cut is not None and k >= cut
            removed += exp_null
            assert (out[i] is None) == exp_null, (s, k)
    assert removed > 0


@pytest.mark.parametrize("hot,small", [(-5.0, 20_000), (0.0, 40), (5.0, 40)])
def test_ranks_and_cuts_match_sort(spark, hot, small, monkeypatch):
    """One value holds most rows, at the minimum, in the middle or at the maximum; some are missing."""
    monkeypatch.setattr(select, "SMALL", small)
    monkeypatch.setattr(select, "ACCURACY", 50)
    rng = np.random.RandomState(1)
    n = 4000
    a = np.where(rng.rand(n) < 0.7, hot, rng.randint(-4, 5, n).astype(float))
    rows = [(int(i), None if rng.rand() < 0.1 else float(x), float(y)) for i, x, y in zip(rng.permutation(n), a, rng.randint(0, 3, n))]
    df = spark.createDataFrame(rows, "dimx long, a double, b double")
    exp = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[2], r[0]))
    ranked = rank.global_rank(df, ["a", "b"])
    assert {r.dimx: r["rank"] for r in ranked.collect()} == {r[0]: i for i, r in enumerate(exp)}
    for lo, hi in ((0, n), (n // 2, n // 2), (100, 3950)):
        got = split.outlier_trim_rank(df, ["a", "b"], above=hi / n, below=lo / n)
        assert sorted(r.dimx for r in got.collect()) == sorted(r[0] for r in exp[lo:hi])
    present = sorted(r[1] for r in rows if r[1] is not None)
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = select.quantiles(df, {"a": probs, "b": [0.5]})
    assert got["a"] == pytest.approx([float(np.quantile(present, p)) for p in probs]) and got["b"] == [float(np.median([r[2] for r in rows]))]


def test_cuts_of_nothing(spark):
    none = spark.createDataFrame([], "dimx long, a double")
    missing = spark.createDataFrame([(1, None), (2, None)], "dimx long, a double")
    assert select.quantiles(none, {"a": [0.5]}) == {"a": [None]} == select.quantiles(missing, {"a": [0.5]})
    assert split.outlier_trim_rank(none, ["a"]).count() == 0 and split.train_val_test(none, 0.1, 0.1).count() == 0
    assert select.keys_at(missing, [(["a", "dimx"], 1), (["a", "dimx"], 2), (["a", "dimx"], -1)]) == [(None, 2), None, None]


def test_cuts_move_no_wide_row(spark):
    """The wide table is read once and filtered: no exchange, and no column but the keys takes part in the search."""
    df = spark.range(30_000).select(F.col("id").alias("dimx"), (F.col("id") % 97).cast("double").alias("a"), F.lit("wide").alias("payload"))
    for out in (split.outlier_trim_rank(df, ["a"]), split.test_flag(df), split.train_val_test(df, 0.1, 0.1), split.outlier_trim_quantile(df, ["a"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "payload" in out.columns


def test_hot_maximum_small_case(spark):
    df = spark.range(1000).select(F.col("id").alias("dimx"), F.when(F.col("id") < 5, -1.0).otherwise(0.0).alias("a"))
    assert rank.global_rank(df, ["a"]).filter("rank < 100").count() == 100


def test_rank_plan_has_no_single_task(spark, sf_small):
    df = spark.range(100000).withColumnRenamed("id", "dimx")
    plan = rank.global_rank(df, ["dimx"])._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "SinglePartition" not in line or "__p" in plan[plan.index(line):plan.index(line) + 600]


def test_split_exact_counts(spark):
    df = spark.range(1001).withColumnRenamed("id", "dimx")
    t = split.train_val_test(df, 0.05, 0.1)
    c = {r["set"]: r["count"] for r in t.groupBy("set").count().collect()}
    assert c == {"test": 100, "validation": 50, "train": 851}


def test_tiny_network_by_hand(spark):
    net = score.Network(["a"], ["y"], [np.array([[2.0]]), np.array([[3.0]])], [np.array([0.5]), np.array([-1.0])],
                        ["tanh", "none"], {"a": 1.0, "y": 2.0}, {"a": 0.0, "y": 1.0})
    df = spark.createDataFrame([(1, 0.25), (2, -1.0)], "dimx long, a double")
    got = {r.dimx: r.y for r in score.score(df, {"n": net}).collect()}
    for i, x in ((1, 0.25), (2, -1.0)):
        exp = ((3.0 * math.tanh(2.0 * x + 0.5) - 1.0) - 1.0) / 2.0
        assert got[i] == pytest.approx(exp, abs=1e-12)
    cols = score.network_columns(net)
    nat = {r.dimx: r.y for r in df.select("dimx", cols["y"].alias("y")).collect()}
    assert nat == pytest.approx(got)


def test_committee_of_one_has_zero_error(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "m double")
    mean, std = score.committee([F.col("m")])
    r = df.select(mean.alias("a"), std.alias("b")).collect()
    assert [x.a for x in r] == [1.0, 5.0] and all(x.b == 0.0 for x in r)


def test_divsum_inverse(spark):
    df = spark.createDataFrame([(2.0, 4.0), (3.0, 0.0)], "efeITG_GB double, efiITG_GB double")
    d = derive.divsum(df, ["efeITG_GB_div_efiITG_GB"]).filter("efiITG_GB != 0")
    assert all(abs(r.efeITG_GB_div_efiITG_GB * r.efiITG_GB - r.efeITG_GB) < 1e-12 for r in d.collect())


def test_chain_keeps_and_zeroes_rows(spark):
    rows = [(1, 2.0, 1.5, 3.0, 0.5, True), (2, -2.0, 1.5, 3.0, 0.5, True), (3, 2.0, 1.5, None, 0.5, True), (4, 2.0, 1.5, 3.0, 1e-5, False),
            (5, 2.0, 1.5, 3.0, None, True), (6, 2.0, 1.5, 3.0, float("nan"), True), (7, 2.0, 5.0, 3.0, 0.5, False), (8, -2.0, 1.5, 3.0, -1e-6, False),
            (9, 2.0, 1.5, 3.0, 0.0, True), (10, 2.0, 1e-5, 3.0, 0.5, False), (11, -2.0, 1e-5, 3.0, 0.5, True)]
    df = spark.createDataFrame([(*r[:5], 1.0, 1.0) for r in rows], "dimx long, efi_GB double, efiITG_GB double, efe_GB double, pfe_GB double, cke double, absambi double")
    got = {r.dimx: (r.efi_GB, r.efiITG_GB, r.efe_GB) for r in filters.sanity_chain(1.5, 1.5, 1e-4, cke_bound=50.0).apply(df).collect()}
    assert got == {r[0]: (0.0, 0.0, 0.0) if r[1] < 0 or r[3] is None else r[1:4] for r in rows if r[5]}


def test_chain_is_compiled(spark, tmp_path):
    """No method of the chains is too large for the JVM to compile."""
    from fluxsieve.operators import derive
    from fluxsieve.plans import jobs
    from fluxsieve.sources.bridge import bridge_view
    spark.range(200).selectExpr(
        "id AS l_orderkey", "id % 20 AS l_partkey", "id % 7 AS l_suppkey", "cast(id % 4 + 1 AS int) AS l_linenumber", "cast(id % 50 + 1 AS double) AS l_quantity",
        "id * 37e-2 AS l_extendedprice", "1e-2 * (id % 9) AS l_discount", "1e-2 * (id % 8) AS l_tax", "'A' AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    b = bridge_view(spark, str(tmp_path))
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for preset in (jobs.PRESET_9D, jobs.EDGE6, jobs.EDGE7, jobs.EDGE8):
            q = preset.sanity
            chain = filters.sanity_chain(q.septot_factor, q.ambi_bound, q.femto_bound, cke_bound=q.cke_bound, cki_bound=q.cki_bound, ambipolar_version=q.ambipolar_version)
            if preset.regime is not None:
                chain.steps.append(filters.Step("regime", filters.regime_ok(*preset.regime)))
            out = chain.apply(derive.divsum(b, list(preset.divnames), skip_missing=True))
            parts = code.codegenStringSeq(out._jdf.queryExecution().executedPlan())
            assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_breakdown_is_found_once_and_hashed(spark, monkeypatch):
    written = []
    monkeypatch.setattr(slices, "cut_lineage", lambda df, cut=slices.cut_lineage: written.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    df = spark.createDataFrame([(i, 0, float(i % 9), 9.0 - i % 9) for i in range(12)], "dimx long, scan long, At double, efiITG_GB double")
    out = slices.breakdown_drop_flags(df, ["scan"], modes=("ITG",), patience=3)
    assert not any("SortAggregate" in plan for plan in written)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.dimx for r in out.collect() if r["__drop_ITG"]} == set(range(1, 9))
