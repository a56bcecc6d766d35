"""Stores and the streaming form of the row-local curation."""
import uuid

import pytest
from pyspark.sql import functions as F

from fluxsieve.session import ensure_checkpoint_dir
from fluxsieve.sources import store as ST
from fluxsieve.sources.bridge import bridge_view
from fluxsieve.streaming.curate_stream import curate_rows, start


def test_store_modes_and_errors(spark, sf_small):
    b = bridge_view(spark, sf_small)
    path = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    data = b.select("dimx", F.when(F.col("ITG"), F.col("efiITG_GB")).alias("efiITG_GB"), "efeTEM_GB")
    ST.save_dataset(ST.Dataset(b.select("dimx", "Ati", "Nustar"), data, None), path, style="sep")
    with pytest.raises(KeyError):
        ST.load_dataset(spark, path, ["nope"], prefer_flat=False)
    with pytest.raises(ValueError):  # first column has fewer ids than the input is fine, more is not
        ST.assemble({"x": b.select("dimx", F.lit(1.0).alias("x")).union(
            spark.createDataFrame([(-1, 1.0)], "dimx long, x double"))}, ["x"], "bare", "left", b.select("dimx"))
    a = ST.load_dataset(spark, path, ["efiITG_GB"], mode="assign", prefer_flat=False).data
    assert a.count() == data.filter("efiITG_GB IS NOT NULL").count()
    u = ST.update_frames(data.select("dimx", "efeTEM_GB"), data.select("dimx", "efiITG_GB"))
    assert set(u.columns) == {"dimx", "efeTEM_GB", "efiITG_GB"}
    with pytest.raises(ValueError):
        ST.update_frames(data.select("dimx", "efeTEM_GB"), data.select("dimx", (F.col("efeTEM_GB") + 1).alias("efeTEM_GB")))
    assert ST.dataset_name(5, 9, "scan1", 10, "test", True) == "unstable_test_gen5_9D_scan1_filter10"


def test_stream_equals_batch(spark, sf_small):
    b = bridge_view(spark, sf_small)
    base = f"{ensure_checkpoint_dir(spark)}/s-{uuid.uuid4().hex}"
    b.write.parquet(f"{base}/in")
    q = start(spark, f"{base}/in", f"{base}/out", f"{base}/ck", b.schema, available_now=True)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{base}/out").select("dimx", "efi_GB").orderBy("dimx").collect()
    batch = curate_rows(b).select("dimx", "efi_GB").orderBy("dimx").collect()
    assert streamed == batch and len(batch) > 0


def test_manifest_of_ten_thousand_columns(spark, tmp_path, monkeypatch):
    """The column map comes from the manifest: no folder is listed, none of them even exists."""
    rows = [("output", f"efe{i}_GB", f"output/name=efe{i}_GB", i, "double") for i in range(10_000)]
    ST.write_manifest(spark, str(tmp_path), rows)
    assert len(ST.column_map(spark, str(tmp_path))) == 10_000
    ST.write_manifest(spark, str(tmp_path), [("input", "Ati", "input", 5, "double"), ("output", "efe_GB", "output/name=efe_GB", 5, "double")])
    assert ST.column_map(spark, str(tmp_path)) == ["efe_GB"]                     # rows of a kind are replaced
    assert ST.read_manifest(spark, str(tmp_path)).count() == 2
    assert ST.column_map(spark, str(tmp_path / "nothing")) == []


def test_store_of_other_origin_has_no_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "efe_GB", 2.0), (2, "efi_GB", 3.0)], "dimx long, name string, value double")
    df.write.partitionBy("name").parquet(str(tmp_path / "output"))
    assert ST.column_map(spark, str(tmp_path)) == ["efe_GB", "efi_GB"]
    ds = ST.load_dataset(spark, str(tmp_path), ["efi_GB"], mode="concat", load_input=False, prefer_flat=False)
    assert [tuple(r) for r in ds.data.collect()] == [(2, 3.0)]


def test_runs_of_one_schema_are_one_scan(spark, tmp_path):
    runs = {f"r{i}": spark.createDataFrame([(i, 1.0)], "dimx long, " + ("a double" if i % 2 else "b double")) for i in range(12)}
    ST.save_runs(runs, str(tmp_path))
    glued = ST.glue_runs(spark, str(tmp_path))
    plan = glued._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2 and sorted(r.dimx for r in glued.collect()) == list(range(12)) and set(glued.columns) == {"dimx", "a", "b"}


def test_named_filters(spark):
    from fluxsieve.operators import filters
    df = spark.createDataFrame([(1, 10.0), (2, 60.0), (3, -80.0)], "dimx long, cke double")
    assert [r.dimx for r in filters.apply_named(df, {"cke": 50.0}).collect()] == [1]
    with pytest.raises(KeyError, match="no filter 'other'"):
        filters.apply_named(df, ["other"])
    filters.register_filter("only_large", lambda bound: lambda d, r=F.col: r("cke") > bound, 50.0)
    try:
        assert [r.dimx for r in filters.apply_named(df, ["only_large"]).collect()] == [2]
        with pytest.raises(ValueError, match="there is a filter"):
            filters.register_filter("only_large", lambda: None)
    finally:
        del filters.FILTER_FUNCTIONS["only_large"], filters.FILTER_DEFAULTS["only_large"]


def test_strict_ambipolarity(spark):
    """B-16: a flux of 0 makes up for a missing result, anything else is an error; so is a third ion (B-14)."""
    from fluxsieve.operators import grid
    ions = spark.createDataFrame([(1, 0, 2.0, 0.5, 1.0), (1, 1, 1.0, 0.1, 6.0)], "p long, nions int, pfi_GB double, normni double, Zi double")
    points = spark.createDataFrame([(1, -4.0, 1.5), (2, 0.0, 1.5)], "p long, pfe_GB double, Zeff double")
    got = {r.p: r.absambi for r in grid.ambipolarity(ions, points, ["p"], absolute=True, strict=True).collect()}
    assert got == {1: pytest.approx(0.4), 2: 1.0}
    lacking = points.unionByName(spark.createDataFrame([(3, 2.0, 1.5)], points.schema))
    assert {r.p: r.absambi for r in grid.ambipolarity(ions, lacking, ["p"]).collect()}[3] is None
    with pytest.raises(Exception, match="no ambipolarity"):
        grid.ambipolarity(ions, lacking, ["p"], strict=True).collect()
    bare = ions.drop("normni")
    dens = {r.nions: r.normni for r in grid.with_densities(bare, points, ["p"]).collect()}
    assert dens == {0: pytest.approx(1 - 6 * 0.5 / 30), 1: pytest.approx(0.5 / 30)}
    with pytest.raises(Exception, match="two ions only"):
        grid.with_densities(bare.unionByName(spark.createDataFrame([(1, 2, 1.0, 3.0)], bare.schema)), points, ["p"]).collect()


def test_thinning_job_from_settings(spark, tmp_path):
    import json
    import numpy as np
    from fluxsieve.plans import jobs
    rng = np.random.RandomState(1)
    X = rng.normal(0, 0.3, (60, 2)).tolist() + [[50.0, 50.0], [float("nan"), 0.0]]
    df = spark.createDataFrame([(i, *x, float(i), "text") for i, x in enumerate(X)], "dimx long, u double, v double, efe_GB double, other string")
    (tmp_path / "s.json").write_text(json.dumps(dict(dims=["u", "v"], targets=["efe_GB"], initial_eps=0.5, reduction_threshold=10, min_eps=0.2,
                                                     min_reduction=5, min_samples=2, min_cluster_size=2, zeta=0.0, tau=1000.0, format="hdf"), indent=1))
    with pytest.warns(UserWarning, match="unknown format hdf"):
        kept = jobs.thinning_job(df, str(tmp_path / "s.json"), str(tmp_path / "out"))
    assert kept.columns == ["dimx", "u", "v", "efe_GB"] and 0 < kept.count() < 60
    assert ST.column_map(spark, str(tmp_path / "out")) == ["efe_GB"]
