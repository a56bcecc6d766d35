"""Stored filters, file readers and registry helpers."""
import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxsieve.operators import filters, registry, report, score, train
from fluxsieve.session import ensure_checkpoint_dir
from fluxsieve.sources import store as ST
from fluxsieve.sources.bridge import bridge_view


def test_stored_filter_roundtrip(spark, sf_small):
    b = bridge_view(spark, sf_small)
    base = f"{ensure_checkpoint_dir(spark)}/f-{uuid.uuid4().hex}"
    pred = filters.ambipolar_ok(1.5, 0)
    filters.create_stored_filter(b, pred, f"{base}/filter/ambipolar_1.5")
    assert filters.load_stored_filter(spark, f"{base}/filter/missing") is None
    removed = filters.load_stored_filter(spark, f"{base}/filter/ambipolar_1.5")
    via_store = filters.apply_stored_filter(b, removed).select("dimx").orderBy("dimx").collect()
    via_pred = filters.apply(b, pred).select("dimx").orderBy("dimx").collect()
    assert via_store == via_pred
    chain = filters.sanity_chain(1.5, 1.5, 1e-4, ambipolar_version=0, stored={"ambipolar": removed})
    plain = filters.sanity_chain(1.5, 1.5, 1e-4, ambipolar_version=0)
    assert chain.apply(b).count() == plain.apply(b).count()


def test_file_readers(spark, tmp_path):
    net = score.make_network(["a", "b"], ["efiITG_GB"], hidden=(2,), seed=3)
    d = tmp_path / "nets"
    d.mkdir()
    (d / "efi.json").write_text(json.dumps(net.to_dict()))
    nets = ST.read_network_folder(spark, str(d))
    assert list(nets) == ["efiITG_GB"] and np.allclose(nets["efiITG_GB"].weights[0], net.weights[0])
    multi = score.make_network(["a"], ["x_GB", "y_GB"], seed=1)
    (d / "multi.json").write_text(json.dumps(multi.to_dict()))
    with pytest.raises(ValueError):
        ST.read_network_folder(spark, str(d))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "settings.json").write_text(json.dumps({"dims": ["Ate", "Ati"], "initial_eps": 1.0}))
    st = ST.read_settings(spark, str(tmp_path / "s"))
    assert st.first()["initial_eps"] == 1.0
    tab = spark.createDataFrame([("Ati", 1.0, 2.0)], "name string, mean double, std double")
    ST.export_csv(tab, str(tmp_path / "csv"))
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "csv"))
    rec = json.loads(train.model_record(net, {"l2": 1e-5}))
    assert rec["_parsed_settings"]["l2"] == 1e-5


def test_range_intersection(spark):
    a = score.make_network(["x"], ["y"], seed=1)
    b = score.make_network(["x"], ["y"], seed=2)
    a.feature_min, a.feature_max = {"x": 0.0}, {"x": 5.0}
    b.feature_min, b.feature_max = {"x": 2.0}, {"x": 9.0}
    r = score.range_intersection(score.registry_ranges(spark, {"a": a, "b": b})).first()
    assert (r["min"], r["max"], r["empty"]) == (2.0, 5.0, False)


def test_divsum_from_div_id_errors(spark):
    reg = spark.createDataFrame(
        [(1, ["efe_GB", "efi_GB"]), (2, ["efe_GB"]), (3, ["foo_div_bar"]), (4, ["efe_GB_div_efi_GB"])],
        "id long, target_names array<string>")
    reg = reg.select("id", "target_names", F.lit(None).cast("string").alias("recipe"),
                     *[F.lit(v).alias(c) for c, v in [("hidden_neurons", "h"), ("hidden_activation", "t"),
                                                      ("output_activation", "n"), ("goodness", "mse"),
                                                      ("cost_l2_scale", 1.0), ("cost_l1_scale", 0.0),
                                                      ("early_stop_measure", "loss"), ("early_stop_after", 15)]])
    with pytest.raises(ValueError):
        registry.divsum_from_div_id(reg, 1)
    with pytest.raises(ValueError):
        registry.divsum_from_div_id(reg, 2)
    with pytest.raises(NotImplementedError):
        registry.divsum_from_div_id(reg, 3)
    with pytest.raises(LookupError):
        registry.divsum_from_div_id(reg, 4)
    assert registry.divsum_from_div_id(reg, 4, raise_on_missing=False).count() == 0
    partner = reg.filter("id = 2").withColumn("id", F.lit(5).cast("long")).withColumn("target_names", F.array(F.lit("efi_GB")))
    rows = registry.divsum_from_div_id(reg.unionByName(partner), 4).orderBy("id").collect()
    assert [list(r.target_names) for r in rows] == [["efe_GB"], ["efe_GB", "efi_GB"]]
    assert list(rows[0].networks) == [4, 5] and list(rows[1].networks) == [rows[0].id, 5]


def test_fit_reduces_loss(spark, sf_small):
    b = bridge_view(spark, sf_small).select("dimx", "Ati", "Ate", "efiITG_GB")
    consts = train.scaling_dict(train.standardization(b, ["Ati", "Ate", "efiITG_GB"], "normsm_1_0"))
    s = train.scale_columns(b, consts)
    _net, log = train.fit(s, ["Ati", "Ate"], ["efiITG_GB"], hidden=(4,), epochs=4, minibatches=2, learning_rate=0.05)
    losses = [r.loss for r in log.orderBy("epoch").collect()]
    assert losses[-1] < losses[0]


def test_grid_summary_and_labels(spark):
    df = spark.createDataFrame([(1, 8, 0.5), (2, 8, 0.7), (3, 16, None)], "id long, nodes int, rms double")
    g = report.formatted_summary(report.grid_summary(df, ["nodes"], ["rms"]), ["rms"]).collect()
    assert len(g) == 1 and g[0].n == 2 and g[0].rms_label == "0.600 +- 0.141"
    members = report.grid_members(df, ["nodes"], ["rms"]).collect()
    assert sorted((r.id, r.nodes, r.n) for r in members) == [(1, 8, 2), (2, 8, 2)]


def test_cut_tables_are_dropped(spark):
    from fluxsieve.session import cut_lineage, drop_cut_tables
    drop_cut_tables(spark)
    df = cut_lineage(spark.range(10))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 10 and os.path.isdir(folder)
    assert drop_cut_tables(spark) == 1 and not os.path.exists(folder)


def test_ranges_reach_the_scan(spark, tmp_path):
    """cke, cki, absambi and the regime are pushed to a stored table's scan, alone and inside the chain."""
    from fluxsieve.operators import filters
    cols = ["cke", "cki", "absambi", "efe_GB", "efi_GB"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spark.range(100).select(F.col("id").alias("dimx"), *[F.col("id").cast("double").alias(c) for c in cols]).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")

    def pushed(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return " ".join(line for line in plan.splitlines() if "PushedFilters" in line)
    for pred, names in ((filters.cke_ok(50.0), ["cke"]), (filters.ck_ok(50.0), ["cke", "cki"]), (filters.ambipolar_ok(1.5, 0), ["absambi"]),
                        (filters.ambipolar_ok(1.5, 1), ["absambi"]), (filters.regime_ok(0.0, 30.0), ["efe_GB", "efi_GB"])):
        text = pushed(filters.apply(t, pred))
        assert all(f"LessThan({n}," in text for n in names), text
    chain = filters.sanity_chain(1.5, 1.5, 1e-4, cke_bound=50.0, cki_bound=50.0, ambipolar_version=0)
    text = pushed(chain.apply(t))
    assert all(f"LessThan({n}," in text for n in ("cke", "cki", "absambi")), text


def test_missing_stored_filter_is_none(spark, tmp_path):
    from fluxsieve.operators import filters
    assert filters.load_stored_filter(spark, f"{tmp_path}/none") is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        filters.load_stored_filter(spark, f"{tmp_path}/broken").collect()
