"""Density thinning against brute-force numpy references on small fixtures."""
import numpy as np
import pandas as pd
import pytest

from fluxsieve.operators import thin


def brute_dbscan(X, eps, min_samples):
    n = len(X)
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= min_samples
    label = -np.ones(n, dtype=np.int64)
    comp = -np.ones(n, dtype=np.int64)
    c = 0
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack = [i]
            comp[i] = c
            while stack:
                j = stack.pop()
                for k in np.nonzero(nb[j] & core)[0]:
                    if comp[k] < 0:
                        comp[k] = c
                        stack.append(k)
            c += 1
    label[core] = comp[core]
    for i in np.nonzero(~core)[0]:
        cs = comp[nb[i] & core]
        if len(cs):
            label[i] = cs.min()
    return label, core


def as_partition(ids, labels):
    groups = {}
    for i, l in zip(ids, labels):
        groups.setdefault(l, set()).add(i)
    noise = groups.pop(-1, set()) | groups.pop(thin.NOISE, set())
    return noise, sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("seed,eps,ms,most", [(0, 0.5, 2, 20_000), (0, 0.5, 2, 20), (1, 0.8, 3, 10), (2, 0.3, 1, 30), (4, 0.5, 6, 5)])
def test_dbscan_matches_brute_force(spark, seed, eps, ms, most):
    rng = np.random.RandomState(seed)
    centers = rng.uniform(0, 10, (4, 3))
    X = np.vstack([c + rng.normal(0, 0.4, (60, 3)) for c in centers] + [rng.uniform(0, 10, (40, 3))])
    ids = np.arange(len(X)) * 7 + 3
    pdf = pd.DataFrame({"dimx": ids, "a": X[:, 0], "b": X[:, 1], "c": X[:, 2]})
    lab = thin.dbscan(spark.createDataFrame(pdf), ["a", "b", "c"], eps, ms, tile_points=most).toPandas()
    got = dict(zip(lab.dimx, lab.label))
    ref, core = brute_dbscan(X, eps, ms)
    noise_s, groups_s = as_partition(ids, [got[i] for i in ids])
    noise_r, _ = as_partition(ids, ref)
    assert noise_s == noise_r
    # core points: identical partition
    core_ids = ids[core]
    _, cg_s = as_partition(core_ids, [got[i] for i in core_ids])
    _, cg_r = as_partition(core_ids, ref[core])
    assert cg_s == cg_r
    # border points: same cluster as the brute force (smallest label rule)
    ref_of = {i: l for i, l in zip(ids, ref)}
    core_rep = {}
    for i, l in zip(core_ids, ref[core]):
        core_rep.setdefault(l, got[i])
    for i in ids[~core]:
        if ref_of[i] >= 0:
            assert got[i] == core_rep[ref_of[i]]


def test_k_expression():
    assert thin.k_expression(0.0, 100, 20, 1000, 0.0) == 5
    assert thin.k_expression(5.0, 10, 20, 1000, 1.0) == 1


def test_two_step_thinning_subset(spark):
    rng = np.random.RandomState(3)
    X = np.vstack([rng.normal(0, 0.2, (200, 2)), rng.normal(3, 0.5, (80, 2)), rng.uniform(-5, 8, (30, 2))])
    pdf = pd.DataFrame({"dimx": np.arange(len(X)), "u": X[:, 0], "v": X[:, 1], "w": 1.0})
    df = spark.createDataFrame(pdf)
    s = thin.ThinSettings(dims=["u", "v"], initial_eps=0.5, reduction_threshold=20, min_eps=0.3,
                          min_reduction=10, min_samples=2, min_cluster_size=3)
    out = thin.two_step_thinning(df, s).toPandas()
    assert 0 < len(out) < len(pdf)
    assert set(out.dimx) <= set(pdf.dimx)
    assert list(out.columns) == list(pdf.columns)


def test_local_density_matches_brute_force(spark):
    rng = np.random.RandomState(5)
    X = rng.uniform(0, 4, (400, 2))
    label = np.where(rng.rand(400) < 0.5, "a", "b")
    pdf = pd.DataFrame({"dimx": np.arange(400), "u": X[:, 0], "v": X[:, 1], "label": label})
    got = {r.label: (r.density, r.npts) for r in thin.local_density(spark.createDataFrame(pdf), ["u", "v"], 0.4, tile_points=50).collect()}
    for g in "ab":
        P = X[label == g]
        nb = (((P[:, None] - P[None]) ** 2).sum(-1) <= 0.16).sum(1) - 1
        assert got[g] == (pytest.approx(nb.max() / 0.4 ** 2), len(P))


def brute_two_step(ids, X, s):
    """The thinning loop on plain arrays, with one representative per reduced cluster (min_reduction above all sizes)."""
    X = X - X.mean(0)

    def run(at, eps, reduce_next=False):
        label, _ = brute_dbscan(X[at], eps, s.min_samples)
        if (label < 0).all():
            return None
        out = {"toss": list(at[label < 0]), "next": [], "reduce": [], "keep": []}
        for c in np.unique(label[label >= 0]):
            members = at[label == c]
            if len(members) <= s.min_cluster_size:
                out["keep"] += list(members)
            elif len(members) > s.reduction_threshold + 1 and not reduce_next:
                out["next"] += list(members)
            else:
                out["reduce"].append(members)
        return out

    def nearest(members):
        d = ((X[members] - X[members].mean(0)) ** 2).sum(1)
        return members[np.lexsort((ids[members], d))[0]]

    first = run(np.arange(len(X)), 1.0)
    kept = first["keep"] + [nearest(m) for m in first["reduce"]]
    at, eps = np.array(sorted(first["next"]), int), s.initial_eps
    while True:
        step = run(at, eps) if len(at) else None
        if step is None:
            break
        kept += step["toss"] + step["keep"] + [nearest(m) for m in step["reduce"]]
        at = np.array(sorted(step["next"]), int)
        if eps < s.min_eps or not len(at):
            break
        eps -= s.eps_step
    if len(at):
        last = run(at, eps, True)
        kept += [nearest(m) for m in last["reduce"]] if last else []
    return {int(ids[k]) for k in kept}


def test_two_step_thinning_keeps_the_same_ids(spark):
    rng = np.random.RandomState(8)
    X = np.vstack([rng.normal(0, 0.25, (120, 2)), rng.normal(4, 0.6, (60, 2)), rng.uniform(-6, 9, (40, 2)), rng.normal(-4, 0.05, (12, 2))])
    ids = rng.permutation(len(X)) * 3 + 1
    s = thin.ThinSettings(dims=["u", "v"], initial_eps=0.6, reduction_threshold=25, min_eps=0.5, min_reduction=1000, min_samples=2,
                          min_cluster_size=4)
    pdf = pd.DataFrame({"dimx": ids, "u": X[:, 0], "v": X[:, 1]})
    got = {r.dimx for r in thin.two_step_thinning(spark.createDataFrame(pdf), s).collect()}
    assert got == brute_two_step(ids, X, s)


def brute_lloyd(X, ids, k):
    """Plain Lloyd iterations from the hash partition; the id nearest the first centroid left."""
    import struct
    import xxhash
    signed = [int.from_bytes(struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", int(i)), 42)), "little", signed=True) for i in ids]
    lab = np.array([h % k for h in signed])
    while True:
        js = sorted(set(lab))
        cents = np.array([X[lab == j].mean(0) for j in js])
        new = np.array([js[int(np.argmin(((cents - x) ** 2).sum(1)))] for x in X])
        if (new == lab).all():
            break
        lab = new
    d = ((X - cents[0]) ** 2).sum(1)
    return int(ids[np.lexsort((ids, d))[0]])


def test_kmeans_in_blocks_equals_plain_lloyd(spark, monkeypatch):
    from fluxsieve.operators import kmeans
    monkeypatch.setattr(kmeans, "BLOCK_POINTS", 16)
    monkeypatch.setattr(kmeans, "BLOCK_MOST", 24)
    monkeypatch.setattr(kmeans, "GROUP", 2)
    rng = np.random.RandomState(11)
    sizes, ks = {"a": 260, "b": 90, "c": 40, "d": 30, "e": 1}, {"a": 9, "b": 3, "c": 1, "d": 5, "e": 2}
    rows, at = [], 0
    for name, n in sizes.items():
        X = np.round(rng.uniform(0, 12, (n, 3)) * 8) / 8                       # eighths: sums are exact in any order
        X = np.repeat(X[:1], n, axis=0) if name == "d" else X                  # copies of one point
        rows += [(at + i, name, *map(float, x)) for i, x in enumerate(X)]
        at += n
    df = spark.createDataFrame(rows, "dimx long, label string, u double, v double, w double")
    k = spark.createDataFrame([(n, ks[n], sizes[n]) for n in sizes], "label string, k int, npts long")
    want = {}
    for name in sizes:
        own = [r for r in rows if r[1] == name]
        want[name] = brute_lloyd(np.array([r[2:] for r in own]), np.array([r[0] for r in own]), ks[name])
    for bound in (0, 50):                                                      # all in blocks; the smaller ones in one group each
        got = kmeans.representatives(df, ["u", "v", "w"], k, max_group=bound)
        assert {r.label: r.dimx for r in got.collect()} == want


def test_kmeans_sends_a_block_few_centroids(spark, monkeypatch):
    from pyspark.sql import functions as F
    from fluxsieve.operators import kmeans
    monkeypatch.setattr(kmeans, "BLOCK_POINTS", 20)
    monkeypatch.setattr(kmeans, "GROUP", 1)
    rng = np.random.RandomState(2)
    pdf = pd.DataFrame(rng.uniform(0, 100, (4000, 2)), columns=["u", "v"])
    pdf["dimx"], pdf["label"] = np.arange(4000), "a"
    many = spark.createDataFrame(pdf).withColumn("__c", F.lit(0))
    blocks = kmeans._Blocks(many, ["u", "v"], "dimx", "label")
    cents = spark.createDataFrame(pdf[::10]).select("label", F.col("dimx").cast("int").alias("__c"), "u", "v")
    per_block = blocks.needed(cents).groupBy("__block").count().agg(F.max("count"), F.count("*")).first()
    assert per_block[1] >= 30 and per_block[0] <= 80                           # of 400 centroids
    assert blocks.points.groupBy("__block").count().agg(F.max("count")).first()[0] < 400


def brute_levels(X, eps):
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    lab = np.arange(len(X))
    while True:
        new = np.array([lab[row].min() for row in d2 <= eps * eps])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("most,small", [(20_000, 200_000), (15, 200_000), (15, 0)])
def test_level_forest_cuts_like_single_linkage(spark, most, small, monkeypatch):
    from fluxsieve.operators import forest
    monkeypatch.setattr(forest, "SMALL", small)
    rng = np.random.RandomState(4)
    X = np.vstack([rng.normal(0, 0.3, (150, 3)), rng.normal(3, 0.6, (80, 3)), rng.uniform(-6, 8, (120, 3)), np.zeros((20, 3))])
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf["dimx"] = np.arange(len(X))
    levels = [0.25, 0.5, 0.75, 1.0]
    spots = forest.sites(spark.createDataFrame(pdf), ["a", "b", "c"], "dimx")
    tree = forest.LevelForest(spots, ["a", "b", "c"], levels, tile_points=most)
    chain = {r.site: r.chain for r in tree.members.join(tree.parts, "part").collect()}
    site = {i: min(np.flatnonzero((X == X[i]).all(axis=1))) for i in range(len(X))}
    for k, eps in enumerate(levels):
        want = brute_levels(X, eps)
        got = [chain[site[i]][k].cluster for i in range(len(X))]
        pairs = set(zip(want.tolist(), got))
        assert len(pairs) == len(set(want.tolist())) == len(set(got))
        assert [chain[site[i]][k].size for i in range(len(X))] == [int((want == w).sum()) for w in want]


@pytest.mark.parametrize("kw", [dict(zeta=0.5, tau=0.05, min_reduction=6),
                                dict(min_eps=0.05, eps_step=0.25, reduction_threshold=4, min_reduction=8, final_pass_keeps_rest=True)])
def test_forest_and_passes_keep_the_same_ids(spark, kw):
    rng = np.random.RandomState(8)
    X = np.vstack([rng.normal(0, 0.25, (120, 2)), rng.normal(4, 0.6, (60, 2)), rng.uniform(-6, 9, (40, 2)), rng.normal(-4, 0.05, (12, 2)), np.full((30, 2), 7.0)])
    pdf = pd.DataFrame(np.round(X * 64) / 64, columns=["u", "v"])
    pdf["dimx"] = rng.permutation(len(X)) * 3 + 1
    s = thin.ThinSettings(**{**dict(dims=["u", "v"], initial_eps=0.6, eps_step=0.1, reduction_threshold=25, min_eps=0.5, min_samples=2, min_cluster_size=4), **kw})
    scaled = spark.createDataFrame(pdf)
    got, want = ({r.dimx for r in f(scaled, s, "dimx", 40).collect()} for f in (thin._kept_by_forest, thin._kept_by_passes))
    assert got == want and len(got) > 10


def test_dense_spot_tests_no_pairs(monkeypatch):
    """10^5 points within 4 radii: cells settle cores and components, so a task's time does not grow with its pairs."""
    from fluxsieve.operators import tiles
    tested = []
    plain = tiles.near

    def counted(Q, X, radius):
        for rows, cand, d2 in plain(Q, X, radius):
            tested.append(d2.size)
            yield rows, cand, d2

    monkeypatch.setattr(tiles, "near", counted)
    X = np.random.RandomState(0).uniform(0, 4, (100_000, 3))
    assert (tiles.level_labels(X, [0.5, 1.0]) == 0).all()
    assert tiles.core_points(X, np.ones(len(X), np.int64), 1.0, 5).all()
    assert sum(tested) == 0


def test_dense_spot_is_dealt_to_many_tiles(spark):
    from pyspark.sql import functions as F
    from fluxsieve.operators import tiles
    pdf = pd.DataFrame(np.random.RandomState(0).uniform(0, 4, (100_000, 2)), columns=["u", "v"])
    pdf.loc[len(pdf)] = [500.0, 500.0]
    seen = tiles.tiled(spark.createDataFrame(pdf), ["u", "v"], 1.0, 1.0, [], tile_points=8_000)
    width = F.element_at(F.array(*map(F.lit, tiles.STEPS)), F.col("step") + 1)
    own = (F.floor(F.col("u") / width) == F.col("tile")[0]) & (F.floor(F.col("v") / width) == F.col("tile")[1])
    sizes = seen.groupBy("step", "tile").agg(F.count_if(own).alias("own"), F.count("*").alias("all")).collect()
    assert sum(r.own for r in sizes) == len(pdf) and max(r.own for r in sizes) <= 8_000
    assert max(r["all"] for r in sizes) <= 60_000 and {r.step for r in sizes} >= {0, 5}


def test_forest_of_dense_cells_equals_single_linkage(spark, monkeypatch):
    """Cells of many points stand as one box each; boxes whose corners do not settle a level are taken apart."""
    from pyspark.sql import functions as F
    from fluxsieve.operators import forest, tiles
    sent = []
    plain = tiles.tiled

    def counted(points, *rest):
        sent.append(points.count())
        return plain(points, *rest)

    monkeypatch.setattr(tiles, "tiled", counted)
    rng = np.random.RandomState(6)
    X = np.vstack([rng.uniform(0, 1, (700, 2)), rng.uniform(0, 1, (700, 2)) + [1.45, 0], rng.uniform(0, 1, (300, 2)) + [0, 9]])
    pdf = pd.DataFrame(X, columns=["a", "b"])
    pdf["site"] = np.arange(len(X))
    levels = [0.4, 0.46, 0.5]
    tree = forest.LevelForest(spark.createDataFrame(pdf), ["a", "b"], levels)
    chain = {r.site: r.chain for r in tree.members.join(tree.parts, "part").collect()}
    for k, eps in enumerate(levels):
        want = brute_levels(X, eps)
        pairs = {(int(w), chain[i][k].cluster) for i, w in enumerate(want)}
        assert len(pairs) == len(set(want)) == len({c for _, c in pairs})
        assert [chain[i][k].size for i in range(len(X))] == [int((want == w).sum()) for w in want]
    assert len(sent) == 2 and sent[0] < 250 and sent[1] < len(X) - 500            # boxes, then boxes and the points beside the gap


def test_lloyd_looks_at_near_centroids_only(monkeypatch):
    from fluxsieve.operators import kmeans
    rng = np.random.RandomState(3)
    for X in (np.column_stack([np.full(3000, 2.5), np.round(rng.uniform(0, 30, 3000), 2)]), np.round(rng.normal(0, 1, (900, 3)), 1)):
        C, numbers = X[rng.permutation(len(X))[:90]], rng.permutation(90).astype(np.int32)
        d2 = sum((X[:, j][:, None] - C[:, j][None, :]) ** 2 for j in range(X.shape[1]))
        least = np.where(d2 == d2.min(axis=1)[:, None], numbers[None, :], 99).min(axis=1)
        assert (kmeans.nearest(X, numbers, C) == least).all()
    asked = []
    monkeypatch.setattr(kmeans, "_nearest_of_all", lambda X, *rest: asked.append(len(X)))
    kmeans.nearest(np.arange(5000.0)[:, None], np.arange(400), np.linspace(0, 5000, 400)[:, None])
    assert not asked


@pytest.mark.parametrize("most", [150, 45])
def test_kmeans_of_repeated_places_settles_in_tasks(spark, monkeypatch, most):
    """A cluster of many points at few places is one task's work, at once or, with more centroids than a task takes, after one
    iteration; nothing is iterated in Spark."""
    from fluxsieve.operators import kmeans
    steps, plain = [], kmeans._Blocks.step

    def counted(self):
        steps.append(self.points.count())
        assert len(steps) == 1
        return plain(self)

    monkeypatch.setattr(kmeans._Blocks, "step", counted)
    rng = np.random.RandomState(17)
    X = rng.randint(-40, 41, (40, 2))[rng.randint(0, 40, 900)] / 8
    ids = rng.permutation(900) * 5 + 2
    df = spark.createDataFrame([(int(i), "a", float(x), float(y)) for i, (x, y) in zip(ids, X)], "dimx long, label string, u double, v double")
    k = spark.createDataFrame([("a", 60, 900)], "label string, k int, npts long")
    got = kmeans.representatives(df, ["u", "v"], k, max_group=most).collect()
    assert {r.label: r.dimx for r in got} == {"a": brute_lloyd(X, ids, 60)}
    assert len(steps) == (most < 60)


def test_lloyd_sums_only_what_changed():
    """Centroids that keep their places are left as they are; the outcome is that of plain iterations, to the last bit."""
    from fluxsieve.operators import kmeans
    rng = np.random.RandomState(5)
    for X in (np.column_stack([np.full(4000, 0.3), rng.randint(0, 900, 4000) / 100 - 0.7]), np.round(rng.normal(0, 1, (1500, 3)), 2)):
        start = rng.randint(0, 120, len(X)).astype(np.int32)
        lab = start
        while True:
            ids, code = np.unique(lab, return_inverse=True)
            cents = np.column_stack([np.bincount(code, X[:, k]) for k in range(X.shape[1])]) / np.bincount(code)[:, None]
            new = kmeans._nearest_of_all(X, ids, cents)
            if np.array_equal(new, lab):
                break
            lab = new
        got_ids, got = kmeans.lloyd(X, start)
        assert np.array_equal(got_ids, ids) and np.array_equal(got, cents)
