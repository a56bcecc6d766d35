"""Density thinning (2.H): rescale, DBSCAN, cluster classes, k-means representatives and
the two-step thinning loop, as Spark jobs.

DBSCAN in tiles
---------------
Points are shuffled once, to their own tile and to the tiles within ``2 eps`` (``tiles``: tiles that
shrink where points are dense).  A tile sees every neighbour of every point within ``eps`` of its box:
it settles exactly which of those are core, and which core points among them hang together.  A core
point near a border is seen by several tiles; where it is seen twice, the two tiles' local clusters
are one.  These links, far fewer than the points, are solved in Spark (``components``).  Border points
take the smallest label among the clusters of their core neighbours (deterministic; a visit-order
rule is not).

Thinning
--------
With up to two samples to a cluster the levels of the thinning loop are cuts of one spanning forest
(``forest``); every point's way through the loop follows from the sizes of its clusters.  With more
samples border points make a level depend on what earlier levels removed, and the loop is run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from . import tiles
from .forest import LevelForest, finite, tied
from .kmeans import representatives


# ----------------------------------------------------------------- H-01, H-05, H-09

def rescale(df: DataFrame, dims, unit_variance: bool = False, decimals: int | None = None) -> DataFrame:
    """H-01: centre each dim on its mean (the reference's effective behaviour);
    ``unit_variance=True`` also divides by the population std; ``decimals``: means from
    exact decimal sums (order-independent)."""
    from ..functions.numeric import exact_mean
    mean = (lambda d: F.avg(d)) if decimals is None else (lambda d: exact_mean(F.col(d), decimals))
    aggs = [mean(d).alias(f"m_{d}") for d in dims] + [F.stddev_pop(d).alias(f"s_{d}") for d in dims]
    st = df.agg(*aggs).first()
    cols = []
    for d in dims:
        c = F.col(d) - F.lit(st[f"m_{d}"])
        if unit_variance and st[f"s_{d}"]:
            c = c / F.lit(st[f"s_{d}"])
        cols.append(c.alias(d))
    return df.select(*[F.col(c) for c in df.columns if c not in dims], *cols)


def k_expression(density, npts, rfmin, tau, zeta=1.0):
    """H-05 as a column expression (or plain numbers)."""
    if not isinstance(density, Column):
        kb = float(npts) / float(rfmin)
        a = 1.0 - math.exp(-float(tau) * float(density))
        return max(1, int(math.floor(kb * (1.0 - zeta) + zeta * (kb * (1.0 - a) + a))))
    kb = F.col(npts) / F.lit(float(rfmin)) if isinstance(npts, str) else npts / F.lit(float(rfmin))
    a = F.lit(1.0) - F.exp(-F.lit(float(tau)) * density)
    return F.greatest(F.lit(1), F.floor(kb * (1.0 - zeta) + F.lit(zeta) * (kb * (1.0 - a) + a)).cast("int"))


def max_resolvable_density(reduction_threshold: float, min_eps: float, num_dim: int) -> float:
    """H-09: the density at which clusters of the threshold's size still part at the least eps."""
    return reduction_threshold / (min_eps ** num_dim)


def density_against_limit(df: DataFrame, dims, reduction_threshold: float, min_eps: float) -> DataFrame:
    """H-09 on data: the limit, the occupied cubes of side ``min_eps``, those denser than the limit, the densest."""
    limit = max_resolvable_density(reduction_threshold, min_eps, len(dims))
    cubes = df.groupBy(*[F.floor(F.col(x) / F.lit(min_eps)).alias(x) for x in dims]).agg((F.count("*") / F.lit(min_eps ** len(dims))).alias("density"))
    return cubes.agg(F.lit(limit).alias("limit"), F.count("*").alias("cubes"), F.count_if(F.col("density") > limit).alias("denser"),
                     F.max("density").alias("densest"))


# ----------------------------------------------------------------- H-02

def _tile_clusters(X: np.ndarray, close: np.ndarray, eps: float, min_samples: int):
    """Core flags (right for points close to the tile), local cluster of each close core point (-1 otherwise), and
    (non-core point, local cluster) pairs of close points beside a core point."""
    core = tiles.core_points(X, np.ones(len(X), np.int64), eps, min_samples)
    live = np.flatnonzero(core & close)
    local = np.full(len(X), -1, np.int64)
    local[live] = tiles.level_labels(X[live], [eps])[0]
    loose, rim = np.flatnonzero(~core & close), [np.zeros((0, 2), np.int64)]
    for rows, cand, d2 in tiles.near(X[loose], X[live], eps):
        i, j = np.nonzero(d2 <= eps * eps)
        rim.append(np.unique(np.column_stack([loose[rows[i]], local[live[cand[j]]]]), axis=0))
    return core, local, np.concatenate(rim)


#: Label of points in no cluster; a cluster's label names the least of its tiles' local clusters.
NOISE = "noise"

#: What a tile says of a point: its own core point, a neighbouring tile's core point, its own border point.
OWN_CORE, OTHER_CORE, BORDER = 0, 1, 2


def dbscan(df: DataFrame, dims, eps: float, min_samples: int = 1, key: str = "dimx", tile_points: int = tiles.TILE_POINTS) -> DataFrame:
    """H-02: ``key, label`` for every point (``NOISE`` = in no cluster), Euclidean distance on ``dims``,
    ``dist <= eps`` is a neighbour, a point counts itself.  ``tile_points`` changes the cost, never the result."""
    ship_package(df.sparkSession)
    points = df.select(F.col(key), *[F.col(x).cast("double").alias(x) for x in dims])
    if min_samples <= 2:
        return _linked(points, dims, eps, min_samples, key, tile_points)
    key_type = points.schema[key].dataType.simpleString()

    def solve(group, table):
        step, tile = group[0].as_py(), group[1].as_py()
        X = np.column_stack([table.column(x).to_numpy() for x in dims])
        own, at = tiles.own_rows(X, step, tile, eps), np.array(tile, np.float64)
        width, margin = tiles.STEPS[step] * eps, eps * (1 + 1e-9)
        close = own | ((X >= at * width - margin) & (X <= (at + 1) * width + margin)).all(axis=1)
        core, local, rim = _tile_clusters(X, close, eps, min_samples)
        a = np.flatnonzero(local >= 0)
        rim = rim[own[rim[:, 0]]]
        rows = np.concatenate([a, rim[:, 0]])
        name = f"{step}:" + ",".join(map(str, tile)) + "|"
        comp = [name + str(c) for c in np.concatenate([local[a], rim[:, 1]]).tolist()]
        role = np.concatenate([np.where(own[a], OWN_CORE, OTHER_CORE), np.full(len(rim), BORDER)])
        return pa.table([table.column(key).take(pa.array(rows, pa.int64())), pa.array(comp, pa.string()), pa.array(role, pa.int32())],
                        names=[key, "comp", "role"])

    seen = tiles.tiled(points, dims, eps, 2 * eps * (1 + 1e-6), [key], tile_points)
    seen = cut_lineage(seen.groupBy("step", "tile").applyInArrow(solve, f"{key} {key_type}, comp string, role int"))
    other = seen.filter(F.col("role") == OTHER_CORE).select(key, F.col("comp").alias("b"))
    named = seen.filter(F.col("role") != OTHER_CORE).select(key, "comp")
    if other.isEmpty():                                    # no core point near any border: local clusters are final
        found = named.groupBy(key).agg(F.min("comp").alias("label"))
    else:
        mine = seen.filter(F.col("role") == OWN_CORE).select(key, F.col("comp").alias("a"))
        roots = tied(mine.join(other, key))
        comps = seen.select("comp").distinct().join(roots.withColumnRenamed("node", "comp"), "comp", "left") \
            .select("comp", F.coalesce("root", "comp").alias("root"))
        label_of = comps.join(comps.groupBy("root").agg(F.min("comp").alias("label")), "root").select("comp", "label")
        found = named.join(label_of, "comp").groupBy(key).agg(F.min("label").alias("label"))
    return points.select(key).join(found, key, "left").select(key, F.coalesce("label", F.lit(NOISE)).alias("label"))


def _linked(points: DataFrame, dims, eps: float, min_samples: int, key: str, tile_points: int) -> DataFrame:
    """:func:`dbscan` with up to two samples: every point beside another one is core, so clusters are a forest's
    components; its boxes of close points stand for the points, which are shuffled once, by their key."""
    tree = LevelForest(points, dims, [eps], tile_points)
    named = tree.parts.select("part", F.col("chain")[0]["cluster"].alias("label"), F.col("chain")[0]["size"].alias("size"))
    if min_samples == 2:
        named = named.filter("size > 1")
    label = F.when(F.col(key).isNotNull(), F.col("label"))
    found = tree.placed(points).join(named.drop("size"), "part", "left").select(key, label.alias("label"))
    found = found.unionByName(points.filter(~finite(dims)).select(key, F.lit(None).cast("string").alias("label")))
    # rows of one key share a label
    keyed = found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    keyed = keyed.select(key, "label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")
    return keyed.unionByName(found.filter(F.col(key).isNull())).select(key, F.coalesce("label", F.lit(NOISE)).alias("label"))


# ----------------------------------------------------------------- H-03

def classify_clusters(labels: DataFrame, min_cluster_size: int, reduction_threshold: int,
                      reduce_next: bool = False) -> DataFrame:
    """H-03: per point ``cls`` in toss / next / reduce / keep from its cluster size."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    j = labels.join(sizes, "label")
    big = F.col("size") > min_cluster_size
    over = F.col("size") > reduction_threshold + 1
    cls = (F.when(F.col("label") == NOISE, "toss")
           .when(big & over, "reduce" if reduce_next else "next")
           .when(big, "reduce").otherwise("keep"))
    return j.withColumn("cls", cls)


# ----------------------------------------------------------------- H-04

def local_density(points: DataFrame, dims, radius: float, key: str = "dimx", cluster: str = "label",
                  tile_points: int = tiles.TILE_POINTS) -> DataFrame:
    """H-04: per cluster, max over points of (neighbours of the cluster within ``radius``, excluding self)
    / radius^d, and its points.

    Points are counted into the cells of a grid first.  Cells wholly within ``radius`` of each other, and those partly
    within, bound the count of every point of a cell from below and above; neighbours are counted, in tiles with a halo of
    ``radius``, only for the cells whose bound is above the greatest count that is sure in their cluster.
    """
    ship_package(points.sparkSession)
    label_type, square = points.schema[cluster].dataType.simpleString(), radius * radius
    side, cell, his = tiles.close_side(len(dims), radius) / 2, [f"__c{i}" for i in range(len(dims))], [f"__hi_{x}" for x in dims]
    known = points.filter(finite(dims)).select(F.col(cluster), *[F.col(x).cast("double").alias(x) for x in dims])
    known = known.withColumns({c: F.floor(F.col(x) / F.lit(side)) for c, x in zip(cell, dims)})
    boxes = known.groupBy(cluster, *cell).agg(F.count(F.lit(1)).alias("__n"), *[F.min(x).alias(x) for x in dims], *[F.max(x).alias(h) for x, h in zip(dims, his)])
    boxes = cut_lineage(boxes.withColumn("__id", F.monotonically_increasing_id()))

    def columns(table, names):
        return np.column_stack([table.column(x).to_numpy() for x in names])

    def clusters(table):
        return np.unique(np.array([str(c) for c in table.column(cluster).to_pylist()]), return_inverse=True)[1].ravel()

    def bounds(group, table):
        X, X_hi, n, code = columns(table, dims), columns(table, his), table.column("__n").to_numpy().astype(np.float64), clusters(table)
        own = np.flatnonzero(tiles.own_rows(X, group[0].as_py(), group[1].as_py(), radius))
        sure, may = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for rows, cand, least, most in tiles.near_boxes(X[own], X_hi[own], X, X_hi, radius):
            same = code[own[rows]][:, None] == code[cand][None, :]
            sure[rows], may[rows] = ((most <= square) & same) @ n[cand], ((least <= square) & same) @ n[cand]
        return pa.table([table.column("__id").take(pa.array(own, pa.int64())), pa.array(sure), pa.array(may)], names=["__id", "sure", "may"])

    def beside(group, table):
        X, X_hi, open_, code = columns(table, dims), columns(table, his), table.column("open").to_numpy(zero_copy_only=False), clusters(table)
        own = np.flatnonzero(open_ & tiles.own_rows(X, group[0].as_py(), group[1].as_py(), radius))
        seen = np.zeros(len(X), bool)
        for rows, cand, least, _ in tiles.near_boxes(X[own], X_hi[own], X, X_hi, radius):
            seen[cand[((least <= square) & (code[own[rows]][:, None] == code[cand][None, :])).any(axis=0)]] = True
        return table.select(["__id"]).filter(pa.array(seen))

    def count(group, table):
        X, n, open_, code = columns(table, dims), table.column("__n").to_numpy().astype(np.float64), table.column("open").to_numpy(zero_copy_only=False), clusters(table)
        own = np.flatnonzero(open_ & tiles.own_rows(X, group[0].as_py(), group[1].as_py(), radius))
        nb = np.zeros(len(own), np.int64)
        for rows, cand, d2 in tiles.near(X[own], X, radius):
            nb[rows] = ((d2 <= square) & (code[own[rows]][:, None] == code[cand][None, :])) @ n[cand]
        return pa.table([table.column(cluster).take(pa.array(own, pa.int64())), pa.array(nb, pa.int64())], names=[cluster, "nb"])

    def spread(rows, keep, solve, schema, halo):
        return tiles.tiled(rows, dims, radius, halo * (1 + 1e-6), keep, tile_points).groupBy("step", "tile").applyInArrow(solve, schema)

    bounded = spread(boxes, ["__id", cluster, "__n", *his], bounds, "__id bigint, sure bigint, may bigint", radius + side)
    bounded = cut_lineage(boxes.join(bounded, "__id"))
    best = cut_lineage(bounded.groupBy(cluster).agg(F.max("sure").alias("sure"), F.sum("__n").alias("npts")))
    above = F.col("may") > F.col("best")
    flagged = cut_lineage(bounded.withColumnRenamed(cluster, "__of").join(best.select(F.col(cluster).alias("__as"), F.col("sure").alias("best")), F.col("__of").eqNullSafe(F.col("__as")))
                          .withColumnRenamed("__of", cluster).select("__id", cluster, *cell, *dims, *his, above.alias("open")))
    out = best.select(cluster, F.col("sure").alias("nb"), "npts")
    if not flagged.filter("open").isEmpty():
        wanted = spread(flagged, ["__id", cluster, "open", *his], beside, "__id bigint", radius + side).distinct()
        wanted = cut_lineage(flagged.join(wanted, "__id").select(cluster, *cell, "open"))
        at = [F.col(c).eqNullSafe(F.col(f"__at_{c}")) for c in [cluster, *cell]]
        places = known.join(wanted.select(*[F.col(c).alias(f"__at_{c}") for c in [cluster, *cell]], "open"), at).groupBy(cluster, "open", *dims).agg(F.count(F.lit(1)).alias("__n"))
        counted = spread(cut_lineage(places), [cluster, "__n", "open"], count, f"{cluster} {label_type}, nb bigint", radius)
        out = out.unionByName(counted.select(cluster, "nb", F.lit(0).cast("long").alias("npts")))
    return out.groupBy(cluster).agg(((F.max("nb") - 1) / F.lit(radius ** len(dims))).alias("density"), F.sum("npts").alias("npts"))


# ----------------------------------------------------------------- H-07

@dataclass
class ThinSettings:
    dims: list
    initial_eps: float = 1.0
    reduction_threshold: int = 50
    min_eps: float = 0.3
    min_reduction: int = 20
    min_samples: int = 2
    min_cluster_size: int = 6
    zeta: float = 0.0
    tau: float = 1000.0
    num_dim: int | None = None
    unit_variance: bool = False
    final_pass_keeps_rest: bool = False
    eps_step: float = 0.05


def _reduce(pts: DataFrame, s: ThinSettings, radius: float, key: str) -> DataFrame:
    """Ids of the k-means representatives of the clusters ``label`` in ``pts`` (key, label and the dims)."""
    if s.zeta == 0.0:
        ks = pts.groupBy("label").agg(F.count(F.lit(1)).alias("npts"))
        ks = ks.withColumn("k", k_expression(F.lit(0.0), F.col("npts"), s.min_reduction, s.tau, 0.0))
    else:
        dens = local_density(pts, s.dims, radius, key)
        ks = dens.withColumn("k", k_expression(F.col("density"), F.col("npts"), s.min_reduction, s.tau, s.zeta))
    return representatives(pts, s.dims, ks, key).select(key)


def pass_radii(s: ThinSettings) -> list[float]:
    """Radii of the passes: the first at 1, then from ``initial_eps`` down, the last one being the first below ``min_eps``
    (or the last above 0)."""
    out = [s.initial_eps]
    while out[-1] >= s.min_eps and out[-1] - s.eps_step > 0:
        out.append(out[-1] - s.eps_step)
    return [1.0, *out]


def two_step_thinning(df: DataFrame, s: ThinSettings, key: str = "dimx", tile_points: int = tiles.TILE_POINTS) -> DataFrame:
    """H-07: the thinning loop; returns the original rows of the kept ids.

    First pass at eps 1 (noise thrown away, small clusters kept, mid-size clusters
    reduced to one point, large clusters passed on); then eps from ``initial_eps``
    down by ``eps_step`` with noise kept, until eps < min_eps, nothing is left or no
    cluster is found; then a last pass that also reduces the large clusters.
    """
    base = df.select(key, *s.dims).dropna()
    scaled = cut_lineage(rescale(base, s.dims, s.unit_variance))
    nested = s.min_samples <= 2 and s.initial_eps <= 1.0 and s.eps_step > 0
    kept = (_kept_by_forest if nested else _kept_by_passes)(scaled, s, key, tile_points)
    # written first: as a table of known size the few kept ids go to the rows, which need no shuffle
    return df.join(cut_lineage(kept.distinct()), key, "left_semi")


def _kept_by_forest(scaled: DataFrame, s: ThinSettings, key: str, tile_points: int) -> DataFrame:
    """Kept ids from one spanning forest: the pass at which a point leaves the loop is the first at which its cluster
    is not passed on, and sizes of clusters say so for whole components at a time."""
    passes = pass_radii(s)
    levels = sorted(set(passes))
    tree = LevelForest(scaled, s.dims, levels, tile_points)
    at = [levels.index(e) for e in passes]
    size = [F.col("chain")[k]["size"] for k in at]
    noise = [(n == 1) if s.min_samples == 2 else F.lit(False) for n in size]
    goes_on = [~lone & (n > max(s.reduction_threshold + 1, s.min_cluster_size)) for lone, n in zip(noise, size)]
    present = [reduce(lambda a, b: a & b, goes_on[:t], F.lit(True)) for t in range(len(passes))]
    totals = tree.parts.agg(*[F.sum(F.when(p, F.col("weight"))).alias(f"p{t}") for t, p in enumerate(present)],
                            *[F.sum(F.when(p & ~lone, F.col("weight"))).alias(f"c{t}") for t, (p, lone) in enumerate(zip(present, noise))]).first()
    # the first pass at which points are left but no cluster is
    stop = next((t for t in range(len(passes)) if totals[f"p{t}"] and not totals[f"c{t}"]), len(passes))
    none = scaled.select(key).limit(0)
    if not totals["p0"] or stop == 0:
        return none
    way = F.lit(None).cast("struct<cls:string,at:int>")
    for t in reversed(range(min(stop, len(passes)))):
        lone = F.lit("toss" if t == 0 else "keep")
        cls = F.when(noise[t], lone).when(size[t] > s.min_cluster_size, "reduce").otherwise("keep")
        way = F.when(~goes_on[t], F.struct(cls.alias("cls"), F.lit(t).alias("at"))).otherwise(way)
    last = at[min(stop, len(passes)) - 1]
    # large to the end: reduced by the last pass, unless there was no cluster left
    rest = F.struct(F.lit("last" if stop == len(passes) else "rest").alias("cls"), F.lit(len(passes) - 1).alias("at"))
    parts = tree.parts.select("part", F.coalesce(way, rest).alias("way"), "chain") \
        .select("part", "way.cls", "way.at", F.when(F.col("way.cls") == "reduce", F.get("chain", F.element_at(F.array(*map(F.lit, at)), F.col("way.at") + 1)))
                .otherwise(F.get("chain", F.lit(last)))["cluster"].alias("label"))
    classes = cut_lineage(tree.placed(scaled).join(parts, "part").select(key, *s.dims, "cls", "at", "label"))
    kept = [classes.filter(F.col("cls").isin("keep", *(["rest"] if s.final_pass_keeps_rest else []))).select(key)]
    radius = [s.initial_eps, *passes[1:]]
    reduced = classes.filter(F.col("cls").isin("reduce", "last"))
    if s.zeta == 0.0:
        kept.append(_reduce(reduced, s, 0.0, key))
    else:                                                      # the density of a cluster is counted within its pass's radius
        for t in sorted(r[0] for r in reduced.select("at").distinct().collect()):
            kept.append(_reduce(reduced.filter(F.col("at") == t), s, radius[t], key))
    return reduce(lambda a, b: a.unionByName(b), kept)


def _kept_by_passes(scaled: DataFrame, s: ThinSettings, key: str, tile_points: int) -> DataFrame:
    """Kept ids by running the passes one after the other, each a set of Spark jobs over the shrinking set, checkpointed."""
    kept = []

    def run(cur, eps, reduce_next=False):
        lab = dbscan(cur, s.dims, eps, s.min_samples, key, tile_points)
        # written once with the coordinates: representatives and the next pass read this table
        cls = cut_lineage(classify_clusters(lab, s.min_cluster_size, s.reduction_threshold, reduce_next).join(cur, key))
        return None if cls.filter(F.col("label") != NOISE).isEmpty() else cls

    def pick(cls, *names):
        return cls.filter(F.col("cls").isin(*names)).select(key, "label", *s.dims)

    cls = run(scaled, 1.0)
    if cls is None:
        return scaled.select(key).limit(0)
    kept += [pick(cls, "keep").select(key), _reduce(pick(cls, "reduce"), s, s.initial_eps, key)]
    cur = pick(cls, "next").drop("label")
    for eps in pass_radii(s)[1:]:
        cls = run(cur, eps)
        if cls is None:
            break
        kept += [pick(cls, "toss", "keep").select(key), _reduce(pick(cls, "reduce"), s, eps, key)]
        cur = pick(cls, "next").drop("label")
        if cur.isEmpty():
            break
    if not cur.isEmpty():
        cls = run(cur, eps, reduce_next=True)
        if cls is not None:
            kept.append(_reduce(pick(cls, "reduce"), s, eps, key))
            if s.final_pass_keeps_rest:
                kept.append(pick(cls, "toss", "keep").select(key))
        elif s.final_pass_keeps_rest:
            kept.append(cur.select(key))
    return reduce(lambda a, b: a.unionByName(b), kept)
