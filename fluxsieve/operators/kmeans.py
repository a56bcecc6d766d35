"""k-means representatives of clusters (H-06), whatever the size of a cluster.

Lloyd's iterations, always started from the hash partition of the points.  Clusters of at most
``GROUP_POINTS`` points run in one task each.  Of a larger one the first centroids are summed in Spark; from then on
points of one place share a centroid, so a place and its weight stand for them, and clusters of few places run in one task each.
A cluster of more places is cut into *blocks* of neighbouring places, its centroids into
groups of neighbouring ones; in an iteration only boxes are compared: a group whose box is farther from a
block's box than some other group's farthest corner cannot hold the nearest centroid of any place there.
A block is then sent the centroids of the groups that are left, so no row pairs a place with a centroid.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

#: Points (or places, or centroids) of a cluster that one task takes, places of a block (about), places that share a block's box at most,
#: centroids of a group (about), distances at a time, centroids on each side that a point looks at before it looks at all, bits of
#: each of the two whole numbers that a coordinate is summed as.
GROUP_POINTS, BLOCK_POINTS, BLOCK_MOST, GROUP, CHUNK, LOOKS, BITS = 200_000, 1024, 4096, 64, 1 << 21, 6, 28


def _dist2(a_cols, b_cols) -> Column:
    return reduce(lambda x, y: x + y, [(a - b) * (a - b) for a, b in zip(a_cols, b_cols)])


def first_assignment(key: str, k: str = "k") -> Column:
    """Centroid number each point starts with."""
    return F.pmod(F.xxhash64(F.col(key)), F.col(k)).cast("int")


def nearest(X: np.ndarray, numbers: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each point; ties go to the lowest number.

    Along the dim that the centroids spread most in, a point looks at the centroids on both sides of it until the next
    ones are farther away in this dim alone than the nearest found; points with more than ``LOOKS`` a side look at all.
    """
    n, k = len(X), len(numbers)
    if not n or k <= LOOKS:
        return _nearest_of_all(X, numbers, centroids)
    axis = int(np.argmax(centroids.max(axis=0) - centroids.min(axis=0)))
    line = np.argsort(centroids[:, axis], kind="stable")
    C, told = centroids[line], numbers[line]
    at = np.searchsorted(C[:, axis], X[:, axis])
    best, out = np.full(n, np.inf), np.full(n, np.iinfo(numbers.dtype).max, numbers.dtype)
    open_rows = {-1: np.arange(n), 1: np.arange(n)}
    for step in range(LOOKS):
        for side in (-1, 1):
            rows = open_rows[side]
            place = at[rows] + (step if side > 0 else -1 - step)
            inside = (place >= 0) & (place < k)
            rows, place = rows[inside], place[inside]
            near_by = (X[rows, axis] - C[place, axis]) ** 2 <= best[rows]
            rows, place = rows[near_by], place[near_by]
            d2 = np.zeros(len(rows))
            for j in range(X.shape[1]):
                d2 += (X[rows, j] - C[place, j]) ** 2
            better = (d2 < best[rows]) | ((d2 == best[rows]) & (told[place] < out[rows]))
            best[rows[better]], out[rows[better]] = d2[better], told[place[better]]
            open_rows[side] = rows
        if not len(open_rows[-1]) and not len(open_rows[1]):
            return out
    rest = np.union1d(open_rows[-1], open_rows[1])
    out[rest] = _nearest_of_all(X[rest], numbers, centroids)
    return out


def _nearest_of_all(X: np.ndarray, numbers: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """:func:`nearest` by comparing with every centroid."""
    order = np.argsort(numbers, kind="stable")
    numbers, centroids = numbers[order], centroids[order]
    out, rows = np.empty(len(X), numbers.dtype), max(1, CHUNK // max(len(numbers), 1))
    for at in range(0, len(X), rows):
        d2 = np.zeros((len(X[at:at + rows]), len(numbers)))
        for k in range(X.shape[1]):
            d2 += (X[at:at + rows, k][:, None] - centroids[:, k][None, :]) ** 2
        out[at:at + rows] = numbers[np.argmin(d2, axis=1)]
    return out


def lloyd(X: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's iterations from an assignment until no point moves: ``(numbers, centroids)`` left (empty ones drop out).

    A place that several points share is assigned once; a centroid's sum runs over its points in their order.
    """
    places, of = np.unique(X, axis=0, return_inverse=True)
    of, (ids, code) = of.ravel(), np.unique(start, return_inverse=True)
    cents = np.column_stack([np.bincount(code, X[:, k]) for k in range(X.shape[1])]) / np.bincount(code)[:, None]
    lab = nearest(places, ids, cents)
    return (ids, cents) if np.array_equal(lab[of], start) else settled(places, lab, X, of)


def settled(places: np.ndarray, lab: np.ndarray, X: np.ndarray, of: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's iterations from ``lab``, the number of the nearest centroid of each place, until no place moves; sums run over the
    rows ``X`` (``of``: their places), each counted ``weight`` times.

    A centroid that neither lost nor won a place stays where it is, to the last bit: it is not summed again, and its places
    look only at the centroids that moved.
    """
    lab, size = lab.astype(np.int64), int(lab.max()) + 1
    cents, changed = np.zeros((size, X.shape[1])), np.ones(size, bool)
    while True:
        ask = changed[lab]
        rows = np.flatnonzero(ask[of])
        code, w = lab[of[rows]], None if weight is None else weight[rows].astype(np.float64)
        n = np.bincount(code, w, size)
        there = n > 0
        for k in range(X.shape[1]):
            cents[there, k] = (np.bincount(code, X[rows, k] if w is None else X[rows, k] * w, size))[there] / n[there]
        ids = np.flatnonzero(np.bincount(lab, minlength=size))
        moved = ids[changed[ids]]
        new = lab.copy()
        new[ask] = nearest(places[ask], ids, cents[ids])
        rest = np.flatnonzero(~ask)
        if len(rest):
            other = nearest(places[rest], moved, cents[moved])
            d_own, d_other = np.zeros(len(rest)), np.zeros(len(rest))
            for k in range(X.shape[1]):
                d_own += (places[rest, k] - cents[lab[rest], k]) ** 2
                d_other += (places[rest, k] - cents[other, k]) ** 2
            goes = (d_other < d_own) | ((d_other == d_own) & (other < lab[rest]))
            new[rest[goes]] = other[goes]
        went = new != lab
        if not went.any():
            return ids, cents[ids]
        changed = np.zeros(size, bool)
        changed[lab[went]] = changed[new[went]] = True
        lab = new


def representatives(points: DataFrame, dims, k_per_cluster: DataFrame, key: str = "dimx", cluster: str = "label",
                    max_group: int = GROUP_POINTS) -> DataFrame:
    """H-06: per cluster, the point nearest the *first* (lowest surviving) centroid of a k-means fit, ties to the least id.

    ``k_per_cluster`` has ``k`` and ``npts`` of each cluster.  k = 1: the centroid is the mean and the nearest point a
    ``min_by``.  Clusters of at most ``max_group`` points are one group each; all others go on by places, with the same result.
    """
    ship_package(points.sparkSession)
    ks = cut_lineage(k_per_cluster.select(cluster, "k", "npts").withColumn("__of", F.monotonically_increasing_id()))
    pk = points.select(cluster, key, *dims).join(ks, cluster)
    one = pk.filter(F.col("k") == 1)
    mean = one.groupBy(cluster).agg(*[F.avg(x).alias(f"__m_{x}") for x in dims])
    out = _closest(one, mean, dims, key, cluster)
    many = pk.filter(F.col("k") > 1).withColumn("__c", first_assignment(key))
    small = F.col("npts") <= max_group
    out = out.unionByName(_grouped(many.filter(small), dims, key, cluster))
    if ks.filter((F.col("k") > 1) & ~small).isEmpty():
        return out
    found = _Blocks(many.filter(~small), dims, key, "__of", max_group).representatives()
    return out.unionByName(found.join(ks, "__of").select(cluster, key))


def _closest(points: DataFrame, to: DataFrame, dims, key: str, cluster: str) -> DataFrame:
    """Per cluster the point nearest the place ``__m_<dim>``."""
    d = points.join(to, cluster).withColumn("__d", _dist2([F.col(x) for x in dims], [F.col(f"__m_{x}") for x in dims]))
    return d.groupBy(cluster).agg(F.min_by(key, F.struct("__d", key)).alias(key))


def _grouped(points: DataFrame, dims, key: str, cluster: str) -> DataFrame:
    kinds = dict(points.dtypes)

    def per_cluster(group, table):
        X = np.column_stack([table.column(x).to_numpy() for x in dims]).astype(np.float64)
        order = np.argsort(table.column(key).to_numpy(zero_copy_only=False), kind="stable")     # sums in one order, whatever arrives first
        X = X[order]
        _, cents = lloyd(X, table.column("__c").to_numpy()[order])
        at = order[np.argmin(((X - cents[0]) ** 2).sum(1))]
        return table.select([cluster, key]).slice(int(at), 1)

    return points.select(cluster, key, "__c", *[F.col(x).cast("double").alias(x) for x in dims]).groupBy(cluster) \
        .applyInArrow(per_cluster, f"{cluster} {kinds[cluster]}, {key} {kinds[key]}")


class _Blocks:
    """Lloyd's iterations on clusters of any size.  A cluster of at most ``most`` places and as many centroids is settled in one task;
    ``points`` are the places of all others (``__w`` points at each, the least key), None where there are none."""

    def __init__(self, many: DataFrame, dims, key: str, cluster: str, most: int = 0):
        self.dims, self.key, self.cluster, self.most, self.ended = dims, key, cluster, most, []
        many = many.select(cluster, key, "__c", *[F.col(x).cast("double").alias(x) for x in dims])
        least = F.when(F.count(key) == F.count(F.lit(1)), F.min(key)).alias(key)             # a missing key comes first
        places = cut_lineage(many.groupBy(cluster, *dims).agg(least, F.count(F.lit(1)).alias("__w")))
        far = places.agg(*[F.max(F.abs(x)).alias(x) for x in dims]).first()
        self.scale = {x: 2.0 ** min(BITS - math.frexp(far[x] or 0.0)[1], 1000) for x in dims}
        # hardly two points of a partition share a first centroid: rows are sent as they are
        self.centroids = cut_lineage(self._means(many.drop(key).repartition(cluster, "__c"), F.lit(1)))
        places = self._settle(places)
        self.points = None if places.isEmpty() else self._placed(places)

    def _means(self, rows: DataFrame, weight: Column) -> DataFrame:
        """Centroids (cluster, ``__c``, the dims) of ``rows``.  Sums are those of whole numbers, which no order of the rows changes."""
        sums = []
        for x in self.dims:
            whole = F.rint(F.col(x) * self.scale[x])
            rest = F.rint((F.col(x) * self.scale[x] - whole) * 2.0 ** BITS)
            sums += [F.sum(whole.cast("bigint") * weight).alias(f"__h_{x}"), F.sum(rest.cast("bigint") * weight).alias(f"__l_{x}")]
        out = rows.groupBy(self.cluster, "__c").agg(F.sum(weight).alias("__n"), *sums)
        return out.select(self.cluster, "__c", *[((F.col(f"__h_{x}") + F.col(f"__l_{x}") / 2.0 ** BITS) / self.scale[x] / F.col("__n")).alias(x) for x in self.dims])

    def _settle(self, places: DataFrame) -> DataFrame:
        """Settles the clusters that fit into a task, from ``centroids``; returns the places of the others."""
        cluster, key, dims, kind = self.cluster, self.key, self.dims, dict(places.dtypes)
        sizes = places.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).join(self.centroids.groupBy(cluster).agg(F.count(F.lit(1)).alias("c")), cluster)
        fit = cut_lineage(sizes.filter((F.col("n") <= self.most) & (F.col("c") <= self.most)).select(cluster))

        def settle(group, table, cents):
            X, C = (np.column_stack([t.column(x).to_numpy() for x in dims]) for t in (table, cents))
            order = np.lexsort(X.T)                                                          # sums in one order, whatever arrives first
            X, w = X[order], table.column("__w").to_numpy()[order]
            _, left = settled(X, nearest(X, cents.column("__number").to_numpy(), C), X, np.arange(len(X)), w)
            d = ((X - left[0]) ** 2).sum(1)
            keys = table.column(key).take(pa.array(order[d == d.min()]))
            return pa.table([table.column(cluster).slice(0, 1), pa.array([min(keys.to_pylist(), key=lambda v: (v is not None, v))], keys.type)], names=[cluster, key])

        mine = places.join(fit, cluster, "left_semi").select(cluster, key, "__w", *dims)
        told = self.centroids.join(fit, cluster, "left_semi").select(F.col(cluster).alias("__at"), F.col("__c").alias("__number"), *dims)
        found = mine.groupBy(cluster).cogroup(told.groupBy("__at")).applyInArrow(settle, f"{cluster} {kind[cluster]}, {key} {kind[key]}")
        self.ended.append(cut_lineage(found))
        return places.join(fit, cluster, "left_anti")

    def _cells(self, of: DataFrame, size: int) -> DataFrame:
        """``of`` with ``__cell``: a grid over each cluster's box with about ``size`` rows a cell."""
        span = of.groupBy(self.cluster).agg(F.count("*").alias("__n"), *[F.min(x).alias(f"__lo_{x}") for x in self.dims],
                                            *[F.max(x).alias(f"__hi_{x}") for x in self.dims])
        m = F.ceil(F.pow(F.col("__n") / size, 1.0 / len(self.dims)))
        cells = []
        for x in self.dims:
            wide = F.col(f"__hi_{x}") - F.col(f"__lo_{x}")
            cells.append(F.when(wide > 0, F.least(F.floor((F.col(x) - F.col(f"__lo_{x}")) / F.when(wide > 0, wide) * m), m - 1)).otherwise(0))
        return of.join(span, self.cluster).withColumn("__cell", F.concat_ws(",", *[c.cast("string") for c in cells])).select(*of.columns, "__cell")

    def _boxes(self, of: DataFrame, by: str, prefix: str) -> DataFrame:
        return of.groupBy(self.cluster, by).agg(*[F.min(x).alias(f"{prefix}lo_{x}") for x in self.dims], *[F.max(x).alias(f"{prefix}hi_{x}") for x in self.dims])

    def _placed(self, many: DataFrame) -> DataFrame:
        celled = self._cells(many, BLOCK_POINTS)
        parts = celled.groupBy(self.cluster, "__cell").agg(F.ceil(F.count("*") / BLOCK_MOST).alias("__parts"))
        block = F.concat_ws("|", "__cell", F.pmod(F.xxhash64(*self.dims), F.col("__parts")))
        return cut_lineage(celled.join(parts, [self.cluster, "__cell"]).withColumn("__block", block).drop("__cell", "__parts"))

    def needed(self, centroids: DataFrame) -> DataFrame:
        """``cluster, __block`` beside each centroid (``__c`` and the dims) that may be nearest to a point of the block."""
        celled = cut_lineage(self._cells(centroids, GROUP))
        pairs = self._boxes(self.points, "__block", "p").join(self._boxes(celled, "__cell", "c"), self.cluster)
        least, most = [], []
        for x in self.dims:
            p_lo, p_hi, c_lo, c_hi = (F.col(f"{a}_{x}") for a in ("plo", "phi", "clo", "chi"))
            least.append(F.greatest(c_lo - p_hi, p_lo - c_hi, F.lit(0.0)))
            most.append(F.greatest(c_hi - p_lo, p_hi - c_lo))
        square = lambda cols: reduce(lambda a, b: a + b, [c * c for c in cols])
        pairs = cut_lineage(pairs.select(self.cluster, "__block", "__cell", square(least).alias("least"), square(most).alias("most")))
        bound = pairs.groupBy(self.cluster, "__block").agg(F.min("most").alias("bound"))
        left = pairs.join(bound, [self.cluster, "__block"]).filter(F.col("least") <= F.col("bound") * (1 + 1e-9))
        return left.select(self.cluster, "__block", "__cell").join(celled, [self.cluster, "__cell"]).drop("__cell")

    def step(self) -> bool:
        """One iteration; says whether a place moved."""
        dims, cluster, kind = self.dims, self.cluster, dict(self.points.dtypes)
        told = self.needed(self.centroids).select(F.col(cluster).alias("__of_"), F.col("__block").alias("__at"), F.col("__c").alias("__number"), *dims)
        names = [cluster, self.key, "__w", *dims, "__block"]
        had = "__c" in kind

        def assign(group, table, cents):
            X, C = (np.column_stack([t.column(x).to_numpy() for x in dims]) for t in (table, cents))
            new = nearest(X, cents.column("__number").to_numpy(), C).astype(np.int32)
            moved = new != table.column("__c").to_numpy() if had else np.ones(len(new), bool)
            return pa.table([*[table.column(c) for c in names], pa.array(new), pa.array(moved)], names=[*names, "__c", "__moved"])

        fields = ", ".join(f"{c} {kind[c]}" for c in names) + ", __c int, __moved boolean"
        self.points = cut_lineage(self.points.groupBy(cluster, "__block").cogroup(told.groupBy("__of_", "__at")).applyInArrow(assign, fields))
        if self.points.filter("__moved").isEmpty():
            return False
        self.centroids = self._means(self.points, F.col("__w"))
        return True

    def representatives(self) -> DataFrame:
        first_step = True
        while self.points is not None and self.step():
            if first_step:                                     # centroids are no more than places now
                left = cut_lineage(self._settle(self.points))
                self.points, first_step = None if left.isEmpty() else left, False
        if self.points is not None:
            places = [f"__m_{x}" for x in self.dims]
            first = self.centroids.groupBy(self.cluster).agg(F.min_by(F.struct(*[F.col(x).alias(m) for x, m in zip(self.dims, places)]), "__c").alias("__f"))
            first = first.select(self.cluster, *[F.col(f"__f.{m}").alias(m) for m in places])
            self.ended.append(_closest(self.points, first, self.dims, self.key, self.cluster))
        return reduce(lambda a, b: a.unionByName(b), self.ended)
