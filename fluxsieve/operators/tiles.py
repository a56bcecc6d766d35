"""Space in tiles that adapt to the points, and what a task does with the points of one tile.

A tile is a cube of one of the ``STEPS`` widths.  Counts of points per cube, summed from the narrowest
width up in one job, say which cubes hold more than ``tile_points``; those are split into halves along
every dim, and again, so that a dense spot becomes many narrow tiles while thin space stays in few wide
ones.  A point goes to its own tile and to every tile within ``halo`` of it, found by descending from
the widest tiles; only points in crowded cubes descend.

Inside a task, points are first put into cells so small that neighbouring cells are within reach of
each other throughout: dense regions hang together, and are dense, without testing a pair.  Pairs are
tested only where more than one cluster meets, in blocks of bounded size.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Tile widths (in units of the radius), points a tile should hold at most, rows of one block of distances, rows of
#: crowded cubes that are broadcast, dims up to which neighbouring cells are looked up.
STEPS, TILE_POINTS, BLOCK, BROADCAST_ROWS, CELL_DIMS = (32, 16, 8, 4, 2, 1), 20_000, 512, 50_000, 4


# ----------------------------------------------------------------- on the cluster

def crowded_cubes(points: DataFrame, dims, radius: float, tile_points: int = TILE_POINTS) -> DataFrame:
    """``step, tile`` of the cubes that hold more than ``tile_points`` points, written to the checkpoint folder."""
    finest = points.groupBy(*[F.floor(F.col(x) / F.lit(STEPS[-1] * radius)).alias(f"c{i}") for i, x in enumerate(dims)]).agg(F.count("*").alias("n"))
    wider = [F.struct(F.lit(k).alias("step"), F.array(*[F.floor(F.col(f"c{i}") / F.lit(w // STEPS[-1])) for i in range(len(dims))]).alias("tile"))
             for k, w in enumerate(STEPS[:-1])]
    cubes = finest.select("n", F.explode(F.array(*wider)).alias("cube")).groupBy("cube").agg(F.sum("n").alias("n"))
    return cut_lineage(cubes.filter(F.col("n") > tile_points).select("cube.step", "cube.tile"))


def _product(per_dim: list[Column]) -> Column:
    """All combinations of one element of each array."""
    def longer(heads: Column, own: Column) -> Column:
        return F.flatten(F.transform(heads, lambda t: F.transform(own, lambda v: F.concat(t, F.array(v)))))

    return reduce(longer, per_dim, F.array(F.array().cast("array<bigint>")))


def tiled(points: DataFrame, dims, radius: float, halo: float, keep, tile_points: int = TILE_POINTS) -> DataFrame:
    """Each point once for its own tile and each tile within ``halo``: columns ``keep``, the dims, ``step`` and
    ``tile`` (coordinates in units of the step's width)."""
    crowded = crowded_cubes(points, dims, radius, tile_points)
    small = crowded.count() <= BROADCAST_ROWS

    def reach(x: str, width: float):
        return F.floor((F.col(x) - F.lit(halo)) / F.lit(width)), F.floor((F.col(x) + F.lit(halo)) / F.lit(width))

    top = _product([F.sequence(*reach(x, STEPS[0] * radius)) for x in dims])
    rows = points.select(*keep, *[F.col(x).cast("double").alias(x) for x in dims]) \
        .select("*", F.lit(0).alias("step"), F.explode(top).alias("tile"))
    deepest = crowded.agg(F.max("step")).first()[0]
    for k in range(0 if deepest is None else deepest + 1):
        full = crowded.filter(F.col("step") == k).select("tile", F.lit(True).alias("__full"))
        halves = []
        for i, x in enumerate(dims):
            low, high = reach(x, STEPS[k + 1] * radius)
            at = F.col("tile")[i] * 2
            halves.append(F.sequence(F.greatest(low, at), F.least(high, at + 1)))
        split = F.col("__full").isNotNull() & (F.col("step") == k)
        joined = rows.join(F.broadcast(full) if small else full, "tile", "left")
        rows = joined.select(*keep, *dims, F.when(split, k + 1).otherwise(F.col("step")).alias("step"),
                             F.explode(F.when(split, _product(halves)).otherwise(F.array("tile"))).alias("tile"))
    return rows


def own_rows(X: np.ndarray, step: int, tile, radius: float) -> np.ndarray:
    """Which points of a task lie in its tile (the others are there for their neighbours)."""
    return (np.floor(X / (STEPS[step] * radius)) == np.array(tile, np.float64)).all(axis=1)


# ----------------------------------------------------------------- in a task

def near(Q: np.ndarray, X: np.ndarray, radius: float):
    """``(rows of Q, rows of X, squared distances)``: blocks of ``Q`` in order of the dim that ``X`` spreads most
    in against all of ``X`` within reach along it."""
    if not len(Q) or not len(X):
        return
    axis = int(np.argmax(X.max(axis=0) - X.min(axis=0)))
    order, queries = np.argsort(X[:, axis], kind="stable"), np.argsort(Q[:, axis], kind="stable")
    first = X[order, axis]
    for at in range(0, len(queries), BLOCK):
        rows = queries[at:at + BLOCK]
        lo = np.searchsorted(first, Q[rows[0], axis] - radius * (1 + 1e-9), "left")
        hi = np.searchsorted(first, Q[rows[-1], axis] + radius * (1 + 1e-9), "right")
        cand = order[lo:hi]
        d2 = np.zeros((len(rows), len(cand)))
        for k in range(X.shape[1]):
            d2 += (Q[rows, k][:, None] - X[cand, k][None, :]) ** 2
        yield rows, cand, d2


def near_boxes(Q: np.ndarray, Q_hi: np.ndarray, X: np.ndarray, X_hi: np.ndarray, radius: float):
    """As :func:`near` for boxes given by their corners: ``(rows of Q, rows of X, least, greatest squared distances)``.
    Both bound the squared distance of any two points of the boxes as :func:`near` computes it, to the last bit."""
    if not len(Q) or not len(X):
        return
    axis = int(np.argmax(X_hi.max(axis=0) - X.min(axis=0)))
    order, queries = np.argsort(X[:, axis], kind="stable"), np.argsort(Q[:, axis], kind="stable")
    first, reach = X[order, axis], radius * (1 + 1e-9)
    widest = float((X_hi[:, axis] - X[:, axis]).max()) * (1 + 1e-9)
    for at in range(0, len(queries), BLOCK):
        rows = queries[at:at + BLOCK]
        lo = np.searchsorted(first, Q[rows[0], axis] - reach - widest, "left")
        hi = np.searchsorted(first, Q_hi[rows, axis].max() + reach, "right")
        cand = order[lo:hi]
        least, most = np.zeros((len(rows), len(cand))), np.zeros((len(rows), len(cand)))
        for k in range(X.shape[1]):
            right, left = X_hi[cand, k][None, :] - Q[rows, k][:, None], Q_hi[rows, k][:, None] - X[cand, k][None, :]
            most += np.maximum(right, left) ** 2
            least += np.maximum(0.0, -np.minimum(right, left)) ** 2
        yield rows, cand, least, most


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each vertex's component (pointer jumping)."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        while True:
            nxt = new[new]
            if (nxt == new).all():
                break
            new = nxt
        if (new == lab).all():
            return lab
        lab = new


class Cells:
    """Points in cubic cells: ``of`` is each point's cell, ``pairs`` are neighbouring occupied cells (a cell and
    those that touch it, each pair once)."""

    def __init__(self, X: np.ndarray, side: float):
        n, d = X.shape
        self.n, self.of, self.pairs = 0, np.zeros(n, np.int64), np.zeros((0, 2), np.int64)
        if not n:
            return
        at = np.floor(X / side).astype(np.int64)
        at -= at.min(axis=0)
        span = at.max(axis=0) + 3
        if d > CELL_DIMS or math.prod(span.tolist()) >= 1 << 62:
            self.of = np.unique(at, axis=0, return_inverse=True)[1].ravel()
            self.n = int(self.of.max()) + 1
            return
        radix = np.cumprod(np.append(1, span[:-1]))
        codes, self.of = np.unique((at + 1) @ radix, return_inverse=True)
        self.of, self.n = self.of.ravel(), len(codes)
        found = []
        for o in itertools.product((-1, 0, 1), repeat=d):
            step = int(np.array(o) @ radix)
            if step > 0:
                to = np.minimum(np.searchsorted(codes, codes + step), self.n - 1)
                hit = np.flatnonzero(codes[to] == codes + step)
                found.append(np.column_stack([hit, to[hit]]))
        self.pairs = np.concatenate(found)

    def around(self, values: np.ndarray, fold) -> np.ndarray:
        """``values`` of each cell folded (``np.add``, ``np.minimum``, ...) with those of its neighbours."""
        out = values.copy()
        fold.at(out, self.pairs[:, 0], values[self.pairs[:, 1]])
        fold.at(out, self.pairs[:, 1], values[self.pairs[:, 0]])
        return out


def close_side(d: int, radius: float) -> float:
    """Side of cells of ``d`` dims of which neighbouring ones lie wholly within ``radius`` of each other (of many dims: single cells)."""
    d = max(d, 1)
    return radius / ((2 if d <= CELL_DIMS else 1) * math.sqrt(d)) * (1 - 1e-9)


def close_cells(X: np.ndarray, radius: float) -> Cells:
    """Cells of :func:`close_side`."""
    return Cells(X, close_side(X.shape[1], radius))


def core_points(X: np.ndarray, weight: np.ndarray, radius: float, min_samples: int) -> np.ndarray:
    """Points with at least ``min_samples`` (themselves included) within ``radius``: dense cells first, pairs for the rest."""
    cells = close_cells(X, radius)
    total = np.bincount(cells.of, weight, cells.n).astype(np.int64)
    core = cells.around(total, np.add)[cells.of] >= min_samples if cells.n else np.zeros(len(X), bool)
    rest = np.flatnonzero(~core)
    for rows, cand, d2 in near(X[rest], X, radius):
        core[rest[rows]] = (d2 <= radius * radius) @ weight[cand] >= min_samples
    return core


def _mixed(X: np.ndarray, group: np.ndarray, reach: float) -> np.ndarray:
    """Rows that may have a row of another group within ``reach`` along every dim."""
    if not len(X) or X.shape[1] > CELL_DIMS:
        return np.arange(len(X))
    wide = Cells(X, reach * (1 + 1e-9))
    low, high = np.full(wide.n, np.iinfo(np.int64).max), np.full(wide.n, -1)
    np.minimum.at(low, wide.of, group)
    np.maximum.at(high, wide.of, group)
    return np.flatnonzero((wide.around(low, np.minimum) != wide.around(high, np.maximum))[wide.of])


def unsure(X: np.ndarray, X_hi: np.ndarray, levels, chains: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Boxes whose points have to be looked at: two boxes, one of them in ``own``, may hold points within a radius at which
    ``chains`` (from :func:`level_labels`) keeps the boxes apart."""
    squares, ask = np.array([e * e for e in levels]), np.zeros(len(X), bool)
    if not (X_hi > X).any():
        return ask
    active = _mixed(X, chains[0], levels[-1] + float((X_hi - X).max()))
    at = active[own[active]]
    for rows, cand, least, _ in near_boxes(X[at], X_hi[at], X[active], X_hi[active], levels[-1]):
        i, j = np.nonzero(least <= squares[-1])
        a, b, k = at[rows[i]], active[cand[j]], np.searchsorted(squares, least[i, j])
        apart = chains[k, a] != chains[k, b]
        ask[a[apart]] = ask[b[apart]] = True
    return ask


def level_labels(X: np.ndarray, levels, X_hi: np.ndarray | None = None) -> np.ndarray:
    """Components of the points at each of the ascending radii ``levels``: a row per level, the least member's number.
    With ``X_hi`` the rows are boxes, each within a cell of :func:`close_side`, that are as far apart as their farthest corners.

    A spanning forest by level: cells join their neighbours at the least radius for nothing; where clusters meet, pairs
    between them give the level at which they join, and the forest keeps, after every block, one edge per join.
    """
    n, squares = len(X), np.array([e * e for e in levels])
    cells = close_cells(X, levels[0])
    group = components(cells.n, cells.pairs[:, 0], cells.pairs[:, 1])[cells.of] if n else np.zeros(0, np.int64)
    # points that have no other group within reach need no test
    active = _mixed(X, group, levels[-1])
    forest = np.zeros((0, 3), np.int64)                    # group, group, level
    Y, mine = X[active], group[active]
    tested = near(Y, Y, levels[-1]) if X_hi is None else ((rows, cand, most) for rows, cand, _, most in near_boxes(Y, X_hi[active], Y, X_hi[active], levels[-1]))
    for rows, cand, d2 in tested:
        i, j = np.nonzero((d2 <= squares[-1]) & (mine[rows][:, None] < mine[cand][None, :]))
        if len(i):
            edges = np.column_stack([mine[rows[i]], mine[cand[j]], np.searchsorted(squares, d2[i, j])])
            edges = edges[np.lexsort((edges[:, 2], edges[:, 1], edges[:, 0]))]
            first = np.append(True, (edges[1:, :2] != edges[:-1, :2]).any(axis=1))
            forest = _joins(cells.n, np.concatenate([forest, edges[first]]), len(levels))[1]
    by_cell, _ = _joins(cells.n, forest, len(levels))
    labels = by_cell[:, group] if n else np.zeros((len(levels), 0), np.int64)
    out = np.empty_like(labels)
    for k, row in enumerate(labels):                       # cells' numbers to the least point of the component
        _, least, of = np.unique(row, return_index=True, return_inverse=True)
        out[k] = least[of.ravel()] if n else row
    return out


def _joins(n: int, edges: np.ndarray, levels: int):
    """Labels of ``n`` vertices at each level, and the edges that say as much: one per join."""
    lab, rows, kept = np.arange(n), [], []
    for k in range(levels):
        e = edges[edges[:, 2] == k]
        a, b = lab[e[:, 0]], lab[e[:, 1]]
        if (a != b).any():
            top = components(n, a, b)
            moved = np.flatnonzero((top != np.arange(n)) & (lab == np.arange(n)))
            kept.append(np.column_stack([moved, top[moved], np.full(len(moved), k)]))
            lab = top[lab]
        rows.append(lab)
    return np.array(rows), np.concatenate([np.zeros((0, 3), np.int64), *kept])
