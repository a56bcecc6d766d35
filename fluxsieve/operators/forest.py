"""Clusters at every radius of a list at once: one spanning forest of the points, cut at each level.

With at most two samples to a cluster, a density cluster is a connected component of the graph of
points within ``eps``, so clusters of falling radii are nested and all follow from one minimum
spanning forest.  Tiles (``tiles``) find theirs from their own points and those within the greatest
radius; what a forest says of a tile is small: the components at the least radius, and for each the
chain of components it is part of at the wider radii.  Points that two tiles see tie their chains
together, and the ties of all levels are solved by one contraction (``components``).  Points so close that
they hang together at the least radius are one box, so dense spots are never paired.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from . import tiles
from .components import connected_components

SITE = "site"
#: Ties between tiles that one task solves, rows of boxes that are broadcast.
SMALL, BROADCAST_ROWS = 200_000, 500_000


def _solve(table: pa.Table) -> pa.Table:
    """Roots of the nodes of a small link table."""
    names, of = np.unique(np.concatenate([np.array(table.column(c).to_pylist(), object) for c in "ab"]), return_inverse=True)
    root = tiles.components(len(names), of[:table.num_rows], of[table.num_rows:])
    return pa.table([pa.array(names.tolist(), pa.string()), pa.array(names[root].tolist(), pa.string())], names=["node", "root"])


def tied(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of the links ``edges(a, b)`` between names: at most ``SMALL`` links are one task's work, more are
    contracted in Spark; which member of a component is its root may differ, the components do not."""
    ship_package(edges.sparkSession)
    edges = cut_lineage(edges.select("a", "b").filter("a <> b").distinct())
    if edges.count() > SMALL:
        return cut_lineage(connected_components(edges))
    return cut_lineage(edges.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_solve, "node string, root string"))


def sites(df: DataFrame, dims, key: str) -> DataFrame:
    """Distinct coordinates: ``site`` (least id there), the dims and ``weight`` (points there)."""
    return df.groupBy(*[F.col(x).cast("double").alias(x) for x in dims]).agg(F.min(key).alias(SITE), F.count(F.lit(1)).alias("weight"))


def finite(dims):
    """Rows whose place is known: no missing, NaN or infinite coordinate."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(x).cast("double")) < float("inf"), F.lit(False)) for x in dims])


class LevelForest:
    """Components of points (each counted ``weight`` times, where there is such a column) at ascending radii.

    ``members``: ``site, part`` of points that have a ``site`` (the part is the tile's component at the least radius that holds
    the point; :meth:`placed` gives it for rows of any kind); ``parts``: ``part, weight, chain`` with ``chain[k]`` =
    ``(cluster, size)`` at the k-th radius, where ``size`` is the cluster's number of points over all tiles.  Clusters of one
    level are equal strings.

    Points are first counted into cells whose points hang together at the least radius, so tiles see a box for each
    cell, however many points it holds.  Boxes whose nearest and farthest corners decide differently, where nothing
    else decides, are taken apart into their places and the tiles solved again.
    """

    def __init__(self, points: DataFrame, dims, levels, tile_points: int = tiles.TILE_POINTS):
        levels = [float(e) for e in levels]
        if levels != sorted(set(levels)):
            raise ValueError(f"radii must ascend: {levels}")
        ship_package(points.sparkSession)
        self.points, self.dims, self.levels, self.tile_points = points, list(dims), levels, tile_points
        self.side = tiles.close_side(len(self.dims), levels[0])
        self.cell = [f"__c{i}" for i in range(len(self.dims))]
        weight = F.sum("weight" if "weight" in points.columns else F.lit(1)).cast("long").alias("weight")
        known = self._celled(points.filter(finite(self.dims)))
        corners = [F.max(x).alias(f"__hi_{x}") for x in self.dims]
        cells = known.groupBy(*self.cell).agg(weight, *[F.min(x).alias(x) for x in self.dims], *corners)
        boxes = cut_lineage(cells.withColumn("__id", F.monotonically_increasing_id()))
        found = self._solved(boxes)
        self.apart = cut_lineage(found.filter("asked").select(F.col("site").alias("__id")).distinct().join(boxes, "__id").select(*self.cell))
        self.split = not self.apart.isEmpty()
        if self.split:
            places = known.join(self.apart, self.cell, "left_semi").groupBy(*self.cell, *self.dims).agg(weight)
            whole = boxes.drop("__id").join(self.apart, self.cell, "left_anti").withColumn("__whole", F.lit(True))
            places = places.select("*", *[F.col(x).alias(f"__hi_{x}") for x in self.dims], F.lit(False).alias("__whole"))
            boxes = cut_lineage(whole.unionByName(places).withColumn("__id", F.monotonically_increasing_id()))
            found = self._solved(boxes)
        else:
            boxes = boxes.withColumn("__whole", F.lit(True))
        members = found.filter("own").select(F.col("site").alias("__id"), "part")
        self.boxes = cut_lineage(boxes.join(members, "__id").select(*self.cell, *self.dims, "__whole", "part"))
        self.parts = self._parts(found)

    def _celled(self, df: DataFrame) -> DataFrame:
        places = df.withColumns({x: F.col(x).cast("double") for x in self.dims})
        return places.withColumns({c: F.floor(F.col(x) / F.lit(self.side)) for c, x in zip(self.cell, self.dims)})

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with the column ``part``, by place; rows at a place that no point of the forest has drop out, as do rows without a place."""
        rows = self._celled(df.filter(finite(self.dims)))
        whole = self.boxes.filter("__whole").select(*self.cell, "part")
        out = rows.join(F.broadcast(whole) if whole.count() <= BROADCAST_ROWS else whole, self.cell)
        if self.split:
            out = out.unionByName(rows.join(self.boxes.filter("NOT __whole").select(*self.cell, *self.dims, "part"), [*self.cell, *self.dims]))
        return out.select(*df.columns, "part")

    @property
    def members(self) -> DataFrame:
        return self.placed(self.points).select(SITE, "part")

    def _solved(self, boxes: DataFrame) -> DataFrame:
        """Rows of boxes (``site``, the box's number, ``part, own, asked``) and of the tiles' components (``part, weight, chain``)."""
        dims, levels, top = self.dims, self.levels, self.levels[-1]

        def solve(group, table):
            step, tile = group[0].as_py(), group[1].as_py()
            X, X_hi = (np.column_stack([table.column(p + x).to_numpy() for x in dims]) for p in ("", "__hi_"))
            own = tiles.own_rows(X, step, tile, top)
            chains = tiles.level_labels(X, levels, X_hi)
            asked = tiles.unsure(X, X_hi, levels, chains, own)
            first, of = np.unique(chains[0], return_inverse=True)
            name = f"{step}:" + ",".join(map(str, tile)) + "|"
            weight = np.bincount(of, np.where(own, table.column("weight").to_numpy(), 0), len(first)).astype(np.int64)
            here = pa.array([name + str(c) for c in first.tolist()], pa.string())
            n, m, columns = len(X), len(first), ["site", "part", "own", "asked", "weight", "chain"]
            rows = pa.table([table.column("__id"), here.take(pa.array(of.ravel())), pa.array(own), pa.array(asked), pa.nulls(n, pa.int64()),
                             pa.nulls(n, pa.list_(pa.string()))], names=columns)
            names = [[name + str(c) for c in col] for col in chains[:, first].T.tolist()]
            parts = pa.table([pa.nulls(m, pa.int64()), here, pa.nulls(m, pa.bool_()), pa.nulls(m, pa.bool_()), pa.array(weight),
                              pa.array(names, pa.list_(pa.string()))], names=columns)
            return pa.concat_tables([rows, parts.cast(rows.schema)])

        # a box is placed by its low corner, which may be a cell's side from the point that is near another box
        halo = (top + self.side) * (1 + 1e-6)
        seen = tiles.tiled(boxes, dims, top, halo, ["__id", "weight", *[f"__hi_{x}" for x in dims]], self.tile_points)
        return cut_lineage(seen.groupBy("step", "tile").applyInArrow(
            solve, "site bigint, part string, own boolean, asked boolean, weight bigint, chain array<string>"))

    @staticmethod
    def _parts(found: DataFrame) -> DataFrame:
        members = found.filter("own").select("site", "part")
        local = found.filter("weight IS NOT NULL").select("part", "weight", "chain")
        outside = found.filter("NOT own").select("site", F.col("part").alias("b"))
        ties = outside.join(members.withColumnRenamed("part", "a"), "site").select("a", "b").distinct()
        chain = local.select("part", "chain")
        both = ties.join(chain.select(F.col("part").alias("a"), F.col("chain").alias("ca")), "a") \
            .join(chain.select(F.col("part").alias("b"), F.col("chain").alias("cb")), "b")
        edges = both.select(F.posexplode(F.arrays_zip("ca", "cb"))).select(
            F.concat_ws("@", F.col("col.ca"), F.col("pos")).alias("a"), F.concat_ws("@", F.col("col.cb"), F.col("pos")).alias("b"))
        roots = tied(edges)
        placed = local.select("part", "weight", F.posexplode("chain").alias("pos", "c")) \
            .select("part", "weight", "pos", F.concat_ws("@", "c", "pos").alias("node")).join(roots, "node", "left") \
            .select("part", "weight", "pos", F.coalesce("root", "node").alias("cluster"))
        sizes = placed.groupBy("cluster").agg(F.sum("weight").alias("size"))
        return cut_lineage(placed.filter("weight > 0").join(sizes, "cluster").groupBy("part", "weight")
                           .agg(F.sort_array(F.collect_list(F.struct("pos", "cluster", "size"))).alias("chain"))
                           .select("part", "weight", F.transform("chain", lambda c: F.struct(c["cluster"], c["size"])).alias("chain")))
