"""Connected components of a link table, entirely in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: two nodes have one root if and only if a
    path links them.

    Contraction: in each round every node joins the neighbour (or itself) with the least random
    priority, and the links are redrawn between those; a fresh priority each round makes the
    number of nodes fall geometrically whatever the graph's shape.  Rounds end when no link is
    left.  Each round is written to the shared checkpoint folder.
    """
    links = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .filter("a <> b").distinct())
    steps, turn = [], 0
    while not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("n"))
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        step = cut_lineage(best.select(F.col("a").alias("node"), F.least(rank("a"), F.col("best"))["n"].alias("root")))
        steps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = cut_lineage(links.join(a, "a").join(b, "b")
                            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                            .filter("a <> b").distinct())
        turn += 1
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("end"))
        out = step.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return out
