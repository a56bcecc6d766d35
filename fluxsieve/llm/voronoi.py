"""Exact top-k search by a Voronoi kNN join (operator 1).

Vectors are turned into whole numbers, ``floor(256 * x)``; a query's best candidates are those
with the largest integer inner product.

*To distances.*  With M the largest candidate norm, append ``sqrt(M^2 - |v|^2)`` to each candidate
and 0 to each query: the distance between the two then falls exactly as their inner product
rises, for any one query, so the bounds of a kNN join apply.

1. Pivots (a bounded sample of candidates, a parameter) divide candidates and queries into
   Voronoi cells.  Summaries per cell: the k + 1 ids of least pivot distance among its candidates
   (a query's own id, on however many rows, is one of them at most), and the largest pivot
   distance of its queries.
2. From the summaries every query cell gets an upper bound on the distance of any of its
   queries' k-th neighbour; a candidate is needed there only if its own pivot distance does not
   rule it out by the triangle inequality, or by the plane between the two pivots.
3. Cells with few queries are joined into groups; a candidate is sent once to each group with a
   cell that needs it.  Groups and candidates are dealt in blocks of bounded size; each block
   pair is one matrix product, exact in whole numbers, and hands on k rows per query.
4. The best k of each query's block winners are its result.

Bounds are loosened by a relative 1e-6, far above the rounding of the distances they bound, so
no needed candidate is lost; scores themselves are whole numbers.

Defined results: vectors that are null, or hold null or non-finite components, take no part;
components whose whole number does not fit 64 bits count as such too.  A shorter vector counts
as padded with zeros.  Null ids take no part.  Rows that repeat an id are separate candidates (none of
them for a query with that id) but ask once, with the least of their vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

SLACK = 1e-6


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, null if any is null or not finite."""
    def one(x):
        y = F.floor(x.cast("double") * float(scale))
        return F.when(F.abs(x.cast("double") * float(scale)) < float(1 << 62), y)
    out = F.transform(vector, one)
    return F.when(~F.exists(out, lambda y: y.isNull()), out)


def _matrix(column, dim: int) -> np.ndarray:
    """List column as rows padded with zeros to ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - at] = flat
    return out


def _lift(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Coordinates in which distance falls as the inner product rises."""
    f = x.astype(np.float64)
    last = np.zeros(len(f)) if query else np.sqrt(np.maximum(0.0, top - (f * f).sum(axis=1)))
    return np.column_stack([f, last])


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ p.T + (p * p).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(d, 0.0))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products (in floating point where every sum is below 2^53)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2 ** 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, pivots: int = 64, groups: int = 8, block: int = 4096) -> DataFrame:
    """``query_id, rank, <id>, score`` for every row of ``vectors`` for which ``queries`` holds, over all rows."""
    ship_package(vectors.sparkSession)
    base = cut_lineage(vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v"),
                                      F.coalesce(queries, F.lit(False)).alias("asks")).filter("id IS NOT NULL AND v IS NOT NULL"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = base.agg(F.max(F.size("v")), F.max(norm), F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    dim, top, rows, asked = facts[0], facts[1], facts[2], facts[3] or 0
    final = f"query_id bigint, rank int, {id_col} bigint, score bigint"
    if not rows or not asked:
        return vectors.sparkSession.createDataFrame([], final)
    chosen = base.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()   # bounded by ``pivots``
    dim = max(dim, 1)
    raw = np.zeros((len(chosen), dim), np.int64)
    for i, r in enumerate(chosen):
        raw[i, :len(r[0])] = r[0]
    centre = _lift(raw, top, False)

    def assign(batches):
        for b in batches:
            x = _matrix(b.column("v"), dim)
            asks = b.column("asks").to_numpy(zero_copy_only=False)
            near = _distances(_lift(x, top, False), centre)
            cell = near.argmin(axis=1)
            far = np.zeros(len(x))
            home = np.full(len(x), -1, np.int64)
            if asks.any():
                d = _distances(_lift(x[asks], top, True), centre)
                home[asks] = d.argmin(axis=1)
                far[asks] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), b.column("asks"), pa.array(cell, pa.int64()), pa.array(near[np.arange(len(x)), cell]),
                 pa.array(home, pa.int64()), pa.array(far)], names=["id", "v", "asks", "cell", "d", "home", "far"])

    placed = cut_lineage(base.mapInArrow(
        assign, "id bigint, v array<bigint>, asks boolean, cell bigint, d double, home bigint, far double"))
    nearest = placed.groupBy("cell", "id").agg(F.min("d").alias("d")) \
        .withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d", "id"))) \
        .filter(F.col("r") <= k + 1).groupBy("cell").agg(F.collect_list(F.struct("d", "id")).alias("near")).collect()   # pivots * (k + 1) pairs
    asking = placed.filter("asks").groupBy("home").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
    needs, group_of, share = _bounds(centre, {r["cell"]: [x["d"] for x in r["near"]] for r in nearest},
                                     {r["home"]: (r["far"], r["n"]) for r in asking}, k, groups,
                                     {r["cell"]: [x["id"] for x in r["near"]] for r in nearest})
    n_groups = len(share)
    # blocks of bounded size: the hash of the id deals a group's queries, and all candidates
    q_blocks = [max(1, -(-n // block)) for n in share]
    v_blocks = max(1, -(-rows // block))
    per_group = F.array(*[F.lit(n) for n in q_blocks])
    home_group = F.element_at(F.array(*[F.lit(int(g)) for g in group_of]), (F.col("home") + 1).cast("int"))
    asks = placed.filter("asks").groupBy("id").agg(F.min(F.struct("v", home_group.alias("g"))).alias("q")).select("id", "q.v", "q.g") \
        .withColumn("qb", F.pmod(F.xxhash64("id"), F.element_at(per_group, F.col("g") + 1)).cast("int")) \
        .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    bound = F.array(*[F.array(*[F.lit(float(needs[g, c])) for c in range(len(centre))]) for g in range(n_groups)])
    cell_at = (F.col("cell") + 1).cast("int")
    to = F.filter(F.transform(bound, lambda least, g: F.when(F.col("d") >= F.element_at(least, cell_at), g)), lambda g: g.isNotNull())
    sent = placed.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(v_blocks)).cast("int").alias("vb"), F.explode(to).alias("g")) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.element_at(per_group, F.col("g") + 1) - 1)))

    def solve(key, left, right):
        empty = pa.table([pa.array([], t) for t in (pa.int64(),) * 3], names=["query_id", "id", "score"])
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.take(pa.array(np.argsort(right.column("id").to_numpy(), kind="stable")))
        q, v = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
        qid, vid = left.column("id").to_numpy(), right.column("id").to_numpy()
        qs, vs, ss = [], [], []
        for at in range(0, len(q), 256):
            s = _products(q[at:at + 256], v)
            own = vid[None, :] == qid[at:at + 256, None]
            for i in range(len(s)):
                ok = np.flatnonzero(~own[i])
                x = s[i, ok]
                if len(x) > k:
                    least = np.partition(x, len(x) - k)[len(x) - k]
                    above = np.flatnonzero(x > least)
                    ties = np.flatnonzero(x == least)[:k - len(above)]       # candidates are in id order
                    take = np.concatenate([above, ties])
                else:
                    take = np.arange(len(x))
                qs.append(np.full(len(take), qid[at + i]))
                vs.append(vid[ok[take]])
                ss.append(x[take])
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in (qs, vs, ss)], names=["query_id", "id", "score"])

    won = asks.groupBy("g", "qb", "vb").cogroup(sent.groupBy("g", "qb", "vb")).applyInArrow(
        solve, "query_id bigint, id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return won.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("id").alias(id_col), "score")


def _bounds(centre, nearest, asking, k, groups, ids=None):
    """For each group and candidate cell the least pivot distance of a candidate that is needed; the
    group of each query cell; the queries of each group.  ``ids`` go with ``nearest`` (left out: all differ)."""
    n = len(centre)
    ids = ids or {j: [(j, r) for r in range(len(ds))] for j, ds in nearest.items()}
    between = _distances(centre, centre)
    per_cell = {}
    for i, (radius, _) in asking.items():
        # every query of cell i: distance to a candidate of cell j at most radius + between + its pivot distance
        least_of = {}                                       # an id in several cells counts once
        for j, ds in nearest.items():
            for d, one in zip(ds, ids[j]):
                least_of[one] = min(least_of.get(one, np.inf), radius + between[i, j] + d)
        upper = sorted(least_of.values())
        theta = upper[k] if len(upper) > k else np.inf      # k + 1: one may be the query's own id
        least = np.empty(n)
        for j in range(n):
            # triangle inequality: |q, v| >= between - radius - d, so v is ruled out while that exceeds theta
            least[j] = between[i, j] - radius - theta
            # plane between the pivots: every candidate of cell j is beyond it
            if (between[i, j] - 2 * radius) / 2 > theta * (1 + SLACK) + SLACK * (1 + between[i, j]):
                least[j] = np.inf
        slack = SLACK * (1 + np.abs(between[i]) + radius + (theta if np.isfinite(theta) else 0))
        per_cell[i] = np.where(least == -np.inf, -np.inf, least - slack)
    # cells are dealt to groups in the order of a walk to the nearest next cell, so that neighbours share one
    todo, walk = set(asking), []
    at = min(asking)
    while todo:
        at = min(todo, key=lambda c: (between[at, c], c))
        walk.append(at)
        todo.discard(at)
    total, so_far = sum(c for _, c in asking.values()), 0
    group_of = np.zeros(n, np.int64)
    for c in walk:
        group_of[c] = min(groups - 1, so_far * groups // total)
        so_far += asking[c][1]
    used = sorted({int(group_of[c]) for c in walk})
    number = {g: i for i, g in enumerate(used)}
    needs, share = np.full((len(used), n), np.inf), [0] * len(used)
    for c in walk:
        g = number[int(group_of[c])]
        group_of[c] = g
        needs[g] = np.minimum(needs[g], per_cell[c])
        share[g] += asking[c][1]
    return needs, np.where(group_of < len(used), group_of, 0), share


#: The ``op1`` query in DuckDB SQL.
TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS z FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.z, c.z), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint AS score
           FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::int AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
