"""Prefix trie of conversations from padded turn-id matrices (operator 11).

A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. A turn becomes a 128-bit digest of role and text, a conversation the string of its turns'
   digests (``sequences``).  In order of these strings every node is a run of neighbouring rows.
2. Conversations are range-sorted by that string and their id into *shards*, so that one sequence
   held by very many conversations is spread as well.
3. A shard is a matrix, one row a conversation, one column a depth, padded behind the last turn and
   cut into blocks of ``WIDTH`` columns, of which only the rows that reach them take part.  A numpy
   lexsort orders the rows; the masks of changes between neighbouring rows, OR-accumulated from the
   left, mark where nodes start; ``reduceat`` sums every depth's runs.  Everything a node needs is a
   sum over its rows, e.g. the tokens saved in its subtree: each row's turns from that depth on which
   it did not start itself.
4. A shard also sees the last conversation before it and the first one after it, as rows that do not
   count.  A run that contains one of them goes on in the neighbouring shard: such boundary nodes, one
   or two paths a shard, are summed over the shards.

Defined results: null role or text is empty; turns are in order of turn (null first), then role and
digest; rows without a conversation id take no part; a conversation's digests (20 bytes a turn) are
one row; very long texts count by their code points; repeated rows are repeated turns; an empty
table has no nodes; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from . import common as C

#: Columns of one block of the matrix, bytes of digests of a shard, least number of shards, shards that one
#: task looks at for neighbours, ids in one piece of a boundary node's list of ends.
WIDTH, SHARD_BYTES, LEAST_SHARDS, NEIGHBOURS, PIECE = 64, 4 << 20, 32, 1024, 500
NO_ID = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ sequences

def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """``conv_id`` and its ``turns`` in order: digest of role and text, code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


# ------------------------------------------------------------------ one shard

class _Matrix:
    """Rows of turn numbers in sorted order, as padded blocks of columns."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int):
        self.ids, self.starts, self.lengths, self.width = ids, starts, lengths, width

    def blocks(self):
        """``(first column, rows that reach it, their padded turn numbers)``; 0 is behind the last turn."""
        for lo in range(0, int(self.lengths.max(initial=0)), self.width):
            rows = np.flatnonzero(self.lengths > lo)
            yield lo, rows, self.padded(self.ids, rows, lo)

    def padded(self, flat: np.ndarray, rows: np.ndarray, lo: int) -> np.ndarray:
        wide = min(self.width, int(self.lengths[rows].max()) - lo)
        at = lo + np.arange(wide)[None, :]
        inside = at < self.lengths[rows][:, None]
        return np.where(inside, flat[np.where(inside, self.starts[rows][:, None] + at, 0)], 0)


def _order(m: _Matrix, tie: np.ndarray) -> np.ndarray:
    """Rows by their turns, then ``tie``: lexsort by block; a row's rank is the first place of its equals so far."""
    n = len(tie)
    rank = np.zeros(n, np.int64)
    for _, rows, cells in m.blocks():
        o = np.lexsort((*cells.T[::-1], rank[rows]))
        r, sorted_cells = rank[rows][o], cells[o]
        ended = np.bincount(rank, minlength=n) - np.bincount(r, minlength=n)     # rows that end before this block stand first
        new = np.ones(len(o), bool)
        new[1:] = (r[1:] != r[:-1]) | (sorted_cells[1:] != sorted_cells[:-1]).any(axis=1)
        first = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        rank[rows[o]] = r + ended[r] + first - np.searchsorted(r, r)
    return np.lexsort((tie, rank))


def _starts(m: _Matrix) -> np.ndarray:
    """Flat flags: does the row start the node at this turn?  Change masks, OR-accumulated over the columns."""
    flags, group = np.zeros(len(m.ids), bool), np.zeros(len(m.lengths), np.int64)
    for lo, rows, cells in m.blocks():
        change = np.ones(cells.shape, bool)
        change[1:] = cells[1:] != cells[:-1]
        change[1:, 0] |= group[rows][1:] != group[rows][:-1]
        change = np.logical_or.accumulate(change, axis=1)
        group[rows] = np.cumsum(change[:, -1])
        inside = cells != 0
        r, c = np.nonzero(inside)
        flags[m.starts[rows][r] + lo + c] = change[inside]
    return flags


def shard_nodes(conv: np.ndarray, keys: list[bytes], chars: list[np.ndarray], before: bytes | None, after: bytes | None,
                width: int = WIDTH):
    """Nodes of one shard: columns of inner nodes, and boundary nodes as ``(path digest, parent's digest, depth, least
    id, members, children, leaves, saved, ids that end here)``.

    ``keys`` are the joined 16-byte digests of each row; ``before`` and ``after`` those of the neighbours.
    """
    flat = np.frombuffer(b"".join([*keys, before or b"", after or b""]), ">u8").astype(np.uint64).reshape(-1, 2)
    o = np.lexsort((flat[:, 1], flat[:, 0]))
    ids = np.empty(len(o), np.int64)
    first = C.run_starts(flat[o, 0], flat[o, 1])
    ids[o] = np.repeat(np.arange(1, len(first) + 1), np.diff(np.append(first, len(o))))
    lengths = np.array([len(k) // 16 for k in keys], np.int64)
    starts = np.cumsum(lengths) - lengths
    order = _order(_Matrix(ids, starts, lengths, width), conv)
    # the neighbours as first and last row
    n, real = len(conv), lengths.sum()
    n_before, n_after = int(before is not None), int(after is not None)
    put = lambda x, a, z: np.concatenate([np.full(n_before, a, np.int64), x[order], np.full(n_after, z, np.int64)])
    long_before, long_after = len(before or b"") // 16, len(after or b"") // 16
    m = _Matrix(ids, put(starts, real, real + long_before), put(lengths, long_before, long_after), width)
    conv, weight = put(conv, NO_ID, NO_ID), put(np.ones(n, np.int64), 0, 0)
    size = np.concatenate([*[c.astype(np.int64) for c in chars], np.zeros(long_before + long_after, np.int64)])
    last = len(conv) - 1

    starts_here = _starts(m)
    counted = np.repeat(weight, m.lengths)
    place = np.repeat(m.starts - (np.cumsum(m.lengths) - m.lengths), m.lengths) + np.arange(len(counted))
    own = np.zeros(len(ids), np.int64)
    own[place] = counted                                                       # 1 for turns of real rows
    saved = size * ~starts_here * own
    # from this turn to the row's end
    through = np.cumsum(saved)
    end = np.zeros(len(ids), np.int64)
    end[place] = np.repeat(np.where(m.lengths > 0, through[np.maximum(m.starts + m.lengths - 1, 0)] if len(ids) else 0, 0), m.lengths)
    onward = end - through + saved
    opens = (starts_here * own).astype(np.int64)
    # a row's whole sequence is childless if the next row does not go on with it
    leaf = np.ones(len(conv), np.int64)
    for lo, rows, cells in m.blocks():
        done = rows[(m.lengths[rows] > lo) & (m.lengths[rows] <= lo + width) & (rows < last)]
        nxt = done + 1
        longer = m.lengths[nxt] >= m.lengths[done]
        at = m.starts[nxt] + m.lengths[done] - 1
        leaf[done[longer]] = starts_here[at[longer]]
    leaf[(m.lengths == 0) & (np.arange(len(conv)) < last)] = 0
    leaf *= weight

    inner = {k: [] for k in ("depth", "conv_id", "row", "parent", "side", "n_convs", "n_children", "n_leaves", "saved")}
    boundary: list = []
    paths = [_path_digests(before), _path_digests(after)]

    def ends_of(lo, hi, depth):
        rows = np.arange(lo, hi)
        return conv[rows[(m.lengths[rows] == depth) & (weight[rows] == 1)]]

    # the root
    total = int(onward[m.starts[m.lengths > 0]].sum()) if len(ids) else 0
    children = int(opens[m.starts[m.lengths > 0]].sum()) if len(ids) else 0
    root = (0, int(conv.min()), n, children, int(leaf.sum()), total)
    if n_before or n_after:
        boundary.append((paths[0 if n_before else 1][0], None, *root, ends_of(0, last + 1, 0)))
    else:
        for k, v in zip(inner, (root[0], root[1], 0, -1, 0, *root[2:])):
            inner[k].append(np.array([v], np.int64))
    up = np.full(len(conv), conv.min(), np.int64)                              # parent's least id; side of a boundary parent
    side = np.full(len(conv), 1 if n_before else 2 if n_after else 0, np.int64)
    for lo, rows, cells in m.blocks():
        wide, k = cells.shape[1], len(rows)
        inside = cells != 0
        begin = np.zeros((wide, k), bool)                                      # runs of each depth: padding is a run too
        begin[:, 0] = True
        here = np.zeros((k, wide), bool)
        r, c = np.nonzero(inside)
        here[r, c] = starts_here[m.starts[rows][r] + lo + c]
        gone = np.zeros((k, wide), bool)
        gone[1:] = inside[1:] != inside[:-1]
        begin |= (here | gone).T
        run = np.flatnonzero(begin.ravel())
        depth, row = run // k, run % k
        column = lambda flat, shift=0: np.where(
            lo + shift + np.arange(wide)[:, None] < m.lengths[rows][None, :],
            flat[np.minimum(m.starts[rows][None, :] + lo + shift + np.arange(wide)[:, None], len(ids) - 1)], 0).ravel()
        tiled = lambda x: np.tile(x[rows], wide)
        members = np.add.reduceat(tiled(weight), run)
        least = np.minimum.reduceat(tiled(conv), run)
        kids = np.add.reduceat(column(opens, 1), run)
        leaves = np.add.reduceat(tiled(leaf), run)
        keep = np.add.reduceat(column(onward), run)
        stop = np.append(run[1:], wide * k)
        tail = (stop - 1) % k
        node = inside[row, depth]
        open_at = np.where((n_before > 0) & (rows[row] == 0), 1, np.where((n_after > 0) & (rows[tail] == last), 2, 0))
        # each cell's node, for its children one column on
        cells_of = stop - run
        least_at = np.repeat(least, cells_of).reshape(wide, k)
        side_at = np.repeat(open_at, cells_of).reshape(wide, k)
        above = np.vstack([up[rows][None, :], least_at[:-1]])
        above_side = np.vstack([side[rows][None, :], side_at[:-1]])
        final = node & (open_at == 0)
        for name, v in zip(inner, (lo + depth + 1, least, rows[row], above[depth, row], above_side[depth, row], members, kids, leaves, keep)):
            inner[name].append(v[final])
        for q in np.flatnonzero(node & (open_at > 0) & (members > 0)).tolist():
            d = lo + int(depth[q]) + 1
            path = paths[0 if open_at[q] == 1 else 1]
            boundary.append((path[d], path[d - 1], d, int(least[q]), int(members[q]), int(kids[q]), int(leaves[q]), int(keep[q]),
                             ends_of(int(rows[row[q]]), int(rows[tail[q]]) + 1, d)))
        up[rows], side[rows] = least_at[-1], side_at[-1]
    inner = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in inner.items()}
    # ids that end at an inner node: the rows from its first one on that are as long as it is deep
    same = np.zeros(len(conv), np.int64)
    fresh = np.ones(len(conv), bool)
    has = m.lengths > 0
    fresh[has] = starts_here[(m.starts + m.lengths - 1)[has]] | (np.append(-1, m.lengths[:-1]) != m.lengths)[has]
    fresh[~has] = np.append(-1, m.lengths[:-1])[~has] != 0
    group = np.flatnonzero(fresh)
    same[group] = np.append(group[1:], len(conv))
    names = [str(x) for x in conv.tolist()]
    inner["ends"] = [hashlib.sha256(",".join(names[r:same[r]]).encode()).hexdigest() if m.lengths[r] == d else EMPTY
                     for r, d in zip(inner["row"].tolist(), inner["depth"].tolist())]
    # a boundary parent is named by its path
    inner["parent_path"] = [None if not s or d == 0 else paths[s - 1][d - 1] for s, d in zip(inner["side"].tolist(), inner["depth"].tolist())]
    return inner, boundary


def _path_digests(key: bytes | None) -> list[bytes]:
    """Digest of the first 0, 1, ... turns of a sequence."""
    if key is None:
        return []
    h = hashlib.md5()
    out = [h.digest()]
    for i in range(0, len(key), 16):
        h.update(key[i:i + 16])
        out.append(h.copy().digest())
    return out


# ------------------------------------------------------------------ the operator

def _neighbours(shards: DataFrame) -> DataFrame:
    """``to_shard, before, after``: sequences next to each shard; empty shards do not count.  Shards are taken
    ``NEIGHBOURS`` at a time, then their groups."""
    key = F.struct("key", "conv_id")
    ends = shards.groupBy("shard").agg(F.min(key)["key"].alias("first"), F.max(key)["key"].alias("last")) \
        .withColumn("part", F.floor(F.col("shard") / NEIGHBOURS))
    parts = ends.groupBy("part").agg(F.min_by("first", "shard").alias("first"), F.max_by("last", "shard").alias("last"))
    w = Window.orderBy("part")                                                 # one row per NEIGHBOURS shards
    parts = parts.select("part", F.lag("last").over(w).alias("part_before"), F.lead("first").over(w).alias("part_after"))
    w = Window.partitionBy("part").orderBy("shard")
    ends = ends.select("shard", "part", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    return ends.join(parts, "part").select(F.col("shard").alias("to_shard"), F.coalesce("before", "part_before").alias("before"),
                                           F.coalesce("after", "part_after").alias("after"))


def trie(seqs: DataFrame, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS, width: int = WIDTH) -> DataFrame:
    """Nodes of the conversations ``conv_id, turns`` (as :func:`sequences` gives them; ids are unique):
    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256`` (of the ascending, comma-joined ids of the conversations that end there)."""
    ship_package(seqs.sparkSession)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = cut_lineage(seqs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")))
    total = rows.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0
    n = max(least_shards, -(-int(total) // shard_bytes))

    def number(batches):
        shard = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, shard, np.int32))], names=["conv_id", "key", "chars", "shard"])

    shards = cut_lineage(rows.repartitionByRange(n, "key", "conv_id").mapInArrow(number, "conv_id bigint, key binary, chars array<int>, shard int"))

    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("path", pa.binary()), ("parent_path", pa.binary()), ("depth", pa.int64()),
                        ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("piece", pa.int32()), ("ends", pa.string())])

    def solve(group, table, near):
        shard = group[0].as_py()
        around = [near.column(c)[0].as_py() for c in ("before", "after")]
        chars = [np.array(c, np.int64) for c in table.column("chars").to_pylist()]
        inner, boundary = shard_nodes(table.column("conv_id").to_numpy(), table.column("key").to_pylist(), chars, *around, width)
        k = len(inner["depth"])
        parts = [pa.table([pa.array(np.zeros(k, np.int32)), pa.array(np.full(k, shard, np.int32)), pa.nulls(k, pa.binary()),
                           pa.array(inner["parent_path"], pa.binary()), pa.array(inner["depth"]), pa.array(inner["conv_id"]),
                           pa.array(inner["parent"], mask=(inner["depth"] == 0) | (inner["side"] > 0)), pa.array(inner["n_convs"]),
                           pa.array(inner["n_children"]), pa.array(inner["n_leaves"]), pa.array(inner["saved"]), pa.nulls(k, pa.int32()),
                           pa.array(inner["ends"], pa.string())], schema=schema)]
        more = []
        for path, parent, depth, least, members, kids, leaves, keep, ends in boundary:
            more.append((1, shard, path, parent, depth, least, None, members, kids, leaves, keep, None, None))
            for p in range(0, len(ends), PIECE):
                more.append((2, shard, path, None, None, None, None, None, None, None, None, p // PIECE, ",".join(map(str, ends[p:p + PIECE].tolist()))))
        parts.append(pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*more), schema)], schema=schema) if more else schema.empty_table())
        return pa.concat_tables(parts)

    fields = "kind int, shard int, path binary, parent_path binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, " \
             "n_children bigint, n_leaves bigint, saved_tokens bigint, piece int, ends string"
    found = cut_lineage(shards.groupBy("shard").cogroup(_neighbours(shards).groupBy("to_shard")).applyInArrow(solve, fields), compression="zstd")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = found.filter("kind = 0").withColumnRenamed("ends", "ends_sha256")

    # boundary nodes: partial sums of the shards, ids that end there hashed piece after piece
    partial = found.filter("kind = 1")
    nodes = partial.groupBy("path").agg(F.first("parent_path").alias("parent_path"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    least = nodes.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("known_parent"))

    def digest(batches):
        path, h = None, None
        for b in batches:
            for p, text in zip(b.column("path").to_pylist(), b.column("ends").to_pylist()):
                if p != path:
                    if h is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([h.hexdigest()])], names=["path", "ends_sha256"])
                    path, h = p, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([h.hexdigest()])], names=["path", "ends_sha256"])

    ends = found.filter("kind = 2").select("path", "shard", "piece", "ends").repartition("path") \
        .sortWithinPartitions("path", "shard", "piece").mapInArrow(digest, "path binary, ends_sha256 string")
    outer = nodes.join(least, "parent_path", "left").join(ends, "path", "left") \
        .withColumn("parent_conv_id", F.col("known_parent")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    # children of boundary nodes find their parent by shard and path, so that a wide root is spread over its shards
    seen = partial.select("shard", "path").join(nodes.select("path", F.col("conv_id").alias("known_parent")), "path") \
        .select("shard", F.col("path").alias("parent_path"), "known_parent")
    plain = inner.filter(F.col("parent_path").isNull())
    below = inner.filter(F.col("parent_path").isNotNull()).drop("parent_conv_id").join(seen, ["shard", "parent_path"]) \
        .withColumnRenamed("known_parent", "parent_conv_id")
    return plain.select(*cols).unionByName(below.select(*cols)).unionByName(outer.select(*cols))


#: The nodes of the ``op11`` query in DuckDB SQL (the CRC bit by bit: -1 stands for a shift).
TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (
  SELECT conv_id, t, xor(list_reduce(flatten([[4294967295]] || [[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(conv_id::VARCHAR, '')]),
    lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END), 4294967295) % 6 AS h
  FROM turns),
rebuilt AS (
  SELECT a.conv_id, list_slice(coalesce(b.t, []), 1, a.h) || list_slice(a.t, a.h + 1, len(a.t)) AS t
  FROM headed a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (
  SELECT conv_id, d, len(t) AS n, md5(list_slice(t, 1, d)::VARCHAR) AS k, CASE WHEN d > 0 THEN length(t[d].text) ELSE 0 END AS chars
  FROM rebuilt, LATERAL (SELECT unnest(range(len(t) + 1)) AS d)),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, bool_and(n = d) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, k),
parents AS (SELECT n.d, n.k, p.k AS pk FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
children AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM parents GROUP BY ALL),
subtree AS (
  SELECT p.d, p.k, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.k)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s ON s.d = n.d AND s.k = n.k LEFT JOIN children c ON c.d = n.d AND c.k = n.k
LEFT JOIN parents p ON p.d = n.d AND p.k = n.k LEFT JOIN nodes up ON up.d = n.d - 1 AND up.k = p.pk
"""
