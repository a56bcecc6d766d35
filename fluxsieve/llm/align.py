"""Cross-tokenizer alignment: lockstep merging of two tokenizations (operator 13).

Both tokenizations of a text spell the same bytes, so their tokens are two partitions of one byte
range.  Where a token of each ends at the same byte is a *cut*; between cuts lie the groups, and all
pairs of tokens of one group are links.

1. Texts of one run (a few MB) are encoded by both vocabularies.  One state vector holds, for every
   document of the run, its next token on either side and the first ones of its open group.  A step
   compares the two byte ends of all documents at once, advances the side that ends first (both at a
   cut), and emits the links of the tokens that entered and the cuts.  Finished documents are taken
   out of the vector.  A long document enters as several lanes that start at cuts of its own, so
   that steps stay few and the vector long.
2. Links become counts of distinct id pairs per document; a *block* (some 12 MB of text) lists its
   distinct pairs once with the number of its documents that hold them.  Documents keep their pairs
   as places in that list, most frequent first.
3. The lists are summed over the corpus by pair; the greatest count of each A id is an aggregate of
   that; counts return to the blocks that hold the pair.  Work grows with the blocks' distinct pairs,
   which a pair in every document enters once per block.

Defined results: null and empty texts, and texts that either side does not spell out again, have no
tokens (zeros, no groups); a document that occurs as several rows counts as several documents; very
long texts run as lanes; an empty table gives no rows; further columns do not travel unless named
in ``carry``, whatever their names.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package
from . import common as C
from . import tokens

#: Bytes of text of a run and of a block, A tokens of a lane, links expanded at a time.
RUN, TEXT_BLOCK, LANE, EXPAND = 2 << 20, 12 << 20, 512, 1 << 22


# ------------------------------------------------------------------ lockstep

def lanes(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray) -> np.ndarray:
    """First A token of every lane: of each document, and within one the first token behind a cut after
    every ``LANE`` tokens (none where no cut follows in the document)."""
    n = np.diff(np.append(first_a, len(end_a)))
    stop = np.repeat(first_a + n, n // LANE)
    at = np.repeat(first_a, n // LANE) + LANE * (np.arange(len(stop)) - np.repeat(np.cumsum(n // LANE) - n // LANE, n // LANE) + 1) - 1
    found = [first_a]
    while len(at):
        keep = at < stop - 1
        at, stop = at[keep], stop[keep]
        cut = end_b[np.searchsorted(end_b, end_a[at])] == end_a[at] if len(at) else np.zeros(0, bool)
        found.append(at[cut] + 1)
        at, stop = at[~cut] + 1, stop[~cut]
    return np.unique(np.concatenate(found))


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray):
    """Merge both sides of all documents at once.

    ``end_a`` and ``end_b`` are byte ends over the documents one after the other (each spells the same
    bytes on both sides), ``first_a`` the first A token of each document, all of which have tokens.
    Returns the cuts as ``(last A token, last B token)`` in order, and the links as strips
    ``(token, first partner, last partner)`` of A tokens with B partners and of B tokens with A partners.
    """
    i = lanes(end_a, end_b, first_a)
    j = np.where(i == 0, 0, np.searchsorted(end_b, end_a[np.maximum(i - 1, 0)]) + 1)
    i_end, ga, gb = np.append(i[1:], len(end_a)), i.copy(), j.copy()
    cuts, of_a, of_b = [], [(i, j, j)], []
    i, j = i.copy(), j.copy()
    while len(i):
        a, b = end_a[i], end_b[j]
        cut, step_a, step_b = a == b, a < b, a > b
        cuts.append((i[cut], j[cut]))
        i = i + (a <= b)
        j = j + (a >= b)
        live = i < i_end
        ga, gb = np.where(cut, i, ga), np.where(cut, j, gb)
        enters = (step_a | cut) & live
        of_a.append((i[enters], gb[enters], j[enters]))
        of_b.append((j[step_b], ga[step_b], i[step_b]))
        if not live.all():
            i, j, ga, gb, i_end = i[live], j[live], ga[live], gb[live], i_end[live]
    ca, cb = (np.concatenate([c[k] for c in cuts]) if cuts else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(ca, kind="stable")
    strips = [[np.concatenate([s[k] for s in side]) if side else np.zeros(0, np.int64) for k in range(3)] for side in (of_a, of_b)]
    return ca[order], cb[order], strips[0], strips[1]


def pair_counts(a: np.ndarray, b: np.ndarray, doc_of_a: np.ndarray, of_a, of_b):
    """``(document, pair, links)`` of the strips, sorted: a pair is ``A id << 32 | B id``."""
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    n_a, n_b = int(a.max()) + 1, int(b.max()) + 1
    keys, links = [], []                               # a key is document, A id and B id in one number, which sorts fast
    for strip, flip in ((of_a, False), (of_b, True)):
        size = strip[2] - strip[1] + 1
        total = np.cumsum(size)
        at = 0
        while at < len(size):                          # a bounded number of links at a time
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + EXPAND, "right")))
            n = size[at:end]
            one = np.repeat(strip[0][at:end], n)
            other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(strip[1][at:end], n)
            x, y = (other, one) if flip else (one, other)
            key = np.sort((doc_of_a[x] * n_a + a[x]) * n_b + b[y])
            first = C.run_starts(key)
            keys.append(key[first])
            links.append(np.diff(np.append(first, len(key))))
            at = end
    key, n = np.concatenate(keys), np.concatenate(links)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = C.run_starts(key)
    key, n = key[first], np.add.reduceat(n, first)
    return key // (n_a * n_b), key // n_b % n_a << 32 | key % n_b, n


class Spelling:
    """Decimal ids in the text of groups: ``a1,a2|b1;...``"""

    def __init__(self, n_a: int, n_b: int):
        a, b = [str(i) for i in range(n_a)], [str(i) for i in range(n_b)]
        self.of = [x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b]
        self.n_a, self.n_b = n_a, n_b

    def groups(self, a, b, cut_a, cut_b, ends: np.ndarray) -> list[str]:
        """Text of each document; ``ends`` are the numbers of groups up to the end of each."""
        code_a, code_b = a.astype(np.int64), b.astype(np.int64) + 2 * self.n_a
        code_a[cut_a] += self.n_a
        code_b[cut_b] += self.n_b
        na, nb = np.diff(np.append(-1, cut_a)), np.diff(np.append(-1, cut_b))
        out = np.empty(len(a) + len(b), np.int64)
        begin_b = np.cumsum(nb) - nb
        out[np.arange(len(a)) + np.repeat(begin_b, na)] = code_a
        out[np.arange(len(b)) + np.repeat(np.cumsum(na), nb)] = code_b
        words, bounds = out.tolist(), [0, *(cut_a[ends - 1] + cut_b[ends - 1] + 2).tolist()]
        get = self.of.__getitem__
        return ["".join(map(get, words[i:j]))[:-1] for i, j in zip(bounds, bounds[1:])]


# ------------------------------------------------------------------ one block

class _Block:
    """Documents of a block: rows to yield at once and their pairs until the block is closed."""

    def __init__(self, number: int):
        self.number, self.bytes, self.rows, self.runs = number, 0, [], []


def _encode(column: pa.Array, side_a, side_b):
    """``(flat ids, number per text)`` of both sides; a text has none where either side does not spell a space and it."""
    texts = [t or b"" for t in column.to_pylist()]
    plain = [t.decode("utf-8", "replace") for t in texts]
    flat, counts = (array("q"), array("q")), ([], [])
    spelt = [u.encode() == t for u, t in zip(plain, texts)]              # the byte-level side spells any text
    for t, u, good, a in zip(texts, plain, spelt, side_a.plain_all(plain, tokens.odd_texts(column), " ")):
        b = side_b.plain(u) if good and t else []
        if b"".join(map(side_b.bytes_of.__getitem__, b)) != b" " + t:
            a, b = [], []
        for k, ids in enumerate((a, b)):
            flat[k].extend(ids)
            counts[k].append(len(ids))
    return [np.array(f, np.int64) for f in flat], [np.array(c, np.int64) for c in counts]


def _run(column: pa.Array, side_a, side_b, spelling):
    """Alignment of the texts (binary) of one run: per text ``n_a, n_b, n_groups, n_links, groups``, and the
    ``(document, pair, links)`` arrays."""
    (a, b), (n_a, n_b) = _encode(column, side_a, side_b)
    docs = np.flatnonzero(n_a)
    n_groups, n_links, groups = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64), [""] * len(n_a)
    if not len(docs):
        return n_a, n_b, n_groups, n_links, groups, (np.zeros(0, np.int64),) * 3
    end_a, end_b = np.cumsum(side_a.length_of[a]), np.cumsum(side_b.length_of[b])
    first_a = np.cumsum(n_a[docs]) - n_a[docs]
    cut_a, cut_b, of_a, of_b = lockstep(end_a, end_b, first_a)
    doc_of_a = np.repeat(docs, n_a[docs])
    ends = np.searchsorted(cut_a, first_a + n_a[docs], "left")
    size = np.diff(np.append(-1, cut_a)) * np.diff(np.append(-1, cut_b))
    n_groups[docs] = np.diff(np.append(0, ends))
    n_links[docs] = np.add.reduceat(size, np.append(0, ends[:-1]))
    for d, g in zip(docs.tolist(), spelling.groups(a, b, cut_a, cut_b, ends)):
        groups[d] = g
    return n_a, n_b, n_groups, n_links, groups, pair_counts(a, b, doc_of_a, of_a, of_b)


def _closed(n_docs: int, doc: np.ndarray, pair: np.ndarray, links: np.ndarray):
    """``(pairs, documents that hold them)`` of a block, most frequent first, and each document's packed
    places in that list with its numbers of links."""
    distinct, place, held = np.unique(pair, return_inverse=True, return_counts=True)
    by = np.lexsort((distinct, -held))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    place = rank[place]
    order = np.argsort(doc * max(len(distinct), 1) + place)             # documents are in order already
    place, links = place[order], links[order]
    bounds = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    cells = [C.pack(C.small(np.diff(place[i:j], prepend=0)), C.small(links[i:j] - 1)) if j > i else b""
             for i, j in zip(bounds, bounds[1:])]
    return distinct[by], held[by], cells


# ------------------------------------------------------------------ the operator

def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", carry=(),
               block_bytes: int = TEXT_BLOCK, run_bytes: int = RUN) -> DataFrame:
    """Rows of documents (``doc`` struct of carried columns, ``n_a, n_b, n_groups, n_links``, ``groups`` as text,
    ``cell``: packed pairs) and one row per block (``pairs`` and ``held``: its distinct pairs and in how many of
    its documents they are).  ``path_a`` names a byte-level vocabulary, ``path_b`` a sentencepiece model, on
    every worker.  Nothing is shuffled."""
    ship_package(docs.sparkSession)
    doc = F.struct(*[F.col(c) for c in (carry or [id_col])]).alias("doc")
    rows = docs.select(doc, F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc", rows.schema["doc"].dataType),
                           *T._parse_datatype_string("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                                                     "cell binary, pairs array<bigint>, held array<bigint>").fields])

    def align(batches):
        side_a, side_b = tokens.byte_tokens(path_a), tokens.piece_tokens(path_b)
        spelling = Spelling(len(side_a.bytes_of), len(side_b.bytes_of))
        number, size, parts, shape = TaskContext.get().partitionId() << 32, 0, [], None

        def close():
            at, doc_parts = 0, []
            for part, *_, (d, _, _) in parts:
                doc_parts.append(d + at)
                at += part.num_rows
            pair, links = (np.concatenate([p[-1][k] for p in parts]) for k in (1, 2))
            distinct, held, cells = _closed(at, np.concatenate(doc_parts), pair, links)
            at = 0
            for part, n_a, n_b, n_groups, n_links, groups, _ in parts:
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), part.column("doc"), *[pa.array(x) for x in (n_a, n_b, n_groups, n_links)],
                     pa.array(groups, pa.string()), pa.array(cells[at:at + n], pa.binary()),
                     pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))],
                    names=["block", "doc", "n_a", "n_b", "n_groups", "n_links", "groups", "cell", "pairs", "held"])
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.nulls(1, shape), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()),
                 pa.array([distinct], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64()))],
                names=["block", "doc", "n_a", "n_b", "n_groups", "n_links", "groups", "cell", "pairs", "held"])

        for part in tokens.slices(batches, "text", run_bytes):
            shape = part.column("doc").type
            parts.append((part.select(["doc"]), *_run(part.column("text"), side_a, side_b, spelling)))
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= block_bytes:
                yield from close()
                number, size, parts = number + 1, 0, []
        if parts:
            yield from close()

    return rows.mapInArrow(align, schema)


def with_counts(aligned: DataFrame) -> DataFrame:
    """Documents of :func:`alignments` with ``n_best`` (links whose pair is held by as many documents as any
    pair of its A id) and ``count_sum`` (documents that hold the pair, summed over links)."""
    cut = cut_lineage(aligned, compression="zstd")
    lists = cut.filter(F.col("pairs").isNotNull())
    held = lists.select("block", F.posexplode(F.arrays_zip("pairs", "held"))) \
        .select("block", F.col("pos"), F.col("col.pairs").alias("pair"), F.col("col.held").alias("held"))
    counts = held.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = counts.join(most, "a").select("pair", F.when(F.col("count") == F.col("most"), -F.col("count")).otherwise(F.col("count")).alias("count"))
    answers = held.select("block", "pos", "pair").join(known, "pair").select(F.col("block").alias("to_block"), "pos", "count")
    rows = cut.filter(F.col("pairs").isNull()).drop("pairs", "held")
    kept = [c for c in rows.columns if c not in ("block", "cell")]

    def count(key, table, told):
        signed = np.zeros(told.num_rows, np.int64)
        signed[told.column("pos").to_numpy()] = told.column("count").to_numpy()
        best, total = [], []
        for cell in table.column("cell").to_pylist():
            if not cell:
                best.append(0)
                total.append(0)
                continue
            place, links = C.unpack(cell, None, None)
            seen, links = signed[np.cumsum(C.wide(place))], C.wide(links) + 1
            best.append(int(links[seen < 0].sum()))
            total.append(int((np.abs(seen) * links).sum()))
        return pa.table([*[table.column(c) for c in kept], pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_best", "count_sum"])

    fields = T.StructType([*[rows.schema[c] for c in kept], *T._parse_datatype_string("n_best bigint, count_sum bigint").fields])
    return rows.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(count, fields)
