"""Token-id files: canonical length-limited Huffman coding of ids (operator 12).

A folder written by :func:`write` holds three tables:

* ``blocks``: about 65,536 ids each, which decode without any other block.  A block has the ids of
  its documents, their lengths, the packed code bits and a *checkpoint* (bit offset) at every 256th id;
* ``code``: the bit length of every id that occurs.  Codes are canonical, so lengths say all;
* ``shards``: the number of ids before each shard.  Shards are ranges of document ids.

1. Documents are range-sorted by id into shards; a shard's task encodes its texts one after the
   other, appends the end id and writes ids with their running offset in the shard.
2. Counts of all ids over all documents (pre-summed in each task; at most one row per vocabulary
   entry) give the code lengths by package-merge, at most ``limit`` bits.
3. Blocks are packed: codes are shifted to their bit offsets and summed into 32-bit words.
4. :func:`read` decodes by one table with an entry for every ``limit``-bit prefix.  All checkpoints
   of a run of blocks are decoded side by side: each step reads one id at every one of them.

A document longer than a block fills blocks of its own, put together again on reading.  Everything
is read and written by Spark, so a lost executor costs its tasks only and the folder may be in any store.

Defined results: a null or empty text has the end id alone; null document ids come after all others;
rows that repeat a document id come in the order of a hash of their text, and rows that repeat both
are alike; very long texts are split over blocks; an empty table gives empty files; further columns
are not written.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from . import tokens

#: Ids of a block, ids between checkpoints, bytes of text of a shard, least and greatest number of shards.
BLOCK, STEP, SHARD_BYTES, SHARDS = 1 << 16, 256, 32 << 20, (32, 1 << 16)
SLICE = 8 << 20


# ------------------------------------------------------------------ the code

def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each symbol of an optimal prefix code of at most ``limit`` bits (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in {limit} bits")
    order = np.argsort(counts, kind="stable")
    own, last, levels = counts[order].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([own, last[:len(last) // 2 * 2].reshape(-1, 2).sum(axis=1)])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        last = both[at]
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        k = int(single[:take].sum())
        out[order[:k]] += 1
        take = 2 * (take - k)
    return out


def limit_for(symbols: int) -> int:
    """Longest code allowed: one bit more than equal lengths would need, at least 16."""
    return max(16, max(symbols - 1, 0).bit_length() + 1)


class Code:
    """Canonical code of ``ids`` (ascending) with the given bit lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, limit: int):
        self.limit = limit
        order = np.lexsort((ids, lengths))
        span = np.int64(1) << (limit - lengths[order])
        first = np.cumsum(span) - span
        size = int(ids.max()) + 1 if len(ids) else 1
        self.bits, self.word = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.bits[ids] = lengths
        self.word[ids[order]] = (first >> (limit - lengths[order])).astype(np.uint64)
        self.symbol, self.used = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
        whole = np.repeat(np.arange(len(ids)), span)
        self.symbol[:len(whole)] = ids[order][whole]
        self.used[:len(whole)] = lengths[order][whole]

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """``(checkpoints, code bits)`` of one block."""
        bits = self.bits[ids]
        end = np.cumsum(bits)
        at = end - bits
        shifted = self.word[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        words, n = at >> 5, int(end[-1] >> 5) + 2 if len(ids) else 1
        # the pieces of a 32-bit word do not overlap, so their sum is their union (exact in a double)
        out = np.bincount(words, (shifted >> np.uint64(32)).astype(np.float64), n)
        out += np.bincount(words + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
        return at[::STEP].astype("<u4").tobytes(), out.astype(">u4").tobytes()

    def unpack(self, blocks: list[tuple[int, bytes, bytes]]) -> np.ndarray:
        """Ids of the ``(number, checkpoints, code bits)`` blocks, one after the other."""
        words = np.frombuffer(b"".join(b[2] for b in blocks), ">u4").astype(np.uint64)
        words = np.append(words, np.zeros(STEP, np.uint64))
        pair = words[:-1] << np.uint64(32) | words[1:]
        base, at, left = 0, [], []
        for n, marks, bits in blocks:
            m = np.frombuffer(marks, "<u4").astype(np.int64)
            at.append(m + base * 8)
            left.append(np.minimum(n - STEP * np.arange(len(m)), STEP))
            base += len(bits)
        if not at:
            return np.zeros(0, np.uint32)
        at, left = np.concatenate(at), np.concatenate(left)
        out, down, stop = np.empty((STEP, len(at)), np.uint32), np.uint64(64 - self.limit), len(pair) - 1
        for k in range(STEP):
            seen = pair[np.minimum(at >> 5, stop)] << (at & 31).astype(np.uint64) >> down
            out[k] = self.symbol[seen]
            at += self.used[seen]
        return out.T[np.arange(STEP)[None, :] < left[:, None]]


# ------------------------------------------------------------------ writing

def shard_count(docs: DataFrame, text_col: str) -> int:
    """Shards of some 32 MB of text; at most 65,536, each of which is written as a stream."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return min(max(SHARDS[0], -(-int(total) // SHARD_BYTES)), SHARDS[1])


def encoded(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard, at, n_tokens, doc_id, ids`` in ascending order of the id; ``at`` counts the ids before the
    document in its shard, ``ids`` are packed in the narrowest type (the end id included)."""
    ship_package(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("h"))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    ordered = rows.repartitionByRange(shard_count(docs, text_col), *keys).sortWithinPartitions(*keys)

    def encode(batches):
        t = tokens.byte_tokens(vocabulary)
        kind = "H" if len(t.bytes_of) <= 1 << 16 else "I"
        shard, at = TaskContext.get().partitionId(), 0
        for part in tokens.slices(batches, "text", SLICE):
            texts = [x.decode("utf-8", "replace") if x else "" for x in part.column("text").to_pylist()]
            ids = [array(kind, x) for x in t.encode_all(texts, tokens.odd_texts(part.column("text")))]
            for x in ids:
                x.append(end_id)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), pa.array(ends - n), pa.array(n), part.column("doc_id"),
                 pa.array([x.tobytes() for x in ids], pa.binary())], names=["shard", "at", "n_tokens", "doc_id", "ids"])
            at = int(ends[-1])

    return ordered.mapInArrow(encode, "shard int, at bigint, n_tokens bigint, doc_id bigint, ids binary")


def _flat(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """Ids of a column of packed ids as one array."""
    raw, _ = tokens._bytes(column)
    return raw.view(f"<u{len(raw) // int(n.sum())}")


def id_counts(rows: DataFrame) -> DataFrame:
    """``id, n`` over all documents; a task sends one row per id that it saw."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for part in tokens.slices(batches, "ids", SLICE):
            new = np.bincount(_flat(part.column("ids"), part.column("n_tokens").to_numpy()))
            if len(new) > len(total):
                new[:len(total)] += total
                total = new
            else:
                total[:len(new)] += new
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return rows.select("n_tokens", "ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(rows: DataFrame, ids: np.ndarray, lengths: np.ndarray, limit: int) -> DataFrame:
    """Packed blocks; one never crosses shards, and a document of several blocks has them to itself."""
    schema = pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int64())), ("piece", pa.int32()), ("pieces", pa.int32()), ("marks", pa.binary()),
                        ("bits", pa.binary())])

    def pack(batches):
        code = Code(ids, lengths, limit)
        for part in tokens.slices(batches, "ids", SLICE):
            n, shard, at = (part.column(c).to_numpy() for c in ("n_tokens", "shard", "at"))
            flat, names, out = _flat(part.column("ids"), n), part.column("doc_id").to_pylist(), []
            ends = np.cumsum(n)

            def add(i, j, lo, hi, piece, pieces):
                out.append((int(shard[i]), int(at[i]) + lo, hi - lo, names[i:j], n[i:j].tolist(), piece, pieces,
                            *code.pack(flat[ends[i] - n[i] + lo:ends[i] - n[i] + hi])))
            i = 0
            while i < len(n):
                if n[i] > BLOCK:
                    many = -(-int(n[i]) // BLOCK)
                    for p in range(many):
                        add(i, i + 1, p * BLOCK, min((p + 1) * BLOCK, int(n[i])), p, many)
                    i += 1
                    continue
                j = i + 1
                while j < len(n) and shard[j] == shard[i] and at[j] == at[j - 1] + n[j - 1] and ends[j] - ends[i] + n[i] <= BLOCK:
                    j += 1
                add(i, j, 0, int(ends[j - 1] - ends[i] + n[i]), 0, 1)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(pack, "shard int, at bigint, n_ids bigint, doc_ids array<bigint>, sizes array<bigint>, piece int, "
                                 "pieces int, marks binary, bits binary")


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the three tables of a token folder under ``path`` (must not exist)."""
    spark = docs.sparkSession
    rows = cut_lineage(encoded(docs, vocabulary, end_id, id_col, text_col), compression="zstd")
    counts = id_counts(rows).orderBy("id").collect()                   # at most one row per vocabulary entry
    ids, n = np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64)
    limit = limit_for(len(ids))
    lengths = code_lengths(n, limit)
    _blocks(rows, ids, lengths, limit).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), [limit] * len(ids))), "id bigint, bits bigint, bit_limit int") \
        .coalesce(1).write.parquet(f"{path}/code")
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()     # at most SHARDS[1] rows
    base = np.cumsum([0, *[r.n for r in sizes]]).tolist()
    spark.createDataFrame([(r.shard, b) for r, b in zip(sizes, base)], "shard int, before bigint").coalesce(1).write.parquet(f"{path}/shards")


# ------------------------------------------------------------------ reading

@functools.lru_cache(maxsize=2)
def _code(ids: bytes, lengths: bytes, limit: int) -> Code:
    return Code(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64), limit)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in a token folder: ``start`` counts the ids of all
    documents before it, ``ids`` are little-endian unsigned 32-bit integers."""
    ship_package(spark)
    rows = spark.read.parquet(f"{path}/code").orderBy("id").collect()
    ids, lengths = (np.array([r[c] for r in rows], np.int64).tobytes() for c in ("id", "bits"))
    limit = rows[0].bit_limit if rows else limit_for(0)

    def decode(batches):
        code = _code(ids, lengths, limit)
        for part in tokens.slices(batches, "bits", SLICE >> 2):
            t = part.to_pydict()
            flat = code.unpack(list(zip(t["n_ids"], t["marks"], t["bits"]))).astype("<u4")
            whole = [p == 1 for p in t["pieces"]]
            sizes = [s if w else [n] for s, n, w in zip(t["sizes"], t["n_ids"], whole)]
            count = np.array([len(s) for s in sizes], np.int64)
            n = np.array([x for s in sizes for x in s], np.int64)
            ends, of = np.cumsum(n), np.repeat(np.arange(len(sizes)), count)
            begin = np.cumsum(np.array(t["n_ids"], np.int64)) - np.array(t["n_ids"], np.int64)
            # pieces of one document all carry the offset of its first id
            at = np.array(t["at"], np.int64) - np.where(whole, 0, np.array(t["piece"], np.int64) * BLOCK)
            start = at[of] + np.where(np.array(whole)[of], ends - n - begin[of], 0)
            offsets = pa.array(np.concatenate([[0], ends * 4]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(t["shard"], np.int32)[of]), pa.array(start), pa.array([d for s in t["doc_ids"] for d in s], pa.int64()),
                 pa.array(np.array(t["piece"], np.int32)[of]), pa.array(n),
                 pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(flat.tobytes())])],
                names=["shard", "at", "doc_id", "piece", "n_tokens", "ids"])

    def whole(key, table):
        order = np.argsort(table.column("piece").to_numpy(), kind="stable")
        parts = table.column("ids").to_pylist()
        joined = b"".join(parts[i] for i in order)
        return pa.table([table.column("shard")[:1], table.column("at")[:1], table.column("doc_id")[:1], pa.array([len(joined) // 4], pa.int64()),
                         pa.array([joined], pa.binary())], names=["shard", "at", "doc_id", "n_tokens", "ids"])

    fields = "shard int, at bigint, doc_id bigint, n_tokens bigint, ids binary"
    blocks = spark.read.parquet(f"{path}/blocks")
    decoded = "shard int, at bigint, doc_id bigint, piece int, n_tokens bigint, ids binary"
    out = blocks.filter("pieces = 1").mapInArrow(decode, decoded).drop("piece").unionByName(
        blocks.filter("pieces > 1").mapInArrow(decode, decoded).groupBy("shard", "at").applyInArrow(whole, fields))
    before = F.broadcast(spark.read.parquet(f"{path}/shards"))          # at most SHARDS[1] rows of twelve bytes
    return out.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
