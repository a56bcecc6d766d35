"""Shared plumbing of the text operators: document batches and message rounds.

Operators that compare every document with every other one (substring and suffix
matching, chunk reuse, n-gram counting) run as *rounds* between two kinds of Spark groups:

* a **batch** is a hash bucket of documents (a few MB of text).  The documents are
  shuffled to their batches once; all rounds of one operator read that same exchange;
* a **bucket** is a range of key hashes.  A batch sends each bucket the distinct keys it
  holds (pre-aggregated, sorted numpy columns in one binary cell); the bucket groups the
  keys of all batches and answers every batch, aligned with what that batch sent.

A key that a third of all documents hold therefore costs one entry per batch, never one
per document, and no group holds more than one batch's text or one bucket's keys.  Both
counts grow with the input.  All groups are pure functions of their rows, so a lost
executor only costs recomputing its groups.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20
MIN_GROUPS = 32
#: A null id sorts after every other id.
NULL_ID = np.iinfo(np.int64).max

#: Message between a batch and a bucket: packed numpy columns.
MSG = "dest int, src int, kind int, data binary"
MSG_SCHEMA = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ------------------------------------------------------------------ batches

def group_count(docs: DataFrame, text_col: str, batch_bytes: int = BATCH_BYTES) -> int:
    """Number of batches (and of buckets): total text bytes over ``batch_bytes``, at least ``MIN_GROUPS``."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(MIN_GROUPS, -(-int(total) // batch_bytes))


def batched(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """``(batch, id, text binary, doc struct)``: the columns named in ``carry`` travel in ``doc``."""
    key = F.col(id_col).cast("long")
    spread = F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.col(text_col)))
    doc = F.struct(*[F.col(c) for c in (carry or [id_col])]).alias("doc")
    return docs.select(F.pmod(spread, F.lit(n)).cast("int").alias("batch"), key.alias("id"),
                       F.col(text_col).cast("binary").alias("text"), doc)


def rows_in_order(table: pa.Table):
    """The rows of one batch in an order that does not depend on shuffle arrival: ``(table, ids, texts)``.

    Rows equal in id and text are interchangeable, so every round sees the same row numbers.
    """
    ids = [NULL_ID if x is None else x for x in table.column("id").to_pylist()]
    texts = [x or b"" for x in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return (table.take(pa.array(order, pa.int64())), np.array([ids[i] for i in order], np.int64),
            [texts[i] for i in order])


# ------------------------------------------------------------------ messages

def pack(*columns) -> bytes:
    """Raw numpy columns (or bytes) in one cell."""
    raw = [c if isinstance(c, bytes) else np.ascontiguousarray(c).tobytes() for c in columns]
    return struct.pack(f"<{len(raw)}Q", *map(len, raw)) + b"".join(raw)


def unpack(cell: bytes, *dtypes) -> list:
    """Inverse of :func:`pack`; dtype ``None`` gives bytes."""
    sizes, at, out = struct.unpack_from(f"<{len(dtypes)}Q", cell), 8 * len(dtypes), []
    for n, t in zip(sizes, dtypes):
        out.append(bytes(cell[at:at + n]) if t is None else np.frombuffer(cell, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def small(x: np.ndarray) -> bytes:
    """Unsigned integers in few bytes: the narrowest type that holds all (a leading byte says which; four bytes as
    lower and upper halves, of which the shuffle's compression folds the upper), or, where that is shorter, one
    byte each (leading byte 0) with those from 255 on listed behind."""
    big = x >= 255
    n_big = int(big.sum())
    size = 1 if not n_big or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 if x.max() < 1 << 32 else 8
    if n_big and 16 + len(x) + 8 * n_big < size * len(x):
        return bytes([0]) + struct.pack("<QQ", len(x), n_big) + np.where(big, 255, x).astype(np.uint8).tobytes() \
            + x[big].astype("<u8").tobytes()
    if size == 4:
        return bytes([size]) + (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes()
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def wide(x: bytes) -> np.ndarray:
    """Inverse of :func:`small`, as 64-bit integers."""
    if x[0] == 4:
        half = np.frombuffer(x, "<u2", (len(x) - 1) // 2, 1).astype(np.int64).reshape(2, -1)
        return half[0] | half[1] << 16
    if x[0]:
        return np.frombuffer(x, f"<u{x[0]}", (len(x) - 1) // x[0], 1).astype(np.int64)
    n, n_big = struct.unpack_from("<QQ", x, 1)
    out = np.frombuffer(x, np.uint8, n, 17).astype(np.int64)
    out[out == 255] = np.frombuffer(x, "<u8", n_big, 17 + n).astype(np.int64)
    return out


def messages(rows) -> pa.Table:
    """``[(dest, src, kind, data)]`` as an Arrow table."""
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, MSG_SCHEMA)], schema=MSG_SCHEMA)


def inbox(table: pa.Table, kind: int | None = None) -> list[tuple[int, int, bytes]]:
    """``(dest, src, data)`` of one kind, ordered by sender."""
    got = zip(table.column("dest").to_pylist(), table.column("src").to_pylist(), table.column("kind").to_pylist(),
              table.column("data").to_pylist())
    return sorted(((d, s, x) for d, s, k, x in got if kind is None or k == kind), key=lambda m: (m[0], m[1]))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit hash: equal ranges of the hash space (fewer than 2^32), so they rise with the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def runs(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """``(bucket, first, end)`` for the buckets that occur."""
    first = run_starts(sorted_buckets)
    return list(zip(sorted_buckets[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_buckets)).tolist()))


def by_bucket(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """``(bucket, first, end)`` of the sorted hashes, for the buckets that own some."""
    return runs(bucket_of(sorted_hashes, buckets))


def ask(sorted_hashes: np.ndarray, buckets: int, src: int, kind: int, *columns) -> list:
    """One message per bucket that owns some of the (sorted) hashes, with the matching slices."""
    return [(b, src, kind, pack(sorted_hashes[i:j], *[c[i:j] for c in columns])) for b, i, j in by_bucket(sorted_hashes, buckets)]


def replies(table: pa.Table, kind: int, dtype) -> np.ndarray:
    """A batch's answers of one kind joined in bucket order, which is the order of the hashes it sent."""
    got = [unpack(x, dtype)[0] for _, _, x in inbox(table, kind)]
    return np.concatenate(got) if got else np.zeros(0, dtype)


# ------------------------------------------------------------------ hashing

def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash, remembering a bounded number of words."""

    LIMIT = 1 << 19

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h
        return h


def word_hashes(texts, cache: WordHash):
    """Word hashes of all texts in one array, with each text's word count.

    Words are runs of anything but space and the control characters 0x09-0x0D, which is
    what ``bytes.split`` separates on.
    """
    parts, counts = [], []
    for t in texts:
        w = t.split()
        counts.append(len(w))
        parts.append(np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def windows(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive elements (``len(h) - length + 1`` of them)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc, b = np.zeros(n, np.uint64), np.uint64(base)
    for k in range(length - 1, -1, -1):
        acc *= b
        acc += h[k:k + n]
    return mix(acc)


def layout(counts: np.ndarray):
    """For elements laid out text after text: ``(first element of each text, text of each element)``."""
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return starts, np.repeat(np.arange(len(counts)), counts)


def run_starts(*sorted_columns) -> np.ndarray:
    """Index of the first row of each run of equal rows."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def result(table: pa.Table, **columns) -> pa.Table:
    """The carried ``doc`` column of a batch beside result columns."""
    names, arrays = ["doc", *columns], [table.column("doc").combine_chunks(), *columns.values()]
    return pa.table(arrays, names=names)


def out_schema(carrier: DataFrame, rest: str) -> T.StructType:
    """The carried ``doc`` as it is (nested columns keep whether they may be null) beside further columns."""
    return T.StructType([carrier.schema["doc"], *T._parse_datatype_string(rest).fields])


def with_carried(df: DataFrame, carry, id_col: str) -> DataFrame:
    """Open the ``doc`` struct again in front of the result columns."""
    return df.select(*[F.col("doc").getField(c).alias(c) for c in (carry or [id_col])],
                     *[F.col(c) for c in df.columns if c != "doc"])
