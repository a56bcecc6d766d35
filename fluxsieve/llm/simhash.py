"""SimHash near-dedup by covering locality-sensitive hashing (operator 4).

A document's fingerprint has a bit set if it is set in over half of the 64-bit hashes of its
word shingles.  Fingerprints within ``radius`` bits are linked; documents connected by links
form a group.

Covering masks.  Bit i gets a nonzero vector of ``radius + 1`` bits; for each nonzero vector v
there is a table that looks only at the bits whose vector has odd overlap with v.  Any
``radius`` differing bits span less than the whole space, so some v is orthogonal to all of
them and its table does not see the difference: *every* pair within the radius collides in at
least one of the ``2^(radius+1) - 1`` tables (7 for radius 2).

Only distinct fingerprints are compared, so copies cost nothing.  Within a bucket of up to
``bucket`` fingerprints the links are found by comparing bits in one small task; fuller buckets
never meet in one task: their fingerprints are sent to all values within half the radius, where
two meet if and only if they are within the radius, and no more than 65 meet at radius 2.
Each bucket hands on a spanning set of links, not pairs.

Defined results: a document without words (null or empty text) has fingerprint zero and is
linked like any other; documents with fewer words than a shingle are one shingle; a group's
``component_id`` is its least id, ignoring null ids (null if all are null).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage, ship_package
from . import common as C

BITS = 64


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of a text's shingles (XXH64, seed 42; A-Z lower-cased), as an unsigned integer."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    joined = b" ".join(w)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    begin, end = (ends - sizes)[:len(w) - words + 1].tolist(), ends[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[i:j], 42) for i, j in zip(begin, end)], np.uint64, len(begin))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, carry=()) -> DataFrame:
    """``(doc struct, id, fp)``: the columns named in ``carry`` (default the id) travel in ``doc``."""
    ship_package(docs.sparkSession)
    src = docs.select(F.struct(*[F.col(c) for c in (carry or [id_col])]).alias("doc"),
                      F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc", "id", "fp"])

    return src.mapInArrow(run, C.out_schema(src, "id bigint, fp bigint"))


def covering_masks(radius: int) -> list[int]:
    """One 64-bit mask for each nonzero vector of ``radius + 1`` bits."""
    top = 1 << (radius + 1)
    return [sum(1 << i for i in range(BITS) if bin((i % (top - 1) + 1) & v).count("1") % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 2, bucket: int = 128) -> DataFrame:
    """``(a, b)``: links that connect all of ``fps(fp)`` (distinct) within ``radius`` bits of each other."""
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for k, m in enumerate(covering_masks(radius))])
    spread = fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.k", "t.key")
    sizes = spread.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut_lineage(spread.join(sizes, ["k", "key"]))
    small = met.filter(F.col("n") <= bucket).groupBy("k", "key").agg(F.collect_list("fp").alias("fps"))

    def solve(batches):
        for batch in batches:
            a, b = [], []
            for fp in batch.column(0).to_pylist():
                x = np.sort(np.array(fp, np.int64)).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                label = np.arange(len(x))
                while True:
                    new = np.where(near, label[None, :], len(x)).min(axis=1)
                    if (new == label).all():
                        break
                    label = new
                far = np.flatnonzero(label != np.arange(len(x)))
                a += x[label[far]].view(np.int64).tolist()
                b += x[far].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    near = small.select("fps").mapInArrow(solve, "a bigint, b bigint")
    # fuller buckets: meet at every value within half the radius (for an odd radius, one side goes a bit further)
    full = met.filter(F.col("n") > bucket).select("fp").distinct()
    half = (radius + 1) // 2
    flips = [_signed(sum(1 << i for i in pick)) for k in range(half + 1) for pick in itertools.combinations(range(BITS), k)]
    meet = full.select("fp", F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    met_at = meet.groupBy("at").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    if radius % 2:
        crowded = met_at.select("fps").mapInArrow(solve, "a bigint, b bigint")
    else:
        crowded = met_at.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return near.unionAll(crowded).distinct()


def _roots(found: DataFrame, radius: int) -> DataFrame:
    """``(fp, root)`` of the fingerprints that have links."""
    nodes = found.select("fp").distinct()
    return connected_components(links(nodes, radius)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2,
                    carry=()) -> DataFrame:
    """Carried columns (default the id) with ``fingerprint`` (16 hex digits) and ``component_id``."""
    found = cut_lineage(fingerprints(docs, id_col, text_col, words, carry))
    roots = cut_lineage(_roots(found, radius))
    least = found.groupBy("fp").agg(F.min("id").alias("least")).join(roots, "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = least.groupBy("root").agg(F.min("least").alias("component_id"))
    group_of = least.join(group, "root").select("fp", "component_id")
    return found.join(group_of, "fp").select(
        *[F.col("doc").getField(c).alias(c) for c in (carry or [id_col])],
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` (all columns) with one row of each group: the least id (null ids last), then the least
    hash of its text; of equal rows any one."""
    cols = docs.columns
    found = cut_lineage(fingerprints(docs, id_col, text_col, words, carry=cols))
    roots = cut_lineage(_roots(found, radius))
    group = found.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), F.xxhash64(F.col("doc").getField(text_col)))
    return group.withColumn("rank", F.row_number().over(first)).filter("rank = 1") \
        .select(*[F.col("doc").getField(c).alias(c) for c in cols])
