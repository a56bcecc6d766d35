"""Exact global ranks without a one-partition window.

``Window.orderBy(...)`` with no partition pulls every row into one task.  Instead the rows go
through one range exchange on the sort keys, always ending in the unique id, so that a hot value
is spread over many partitions like any other range.  Each partition is sorted and numbered where
it lies; the exchanged rows are written once (range limits come from a sample, so partition numbers
are only stable within what was written), and partition sizes, one row per partition, give each
partition's first rank.  The same path serves every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PLACE_BITS = 33        # monotonically_increasing_id: partition number above, row number below (fixed by Spark)


def hash_key(seed, key: str = "dimx") -> Column:
    """Reproducible random order key: ``md5('<seed>|<id>')`` (same digest in DuckDB)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def global_rank(df: DataFrame, order_cols: list[str], key: str = "dimx", out: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row by ``order_cols`` (ascending, missing last), then ``key``."""
    order = [F.col(c).asc_nulls_last() for c in [*order_cols, *([key] if key not in order_cols else [])]]
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", _PLACE_BITS)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__start"))
    return placed.withColumn("__p", part).join(F.broadcast(starts), "__p") \
        .withColumn(out, F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))) \
        .drop("__p", "__m", "__start")
