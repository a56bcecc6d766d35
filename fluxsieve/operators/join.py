"""Joins by closeness."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

#: Rows of the left side that one range (or one part of a hot range) holds, most ranges, relative room for rounding.
RANGE_ROWS, RANGES, ROOM = 50_000, 10_000, 1e-12


def _ranges(values: DataFrame, column: str, rows: int) -> list[float]:
    """Limits of about equally full ranges, from a quantile sketch; a hot value is a range of its own at most."""
    n = values.count()
    parts = min(RANGES, max(1, math.ceil(n / rows)))
    if parts == 1:
        return []
    got = values.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], parts * 10)).first()[0]
    return sorted(set(got))


def band_join(left: DataFrame, lcol: str, right: DataFrame, rcol: str, atol: float, rtol: float, rows: int = RANGE_ROWS) -> DataFrame:
    """I-21: rows whose values are close (``|l - r| <= atol + rtol |r|``); missing and infinite values match nothing.

    A range join: both sides are cut at the quantiles of the left values.  A right row goes to every range that its
    tolerance reaches (one, or two beside a limit).  A range that is still large, say of one hot value, is dealt out by the
    left rows' hash, its right rows going to every part.  Inside a task both sides are merged in order of value.
    """
    spark = left.sparkSession
    ship_package(spark)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    both = [c for c in left.columns if c in right.columns]
    if both:
        raise ValueError(f"columns on both sides: {both}")
    lv, rv = F.col(lcol).cast("double"), F.col(rcol).cast("double")
    reach = F.lit(atol) + F.lit(rtol) * F.abs(rv)
    reach = reach + F.lit(ROOM) * (reach + F.abs(rv))
    lrows = left.filter(finite(lcol)).select(F.struct(*left.columns).alias("l"), lv.alias("v"))
    rrows = right.filter(finite(rcol)).select(F.struct(*right.columns).alias("r"), rv.alias("w"), (rv - reach).alias("low"), (rv + reach).alias("high"))
    limits = [-math.inf, *_ranges(lrows.select("v"), "v", rows), math.inf]

    def ranged(df, value, out):
        if len(limits) == 2:
            return df.withColumn(out, F.lit(0.0))
        return Bucketizer(splits=limits, inputCol=value, outputCol=out).transform(df)

    lrows = cut_lineage(ranged(lrows, "v", "range"))
    sizes = lrows.groupBy("range").agg(F.ceil(F.count("*") / rows).alias("parts"))          # at most RANGES rows
    lrows = lrows.join(F.broadcast(sizes), "range").withColumn("part", F.pmod(F.xxhash64(F.col("l"), F.monotonically_increasing_id()), "parts"))
    reached = ranged(ranged(rrows, "low", "a"), "high", "b").withColumn("range", F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int")))).withColumn("range", F.col("range").cast("double"))
    rrows = reached.join(F.broadcast(sizes.withColumnRenamed("parts", "m")), "range") \
        .withColumn("to_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).select(F.col("range").alias("to_range"), "to_part", "r", "w", "low", "high")
    schema = T.StructType([T.StructField("l", lrows.schema["l"].dataType), T.StructField("r", rrows.schema["r"].dataType)])

    def merge(group, a, b):
        v, w, low, high = (t.column(c).to_numpy() for t, c in ((a, "v"), (b, "w"), (b, "low"), (b, "high")))
        order = np.argsort(v, kind="stable")
        v = v[order]
        i, j = np.searchsorted(v, low, "left"), np.searchsorted(v, high, "right")
        n = np.maximum(j - i, 0)
        of = np.repeat(np.arange(len(w)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + i[of]
        close = np.abs(v[at] - w[of]) <= atol + rtol * np.abs(w[of])
        return pa.table([a.column("l").take(pa.array(order[at[close]])), b.column("r").take(pa.array(of[close]))], names=["l", "r"])

    out = lrows.groupBy("range", "part").cogroup(rrows.groupBy("to_range", "to_part")).applyInArrow(merge, schema)
    return out.select("l.*", "r.*")
