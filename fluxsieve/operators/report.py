"""Evaluation and reports (2.K) that need no network.

Each report is one aggregate job.  The filter-yield report evaluates every step's
cumulative predicate in a single pass over the unfiltered data (no count per step).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import INF
from .filters import SanityChain


def _stack(df: DataFrame, pairs: list[tuple[str, list[Column]]], names: list[str]) -> DataFrame:
    """Unpivot a one-row aggregate: one output row per ``(label, values...)``."""
    rows = F.explode(F.array(*[F.struct(F.lit(lbl).alias(names[0]),
                                        *[v.alias(n) for v, n in zip(vals, names[1:])])
                               for lbl, vals in pairs]))
    return df.select(rows.alias("__r")).select("__r.*")


def yield_report(df: DataFrame, chain: SanityChain, key: str = "dimx") -> DataFrame:
    """R-01: rows (and % of the start) left after each step of a chain, one pass."""
    flagged, steps = chain.flags(df, key)
    aggs = [F.count(F.lit(1)).alias("__start")] + [
        F.count_if(F.col(f"__alive_{s}")).alias(f"__n_{s}") for s in steps]
    one = flagged.agg(*aggs)
    pairs = [(s, [F.lit(i + 1), F.col(f"__n_{s}").cast("bigint"),
                  F.round(F.col(f"__n_{s}") * 100.0 / F.col("__start"), 6)]) for i, s in enumerate(steps)]
    return _stack(one, pairs, ["step", "step_no", "rows_left", "pct_left"])


def stability_breakdown(df: DataFrame, flags=("ITG", "TEM", "ETG")) -> DataFrame:
    """R-02: count and % per combination of instability flags (8 rows at most)."""
    counts = df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the <= 8 aggregated rows only
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(*flags, F.col("n").cast("bigint").alias("n"),
                         F.round(F.col("n") * 100.0 / total, 6).alias("pct"))


def mean_median(df: DataFrame, columns, decimals: int | None = None) -> DataFrame:
    """R-03: mean and median per column, nulls ignored (the median is the value at its rank; all columns side by side).  ``decimals``: the data
    has at most that many decimals, so the mean is taken from an exact decimal sum."""
    from ..functions.numeric import exact_mean
    from .select import quantiles
    one = df.agg(*[(F.avg(c) if decimals is None else exact_mean(F.col(c), decimals)).alias(f"{c}__mean") for c in columns])
    medians = {c: q[0] for c, q in quantiles(df.select(*columns), {c: [0.5] for c in columns}).items()}
    return _stack(one, [(c, [F.round(F.col(f"{c}__mean"), 6), F.round(F.lit(medians[c]).cast("double"), 6)])
                        for c in columns], ["name", "mean", "median"])


def standardization_table(df: DataFrame, columns, decimals: int | None = None) -> DataFrame:
    """R-04: mean and sample std (ddof 1) per column, one row per column (``decimals``: exact
    decimal sums, independent of partitioning)."""
    from ..functions.numeric import exact_mean, exact_std
    aggs = []
    for c in columns:
        if decimals is None:
            aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
        else:
            aggs += [exact_mean(F.col(c), decimals).alias(f"{c}__mean"),
                     exact_std(F.col(c), decimals).alias(f"{c}__std")]
    one = df.agg(*aggs)
    return _stack(one, [(c, [F.round(F.col(f"{c}__mean"), 6), F.round(F.col(f"{c}__std"), 6)])
                        for c in columns], ["name", "mean", "std"])


def special_value_counts(df: DataFrame, columns) -> DataFrame:
    """R-06: zeros, +inf, -inf and missing values per column."""
    aggs = []
    for c in columns:
        v = F.col(c)
        aggs += [F.count_if(v == 0).alias(f"{c}__z"), F.count_if(v == F.lit(INF)).alias(f"{c}__p"),
                 F.count_if(v == F.lit(-INF)).alias(f"{c}__m"),
                 F.count_if(v.isNull() | F.isnan(v)).alias(f"{c}__n")]
    one = df.agg(*aggs)
    return _stack(one, [(c, [F.col(f"{c}__{k}").cast("bigint") for k in "zpmn"]) for c in columns],
                  ["name", "zeros", "posinf", "neginf", "nulls"])


def _decade_bins(v: Column, maxpow: int) -> tuple[Column, Column]:
    """Bin edges of the signed decade histogram (np.histogram half-open rule)."""
    a = F.abs(v)
    up = F.floor(F.log10(a))
    dn = F.ceil(F.log10(a))
    up = F.when(up >= maxpow, F.lit(maxpow - 1)).otherwise(up)  # last bin is closed
    pos_lo = F.when(up < -3, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), up))
    pos_hi = F.when(up < -3, F.lit(1e-3)).otherwise(F.pow(F.lit(10.0), up + 1))
    neg_lo = F.when(dn <= -3, F.lit(-1e-3)).otherwise(-F.pow(F.lit(10.0), dn))
    neg_hi = F.when(dn <= -3, F.lit(0.0)).otherwise(-F.pow(F.lit(10.0), dn - 1))
    lo = F.when(v > 0, pos_lo).otherwise(neg_lo)
    hi = F.when(v > 0, pos_hi).otherwise(neg_hi)
    return lo, hi


def signed_log_histogram(df: DataFrame, column: str, subsets: dict[str, Column] | None = None,
                         symmetric: bool = True) -> DataFrame:
    """R-05 / R-07: counts per signed decade bin ``.. [-10,-1) .. [-1e-3,0) [0,1e-3) [1e-3,1e-2) ..``.

    Zero, infinite and missing values are left out of the bins (see R-06 for them).
    The outer decade comes from one small aggregate (``ceil(log10 |max|)``); every
    subset is counted in the same grouped pass.
    """
    subsets = subsets or {"all": F.lit(True)}
    v = F.col(column)
    ok = v.isNotNull() & ~F.isnan(v) & (v != 0) & (F.abs(v) < F.lit(INF))
    stats = df.filter(ok).agg(F.max(v).alias("mx"), F.min(v).alias("mn")).first()
    if stats["mx"] is None:
        return df.sparkSession.createDataFrame([], "subset string, bin_lo double, bin_hi double, n bigint")
    import math
    maxpow = math.ceil(math.log10(abs(stats["mx"])))
    minpow = math.ceil(math.log10(abs(stats["mn"])))
    lo, hi = _decade_bins(v, maxpow)
    lowest = -(10.0 ** maxpow) if symmetric else -(10.0 ** minpow)
    in_range = ok & (v >= F.lit(lowest)) & (v <= F.lit(10.0 ** maxpow))
    if not symmetric:
        in_range = in_range & ((v > 0) | (F.ceil(F.log10(F.abs(v))) <= minpow))
    tagged = df.filter(in_range).select(lo.alias("bin_lo"), hi.alias("bin_hi"),
                                        *[F.coalesce(p, F.lit(False)).alias(f"__s{i}")
                                          for i, p in enumerate(subsets.values())])
    g = tagged.groupBy("bin_lo", "bin_hi").agg(
        *[F.count_if(F.col(f"__s{i}")).alias(f"__n{i}") for i in range(len(subsets))])
    pairs = [F.struct(F.lit(name).alias("subset"), F.col(f"__n{i}").cast("bigint").alias("n"))
             for i, name in enumerate(subsets)]
    return (g.select("bin_lo", "bin_hi", F.explode(F.array(*pairs)).alias("__p"))
            .select(F.col("__p.subset").alias("subset"), "bin_lo", "bin_hi", F.col("__p.n").alias("n")))


def plain_histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """R-08: equal-width histogram of one target on [lo, hi]; the top edge is inclusive."""
    v = F.col(column)
    b = F.floor((v - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int")
    b = F.when(v == F.lit(hi), F.lit(bins - 1)).otherwise(b)
    return (df.filter(v.isNotNull() & (v >= lo) & (v <= hi)).groupBy(b.alias("bucket"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def sorted_axis_values(df: DataFrame, column: str) -> DataFrame:
    """R-13: distinct values of a string column in numeric order (a distributed range sort,
    no single-partition window)."""
    d = df.select(F.col(column).cast("string").alias("value")).distinct()
    return d.select("value", F.col("value").cast("double").alias("numeric")).orderBy("numeric", "value")


def dataset_difference(a: DataFrame, b: DataFrame, key: str = "dimx", columns=None) -> DataFrame:
    """R-14: rows only in one side and rows whose values differ, in one full outer join."""
    cols = columns or [c for c in a.columns if c != key and c in b.columns]
    j = a.select(key, F.lit(True).alias("__in_a"), *[F.col(c).alias(f"a__{c}") for c in cols]).join(
        b.select(key, F.lit(True).alias("__in_b"), *[F.col(c).alias(f"b__{c}") for c in cols]), key, "full")
    both = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    differ = F.lit(False)
    for c in cols:
        differ = differ | ~F.col(f"a__{c}").eqNullSafe(F.col(f"b__{c}"))
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                 F.count_if(F.col("__in_b").isNull()).cast("bigint").alias("only_left"),
                 F.count_if(F.col("__in_a").isNull()).cast("bigint").alias("only_right"),
                 F.count_if(both & differ).cast("bigint").alias("differing"))


def grid_summary(df: DataFrame, by: list[str], metrics: list[str], decimals: int | None = None) -> DataFrame:
    """R-11: per hyper-parameter cell, the number of members and mean / sample std of each metric (``<metric>``
    and ``<metric>_std``); rows whose metrics are all missing are dropped first."""
    from ..functions.numeric import exact_mean
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        mean = F.avg(m) if decimals is None else exact_mean(F.col(m), decimals)
        aggs += [mean.alias(m), F.stddev_samp(m).alias(f"{m}_std")]
    return _measured(df, metrics).groupBy(*by).agg(*aggs)


def _measured(df: DataFrame, metrics: list[str]) -> DataFrame:
    from functools import reduce as _reduce
    return df.filter(_reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in metrics]))


def grid_members(df: DataFrame, by: list[str], metrics: list[str], key: str = "id", decimals: int | None = None) -> DataFrame:
    """R-11 with the members as rows: each id beside its cell's summary (a cell may hold any number of them)."""
    cells = grid_summary(df, by, metrics, decimals)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return _measured(df, metrics).select(F.col(key), *[F.col(c).alias(f"__{c}") for c in by]).join(cells, on).drop(*[f"__{c}" for c in by])


def formatted_summary(df: DataFrame, metrics: list[str], digits: int = 3) -> DataFrame:
    """R-12: ``mean +- std`` labels with fixed decimals."""
    return df.select("*", *[F.concat(F.format_number(F.col(m), digits), F.lit(" +- "),
                                     F.format_number(F.col(f"{m}_std"), digits)).alias(f"{m}_label")
                            for m in metrics])


def compare_with_without(a: DataFrame, b: DataFrame, key: str = "dimx", suffixes=("_with", "_without")) -> DataFrame:
    """R-15: two score tables side by side on the id, suffixed column names."""
    ca = [c for c in a.columns if c != key]
    cb = [c for c in b.columns if c != key]
    return a.select(key, *[F.col(c).alias(c + suffixes[0]) for c in ca]).join(
        b.select(key, *[F.col(c).alias(c + suffixes[1]) for c in cb]), key, "full")
