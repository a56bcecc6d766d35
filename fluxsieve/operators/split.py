"""Splits, sampling and dimension reduction (2.G)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import all_of, isclose
from .rank import hash_key
from .select import before, hash_order, keys_at, quantiles


def constant_slice(df: DataFrame, values: dict[str, float], atol: float = 1e-5, rtol: float = 1e-3,
                   log_alias: dict[str, str] | None = None) -> DataFrame:
    """G-01 / G-02: keep points where each named feature is close to a value.

    ``log_alias`` maps a feature to its log10 column (``Nustar -> logNustar``), used when
    only the log form is present.  Features absent in both forms are skipped; none
    present at all is an error.
    """
    conds = []
    for name, v in values.items():
        if name in df.columns:
            conds.append(isclose(F.col(name), v, rtol=rtol, atol=atol))
        elif log_alias and log_alias.get(name) in df.columns:
            conds.append(isclose(F.col(log_alias[name]), math.log10(v), rtol=rtol, atol=atol))
    if not conds:
        raise KeyError(f"none of {list(values)} present")
    return df.filter(all_of(conds))


def filter_zeff_nustar(df: DataFrame, Zeff: float = 1.0, Nustar: float = 1e-3) -> DataFrame:
    """G-01: 9-D to 7-D."""
    return constant_slice(df, {"Zeff": Zeff, "Nustar": Nustar}, log_alias={"Nustar": "logNustar"})


def filter_ate_an_x(df: DataFrame, Ate: float = 6.5, An: float = 2.0, x: float = 0.45) -> DataFrame:
    """G-02: 7-D to 4-D."""
    return constant_slice(df, {"Ate": Ate, "An": An, "x": x})


def nested_split(inp: DataFrame, levels: list[dict[str, float]], key: str = "dimx"):
    """G-03: successive constant slices; each level drops its sliced features.

    Returns a list of ``(ids, features, constants)`` per level, where ``constants`` is a
    ``(name, value)`` DataFrame of the sliced values (the slice value, as the
    reference records the first row's value, which is that value up to tolerance).
    """
    spark = inp.sparkSession
    out, cur, consts = [], inp, []
    for lvl in levels:
        cur = constant_slice(cur, lvl).drop(*[c for c in lvl if c in cur.columns])
        consts = consts + [(k, float(v)) for k, v in lvl.items()]
        out.append((cur.select(key), cur, spark.createDataFrame(consts, "name string, value double")))
    return out


def test_flag(df: DataFrame, frac: float = 0.1, seed=42, key: str = "dimx") -> DataFrame:
    """G-05: exactly ``floor(frac * n)`` rows flagged ``is_test``, the first ones in md5 order: one comparison with the
    key at that rank."""
    order = hash_order(seed, key)
    cut, = keys_at(df.select(key), [(order, lambda n: math.floor(frac * n))])
    return df.withColumn("is_test", F.lit(True) if cut is None else before(order, cut))


def train_val_test(df: DataFrame, validation_fraction: float, test_fraction: float, seed=42,
                   key: str = "dimx") -> DataFrame:
    """G-07: ``set`` in test / validation / train with exact counts (test first in md5 order)."""
    order = hash_order(seed, key)

    def rank(*fractions):
        return lambda n: sum(math.floor(f * n) for f in fractions)

    cuts = keys_at(df.select(key), [(order, rank(test_fraction)), (order, rank(test_fraction, validation_fraction))])
    first, second = (F.lit(True) if c is None else before(order, c) for c in cuts)
    return df.withColumn("set", F.when(first, "test").when(second, "validation").otherwise("train"))


def minibatch(df: DataFrame, minibatches: int, epoch: int, seed=42, key: str = "dimx") -> Column:
    """G-08: minibatch index of a row for one epoch (reshuffled per epoch)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(minibatches))


def shuffled(df: DataFrame, seed=42, key: str = "dimx") -> DataFrame:
    """G-09: a reproducible random permutation (distributed range sort on the hash)."""
    return df.orderBy(hash_key(seed, key))


def head_sample(df: DataFrame, n: int = 40000, key: str = "dimx") -> DataFrame:
    """G-10: the first ``n`` rows by id (a sampling operator: the limit is the feature)."""
    return df.orderBy(key).limit(n)


def join_features_targets(inp: DataFrame, target: DataFrame, key: str = "dimx") -> DataFrame:
    """G-11: inner join on the id."""
    return inp.join(target, key, "inner")


def cast_float(df: DataFrame, dtype: str = "float", skip=("dimx",)) -> DataFrame:
    """G-12: cast every numeric column (but the id) for training."""
    num = {"double", "float", "int", "bigint", "smallint"}
    return df.select(*[F.col(c).cast(dtype).alias(c) if (t in num and c not in skip) else F.col(c)
                       for c, t in df.dtypes])


def outlier_trim_rank(df: DataFrame, targets: list[str], above: float = 0.999, below: float = 0.001,
                      key: str = "dimx") -> DataFrame:
    """C-20: sort by all targets lexicographically; keep ranks in ``[floor(n*below), floor(n*above))``."""
    order = [*targets, key]
    low, high = keys_at(df.select(*order), [(order, lambda n: math.floor(n * below)), (order, lambda n: math.floor(n * above))])
    if low is None:
        return df.limit(0)
    kept = ~before(order, low)
    return df.filter(kept if high is None else kept & before(order, high))


def outlier_trim_quantile(df: DataFrame, columns: list[str], above: float = 0.999, below: float = 0.001,
                          exact: bool = True) -> DataFrame:
    """C-21: null values >= q(above) of each column, then values <= q(below) of what is left of it; then drop nulls.

    Exact quantiles are the values at their ranks, of all columns at once; otherwise they come from a mergeable sketch.
    """
    def cut(d, p):
        if exact:
            return {c: q[0] for c, q in quantiles(d.select(*columns), {c: [p] for c in columns}).items()}
        return d.agg(*[F.percentile_approx(c, p).alias(c) for c in columns]).first().asDict()

    top = cut(df, above)
    masked = df.withColumns({c: F.when(F.col(c) < F.lit(top[c]), F.col(c)) for c in columns})
    low = cut(masked, below)
    return masked.withColumns({c: F.when(F.col(c) > F.lit(low[c]), F.col(c)) for c in columns}).dropna("any", subset=list(columns))


def slice_fraction(df: DataFrame, slice_cols: list[str], fraction: float, seed=42) -> DataFrame:
    """G-16: keep a reproducible fraction of whole slices (hash threshold on the slice key)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in slice_cols]))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(float(16 ** 8))
    return df.filter(u < F.lit(fraction))


def prep_training_set(inp: DataFrame, targets: DataFrame, target_cols: list[str], above: float = 0.999,
                      below: float = 0.001, dtype: str = "float", key: str = "dimx", by_rank: bool = True) -> DataFrame:
    """G-13: drop leftover dims, trim outliers on the targets, drop missing values, inner-join
    features to targets and cast for training."""
    from .derive import convert_nustar
    inp = convert_nustar(inp.drop(*[c for c in ("nions",) if c in inp.columns]))
    t = targets.select(key, *target_cols)
    t = outlier_trim_rank(t, target_cols, above, below, key) if by_rank else \
        outlier_trim_quantile(t, target_cols, above, below)
    t = t.dropna("any")
    return cast_float(join_features_targets(inp.dropna("any"), t, key), dtype, skip=(key,))
