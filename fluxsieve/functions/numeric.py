"""Null / NaN / division policy shared by every operator.

Inside the engine a missing value is SQL NULL, never NaN: NaN sorts above every
number in Spark, so ``x >= 0`` would keep it.  Sources convert NaN to NULL once.
Spark 4 runs ANSI mode, where ``x / 0`` raises; the helpers below spell out the
division result each operator needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

INF = float("inf")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column, in one projection."""
    cols = [F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def ieee_div(a: Column, b: Column) -> Column:
    """``a / b`` with IEEE results for a zero divisor: +-inf, and NULL for 0/0 (NaN)."""
    return (F.when(b != 0, a / b)
            .when((b == 0) & (a > 0), F.lit(INF))
            .when((b == 0) & (a < 0), F.lit(-INF)))


def safe_div(a: Column, b: Column) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(a, b)


def div_or_zero(a: Column, b: Column) -> Column:
    """0 where the divisor is 0 (rotation ratios)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def isclose(a: Column, v, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """numpy ``isclose`` (asymmetric: tolerance scales with the reference value ``v``)."""
    v = v if isinstance(v, Column) else F.lit(float(v))
    return F.abs(a - v) <= F.lit(atol) + F.lit(rtol) * F.abs(v)


def fuzzy_is_in(a: Column, values, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """C-23: close to any of ``values``."""
    return reduce(lambda x, y: x | y, [isclose(a, v, rtol, atol) for v in values], F.lit(False))


def all_of(preds) -> Column:
    preds = list(preds)
    return reduce(lambda x, y: x & y, preds) if preds else F.lit(True)


def any_of(preds) -> Column:
    preds = list(preds)
    return reduce(lambda x, y: x | y, preds) if preds else F.lit(False)


def true_or_false(c: Column) -> Column:
    """Collapse SQL three-valued logic to pandas' two: NULL counts as False."""
    return F.coalesce(c, F.lit(False))


def exact_sum(c: Column, decimals: int) -> Column:
    """Sum in DECIMAL: exact, so the result does not depend on partitioning or task order
    (for data with at most ``decimals`` decimal digits)."""
    return F.sum(c.cast(f"decimal(38,{decimals})"))


def exact_mean(c: Column, decimals: int) -> Column:
    """Order-independent mean: exact decimal sum / count."""
    return exact_sum(c, decimals).cast("double") / F.count(c)


def exact_std(c: Column, decimals: int, ddof: int = 1) -> Column:
    """Standard deviation from exact decimal sums of x and x^2 (order-independent)."""
    x = c.cast(f"decimal(18,{decimals})")
    s1 = F.sum(x).cast("double")
    s2 = F.sum(x * x).cast("double")
    n = F.count(c)
    var = (s2 - s1 * s1 / n) / (n - F.lit(ddof))
    return F.sqrt(F.greatest(var, F.lit(0.0)))
