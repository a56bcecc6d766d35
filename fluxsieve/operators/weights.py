"""Instance weights from instability thresholds (H-10 .. H-13).

The threshold of a slice (all features fixed but the driving gradient) is the
smallest driving-gradient value at which the flux is non-zero (H-13; the original
loads thresholds computed elsewhere, so this definition is our own and
documented as such).  Expanding a slice's threshold to every point of the slice
(H-10) is a window over the slice key, i.e. one shuffle and no join of points
against grid values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

# fixed values: defaults of the weights job
WIDTH = 7.0
BASE_TOP_RATIO = 10.0
THRESH_CLIP = (-2.0, 16.0)
LEADING = {"ITG": "efiITG_GB", "TEM": "efeTEM_GB", "ETG": "efeETG_GB"}


def slice_threshold(special: str, flux: str) -> Column:
    """H-13 per row: the slice threshold, given a window partitioned by the slice key."""
    return F.min(F.when(F.col(flux) > 0, F.col(special)))


def thresholds(df: DataFrame, slice_cols, special: str, flux: str) -> DataFrame:
    """H-13 as a table: one row per slice (slices without instability are left out, as
    null thresholds are dropped before expansion)."""
    return df.groupBy(*slice_cols).agg(slice_threshold(special, flux).alias("thresh")).filter(
        F.col("thresh").isNotNull())


def expand_thresholds(points: DataFrame, thresh: DataFrame, slice_cols) -> DataFrame:
    """H-10: the threshold of its slice for every wanted point (missing -> null)."""
    return points.join(thresh, list(slice_cols), "left")


def instance_weight(x: Column, thr: Column, width: float = WIDTH, ratio: float = BASE_TOP_RATIO) -> Column:
    """H-11: ``(r-1) exp(-(x-thr)^2 / (2 w^2)) + 1`` with thr clipped to [-2, 16]; 1 when missing; float32."""
    t = F.least(F.greatest(thr, F.lit(THRESH_CLIP[0])), F.lit(THRESH_CLIP[1]))
    w = F.lit(ratio - 1.0) * F.exp(-((x - t) * (x - t)) / F.lit(2.0 * width * width)) + F.lit(1.0)
    return F.coalesce(w, F.lit(1.0)).cast("float")


def weights_job(df: DataFrame, slices: dict[str, list[str]], key: str = "dimx", width: float = WIDTH,
                ratio: float = BASE_TOP_RATIO) -> DataFrame:
    """H-12: ``<mode>weights`` per point for each mode, special input from F-19 of the mode's
    leading flux; ``slices[mode]`` are the features that define a slice for that mode."""
    cols, out = [F.col(key)], df
    for mode, slice_cols in slices.items():
        flux = LEADING[mode]
        special = N.determine_special_input(flux)[0]
        # one row per slice, aggregated before the shuffle; a slice key may be missing
        thr = df.groupBy(*slice_cols).agg(slice_threshold(special, flux).alias(f"__t_{mode}")) \
            .select(*[F.col(c).alias(f"__{mode}_{c}") for c in slice_cols], f"__t_{mode}")
        on = [F.col(c).eqNullSafe(F.col(f"__{mode}_{c}")) for c in slice_cols]
        out = out.join(thr, on, "left").drop(*[f"__{mode}_{c}" for c in slice_cols])
        cols.append(instance_weight(F.col(special), F.col(f"__t_{mode}"), width, ratio).alias(f"{mode}weights"))
    return out.select(*cols)
