"""Operators on one-dimensional slices of the scan grid (D-05, G-14, G-15, I-19).

A *slice* is every point sharing all features but one (the sliced dimension,
``At`` in the reference).  No operator gathers a slice, however long it is or however
many points share one of its places: points of one place are reduced by an
aggregate, windows that look a few places ahead run on segments of a slice that
overlap by as much as they look, and values carried along a slice pass from one
range of it to the next as one row each.

The axis of the sliced dimension is a table (its distinct values with their places);
it is broadcast where it is small and joined otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import cut_lineage
from .rank import global_rank

#: Axis values that are broadcast, places of a segment, output columns of a wide table.
AXIS_BROADCAST, SEGMENT, WIDE_COLUMNS = 100_000, 4_096, 5_000

# fixed values: the breakdown target of each mode
BREAKDOWN_TARGET = {"ITG": "efiITG_GB", "TEM": "efeTEM_GB", "ETG": "efeETG_GB"}


def axis_positions(df: DataFrame, dim: str) -> tuple[DataFrame, int]:
    """Distinct grid values of ``dim`` with their 0-based place ``__pos``, and how many there are."""
    axis = cut_lineage(df.select(dim).where(F.col(dim).isNotNull()).distinct())
    return global_rank(axis, [dim], dim, "__pos").select(dim, F.col("__pos").cast("long").alias("__pos")), axis.count()


def join_positions(df: DataFrame, dim: str, out: str = "__pos") -> tuple[DataFrame, int]:
    """``df`` with the place of its ``dim`` value on the axis (missing for a missing value), and the axis length."""
    pos, n = axis_positions(df, dim)
    pos = pos.withColumnRenamed("__pos", out)
    return df.join(F.broadcast(pos) if n <= AXIS_BROADCAST else pos, dim, "left"), n


def values_at(df: DataFrame, at: str, axis: DataFrame, n: int, dim: str) -> DataFrame:
    """``df`` with ``dim``, the axis value at the 0-based place in the column ``at`` (``axis`` and ``n`` from
    :func:`axis_positions`): the inverse of :func:`join_positions`.  Places off the axis have a missing value."""
    axis = axis.select(F.col(dim).alias(dim), F.col("__pos").alias(at))
    return df.join(F.broadcast(axis) if n <= AXIS_BROADCAST else axis, at, "left")


def product_grid(df: DataFrame, dims) -> DataFrame:
    """I-17: every combination of the values that ``dims`` take in ``df``, in no order.

    The cells are numbered by ``range``; a cell's place on each axis follows by division, its values by one join an
    axis (no cross join, and no axis on the driver).  A dim without any value leaves no cell.
    """
    axes = [(d, *axis_positions(df, d)) for d in dims]
    cells, after = 1, []
    for _, _, n in reversed(axes):
        after.append(cells)
        cells *= n
    out = df.sparkSession.range(cells).withColumnRenamed("id", "__cell")
    out = out.select(*[F.expr(f"pmod(__cell div {max(k, 1)}, {max(n, 1)})").alias(f"__at_{d}")
                       for (d, _, n), k in zip(axes, reversed(after))])
    for d, axis, n in axes:
        out = values_at(out, f"__at_{d}", axis, n, d)
    return out.select(*dims)


def breakdown_cuts(df: DataFrame, slice_cols, dim: str = "At", modes=("ITG", "TEM", "ETG"), patience: int = 6,
                   key: str = "dimx", segment: int | None = None) -> tuple[DataFrame, DataFrame]:
    """D-05 core: the place points of the slices (``slice_cols``, ``__pos`` and the lowest id ``key``) and, per slice, the
    place ``__cut_<mode>`` of the first breakdown.

    On the grid of all ``dim`` values, with 0 treated as missing (``w``): position i is
    sick iff ``w_i`` is present, at least one grid position follows, every one of the
    next ``patience`` grid positions (fewer at the grid end) holds a present ``w`` and
    all of them are below ``w_i``.  Duplicate points of a slice position are reduced to the
    lowest id first.  Segments of a slice take the next ``patience`` places along, so that
    each place sees what follows it inside one segment.
    """
    segment = segment or SEGMENT
    modes = [m for m in modes if BREAKDOWN_TARGET[m] in df.columns]
    placed, n_axis = join_positions(df.select(key, *slice_cols, dim, *{BREAKDOWN_TARGET[m] for m in modes}), dim)
    # a number an aggregate, so that they are hashed: a struct of them would be sorted
    first = [F.min_by(F.when(F.col(BREAKDOWN_TARGET[m]) != 0, F.col(BREAKDOWN_TARGET[m])), key).alias(f"__w_{m}") for m in modes]
    points = cut_lineage(placed.filter(F.col("__pos").isNotNull()).groupBy(*slice_cols, "__pos").agg(F.min(key).alias(key), *first))
    gmax, own = n_axis - 1, F.floor(F.col("__pos") / segment)
    seen_by = F.sequence(F.greatest(F.floor((F.col("__pos") - patience) / segment), F.lit(0)), own)
    spread = points.select("*", F.explode(seen_by).alias("__seg"))
    ahead = Window.partitionBy(*slice_cols, "__seg").orderBy("__pos").rangeBetween(1, patience)
    expected = F.least(F.lit(patience), F.lit(gmax) - F.col("__pos"))
    sick = {f"__sick_{m}": F.col(f"__w_{m}").isNotNull() & (F.col("__pos") < gmax) & (F.count(f"__w_{m}").over(ahead) == expected)
            & (F.max(f"__w_{m}").over(ahead) < F.col(f"__w_{m}")) for m in modes}
    cuts = spread.withColumns(sick).filter(F.col("__seg") == own).groupBy(*slice_cols) \
        .agg(*[F.min(F.when(F.col(f"__sick_{m}"), F.col("__pos"))).alias(f"__cut_{m}") for m in modes])
    return points.select(*slice_cols, "__pos", key), cuts


def breakdown_drop_flags(df: DataFrame, slice_cols, dim: str = "At", modes=("ITG", "TEM", "ETG"),
                         patience: int = 6, key: str = "dimx", segment: int | None = None) -> DataFrame:
    """D-05: ``__drop_<mode>`` per row, true for the place points behind the first breakdown of their slice (further
    points of a place are never flagged)."""
    points, cuts = breakdown_cuts(df, slice_cols, dim, modes, patience, key, segment)
    found = [c.removeprefix("__cut_") for c in cuts.columns if c.startswith("__cut_")]
    broken = cuts.filter(reduce(lambda a, b: a | b, [F.col(f"__cut_{m}").isNotNull() for m in found], F.lit(False)))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in slice_cols]
    behind = points.join(broken.select(*[F.col(c).alias(f"__of_{c}") for c in slice_cols], *[f"__cut_{m}" for m in found]), same) \
        .select(key, *[F.coalesce(F.col("__pos") > F.col(f"__cut_{m}"), F.lit(False)).alias(f"__drop_{m}") for m in found]) \
        .filter(reduce(lambda a, b: a | b, [F.col(f"__drop_{m}") for m in found], F.lit(False)))
    behind = cut_lineage(behind)                # found once, and broadcast where they are few: then no row of df is moved
    flags = {f"__drop_{m}": F.coalesce(F.col(f"__drop_{m}"), F.lit(False)) for m in found}
    return df.join(behind, key, "left").select(*df.columns, *[c.alias(n) for n, c in flags.items()])


def breakdown_mask(df: DataFrame, slice_cols, dim: str = "At", modes=("ITG", "TEM", "ETG"),
                   patience: int = 6, key: str = "dimx") -> DataFrame:
    """D-05: null the columns of each mode on the points after its breakdown (documented
    behaviour: the bad points are removed, the good ones kept)."""
    d = breakdown_drop_flags(df, slice_cols, dim, modes, patience, key)
    repl = {}
    for m in modes:
        if f"__drop_{m}" not in d.columns:
            continue
        for c in df.columns:
            if N.is_mode_scale(c, m):
                gate = ~F.col(f"__drop_{m}")
                repl[c] = F.when(gate, repl.get(c, F.col(c)))
    out = d.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in df.columns])
    return out


def collect_slices(df: DataFrame, slice_cols, dim: str, value: str, key: str = "dimx") -> DataFrame:
    """G-14: one row per slice with the sorted ``(dim, value)`` pairs (one per grid position,
    duplicates reduced to the lowest id, so an array holds at most the axis length)."""
    one = df.groupBy(*slice_cols, dim).agg(F.min_by(value, key).alias("v"))
    return one.groupBy(*slice_cols).agg(F.sort_array(F.collect_list(F.struct(F.col(dim).alias("x"), "v"))).alias("points"))


def wide_slices(df: DataFrame, slice_cols, dim: str, value: str, key: str = "dimx") -> DataFrame:
    """G-15: one row per slice, one column per grid value (``first`` of the lowest id); for at most ``WIDE_COLUMNS``
    grid values, beyond which :func:`slice_maps` says the same in one column."""
    values = [r[0] for r in df.select(dim).where(F.col(dim).isNotNull()).distinct().limit(WIDE_COLUMNS + 1).collect()]
    if len(values) > WIDE_COLUMNS:
        raise ValueError(f"{dim} has over {WIDE_COLUMNS} distinct values; use slice_maps")
    return df.groupBy(*slice_cols).pivot(dim, sorted(values)).agg(F.min_by(value, key))


def slice_maps(df: DataFrame, slice_cols, dim: str, value: str, key: str = "dimx") -> DataFrame:
    """G-15 for axes of any length: one row per slice with ``values``, a map from grid value to value."""
    one = df.where(F.col(dim).isNotNull()).groupBy(*slice_cols, dim).agg(F.min_by(value, key).alias("__v"))
    return one.groupBy(*slice_cols).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(dim, "__v")))).alias("values"))


def relative_to_reference(df: DataFrame, group_cols, order_cols, level_col: str, value: str, ref_value: float,
                          out: str = "relative") -> DataFrame:
    """I-19: divide by the value at the reference level, back-filled down the order.

    For each row the reference is the first row at or after it (in ``order_cols``,
    which end with a unique id) having ``level_col == ref_value`` in its group and a value there.

    A segmented scan: rows are range-exchanged by group and order, so a long group is many ranges; each range answers
    from its own rows and passes on its first reference per group to the ranges before it.
    """
    key = order_cols[-1]
    order = [F.col(c).asc_nulls_first() for c in (*group_cols, *order_cols)]
    narrow = df.select(*dict.fromkeys([*group_cols, *order_cols]), F.col(value).alias("__value"),
                       F.when(F.col(level_col) == ref_value, F.col(value)).alias("__ref"))
    placed = cut_lineage(narrow.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    at = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order_cols])
    firsts = placed.groupBy(*group_cols, "__range").agg(F.min_by("__ref", F.when(F.col("__ref").isNotNull(), at)).alias("__first"))
    later = Window.partitionBy(*group_cols).orderBy("__range").rowsBetween(1, Window.unboundedFollowing)      # one row per range of a group
    carried = firsts.select(*[F.col(c).alias(f"__of_{c}") for c in group_cols], F.col("__range").alias("__at"),
                            F.first("__first", ignorenulls=True).over(later).alias("__carried"))
    inside = Window.partitionBy(*group_cols, "__range").orderBy(*[F.col(c).asc_nulls_first() for c in order_cols]) \
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = placed.withColumn("__own", F.first("__ref", ignorenulls=True).over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group_cols] + [F.col("__range") == F.col("__at")]
    found = own.join(carried, same).select(F.col(key).alias("__id"), F.try_divide("__value", F.coalesce("__own", "__carried")).alias(out))
    return df.join(found, F.col(key) == F.col("__id"), "left").select(*[c for c in df.columns if c != out], out)
