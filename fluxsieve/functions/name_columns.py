"""The column-name grammar as native Spark expressions.

:func:`name_catalog` turns a DataFrame with a string column of names into the
catalogue (one column per predicate).  Everything is ``regexp_extract_all`` /
``split`` / higher-order array functions, so it runs in codegen on executors.
Use it over *distinct* names and join the result back (the number of distinct
names is bounded by the schema width, which makes the broadcast safe).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import (COEFF_GROUPS, COEFF_PATTERN, FLUX, GROWTH, HEAT, LEADING_RATIOS, MOMENTUM,
                    PARTICLE, PARTICLE_DIFFUSION, ROTATION, TRANSPORT)

_ANCHORED = "^" + COEFF_GROUPS + "$"


def _in(c: Column, values) -> Column:
    return c.isin(*values)


def matches(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("(" + COEFF_PATTERN + ")"), 1)


def valid(name: Column) -> Column:
    pieces = F.split(name, COEFF_PATTERN, -1)
    return (F.size(matches(name)) >= 1) & (F.element_at(pieces, 1) == "") & (F.element_at(pieces, -1) == "")


def operations(name: Column) -> Column:
    pieces = F.split(name, COEFF_PATTERN, -1)
    return F.when(valid(name), F.slice(pieces, 2, F.size(pieces) - 2))


def parts(name: Column) -> Column:
    """Alternating part / operation array (F-01); NULL when the name does not split."""
    m = matches(name)
    ops = operations(name)
    return F.when(valid(name), F.transform(
        F.sequence(F.lit(1), 2 * F.size(m) - 1),
        lambda i: F.when(i % 2 == 1, F.element_at(m, ((i + 1) / 2).cast("int")))
        .otherwise(F.element_at(ops, (i / 2).cast("int")))))


def _field(p: Column, k: int) -> Column:
    return F.regexp_extract(p, _ANCHORED, k)


def _all_parts(name: Column, pred) -> Column:
    return valid(name) & F.forall(matches(name), pred)


def is_transport(name: Column) -> Column:
    return _all_parts(name, lambda p: _in(_field(p, 1), TRANSPORT))


def _family(name: Column, ids, how: str) -> Column:
    hit = lambda p: F.exists(F.array(*[F.lit(i) for i in ids]), lambda s: F.instr(p, s) > 0)
    agg = F.forall if how == "all" else F.exists
    return is_transport(name) & agg(matches(name), hit)


def is_mode_scale(name: Column, mode: str) -> Column:
    return _family(name, [mode.upper()], "all")


def catalog_columns(name: Column) -> dict[str, Column]:
    m = matches(name)
    single = F.when(valid(name) & (F.size(m) == 1), F.element_at(m, 1))
    transport = is_transport(name)
    sep = name.rlike("TEM|ITG|ETG")
    itg, tem, etg = (is_mode_scale(name, x) for x in ("ITG", "TEM", "ETG"))
    ion = transport & F.forall(m, lambda p: ~_in(_field(p, 3), ["", "ETG"]))
    is_flux = _all_parts(name, lambda p: _in(_field(p, 1), FLUX))
    is_pure = valid(name) & (F.size(m) == 1)
    leading_bad = (
        (name.contains("div") | name.contains("plus"))
        & F.when(name.contains("ITG"), ~_in(name, LEADING_RATIOS["ITG"]))
        .when(name.contains("TEM"), ~_in(name, LEADING_RATIOS["TEM"]))
        .otherwise(F.lit(False))
    )
    cols = {
        "parts": parts(name),
        "part_names": F.when(valid(name), m),
        "operations": operations(name),
        "transp": F.when(single.isNotNull(), _field(single, 1)),
        "species": F.when(single.isNotNull(), _field(single, 2)),
        "mode": F.when(single.isNotNull(), _field(single, 3)),
        "norm": F.when(single.isNotNull(), _field(single, 4)),
        "is_pure": is_pure,
        "is_flux": is_flux,
        "is_transport": transport,
        "is_pure_flux": is_pure & is_flux,
        "is_growth": _in(name, GROWTH),
        "contains_sep": sep,
        "is_full_transport": transport & ~sep,
        "is_pure_diffusion": _family(name, PARTICLE_DIFFUSION, "all"),
        "is_pure_heat": _family(name, HEAT, "all"),
        "is_pure_particle": _family(name, PARTICLE, "all"),
        "is_pure_rot": _family(name, ROTATION, "all"),
        "is_pure_momentum": _family(name, MOMENTUM, "all"),
        "is_partial_diffusion": _family(name, PARTICLE_DIFFUSION, "any"),
        "is_partial_heat": _family(name, HEAT, "any"),
        "is_partial_particle": _family(name, PARTICLE, "any"),
        "is_partial_rot": _family(name, ROTATION, "any"),
        "is_partial_momentum": _family(name, MOMENTUM, "any"),
        "is_ion_scale": ion,
        "is_electron_scale": etg,
        "is_multi_scale": transport & ~etg & ~ion,
        "mode_scale": F.when(itg, "ITG").when(tem, "TEM").when(etg, "ETG").otherwise("unknown"),
        "driving_gradients": F.when(etg | tem, F.array(F.lit("Ate"))).when(itg, F.array(F.lit("Ati")))
        .otherwise(F.array().cast("array<string>")),
        "is_leading": transport & (~sep | (~leading_bad & ~name.contains("pfi"))),
    }
    return cols


def name_catalog(df: DataFrame, name_col: str = "name") -> DataFrame:
    """F-01..F-21: one output column per catalogue function, computed in one projection."""
    name = F.col(name_col)
    cols = catalog_columns(name)
    return df.select("*", *[c.alias(k) for k, c in cols.items()])
