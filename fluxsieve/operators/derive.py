"""Target and feature derivation (2.E).

New columns are added in one ``select`` (never a loop of ``withColumn``), so a
chain of ~20 ratio targets stays one projection in one codegen stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.numeric import div_or_zero, ieee_div

# fixed values: ratio targets of the ratio networks
DIV_NAMES_BASE = [
    "efeITG_GB_div_efiITG_GB",
    "pfeITG_GB_div_efiITG_GB",
    "efiTEM_GB_div_efeTEM_GB",
    "pfeTEM_GB_div_efeTEM_GB",
]
DIV_NAMES_DV = [
    "dfeITG_GB_div_efiITG_GB",
    "dfiITG_GB_div_efiITG_GB",
    "vceITG_GB_div_efiITG_GB",
    "vciITG_GB_div_efiITG_GB",
    "vteITG_GB_div_efiITG_GB",
    "vtiITG_GB_div_efiITG_GB",
    "dfeTEM_GB_div_efeTEM_GB",
    "dfiTEM_GB_div_efeTEM_GB",
    "vceTEM_GB_div_efeTEM_GB",
    "vciTEM_GB_div_efeTEM_GB",
    "vteTEM_GB_div_efeTEM_GB",
    "vtiTEM_GB_div_efeTEM_GB",
]
DIV_NAMES = DIV_NAMES_BASE + DIV_NAMES_DV


def _need(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise KeyError(name)
    return F.col(name)


def add_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    keep = [F.col(c) for c in df.columns if c not in new]
    return df.select(*keep, *[v.alias(k) for k, v in new.items()])


def divsum(df: DataFrame, divnames=None, skip_missing: bool = False) -> DataFrame:
    """E-01: ``A_div_B = A / B`` with IEEE results (x/0 = +-inf, 0/0 missing)."""
    new = {}
    for name in (DIV_NAMES if divnames is None else divnames):
        one, two = name.split("_div_")
        if skip_missing and (one not in df.columns or two not in df.columns):
            continue
        new[name] = ieee_div(_need(df, one), _need(df, two))
    return add_columns(df, new)


# fixed value: how the legacy job splits a flux name
_LEGACY = re.compile(r"(.)(|ITG|ETG|TEM)(_GB|SI|cm)")


def divsum_legacy(df: DataFrame) -> DataFrame:
    """E-02: sums and ratios of ion / electron heat fluxes and of the electron particle flux."""
    new = {}
    for col in list(df.columns):
        pieces = _LEGACY.split(col)
        if len(pieces) != 5:
            continue
        transp, species, rest = pieces[0], pieces[1], "".join(pieces[2:])
        if transp in N.HEAT and species == "i":
            other = transp + "e" + rest
            a, b = _need(df, col), _need(df, other)
            new[f"{col}_plus_{other}"] = a + b
            new[f"{col}_div_{other}"] = ieee_div(a, b)
            new[f"{other}_div_{col}"] = ieee_div(b, a)
        elif transp == "pf" and species == "e":
            i_heat, e_heat = "efi" + rest, "efe" + rest
            a, b, c = _need(df, col), _need(df, i_heat), _need(df, e_heat)
            new[f"{col}_plus_{i_heat}_plus_{e_heat}"] = a + b + c
            new[f"{col}_div_{i_heat}"] = ieee_div(a, b)
            new[f"{col}_div_{e_heat}"] = ieee_div(a, c)
    return add_columns(df, new)


def expression_column(df: DataFrame, target: str, evaluation: str = "precedence") -> Column:
    """E-03: build the column named by a combined target, e.g. ``a_GB_plus_b_GB_div_c_GB``.

    ``precedence`` (the reference's effective behaviour) divides before adding;
    ``left_to_right`` folds the operations in written order.
    """
    parts = N.split_parts(target)
    operands = [_need(df, p) for p in N.extract_part_names(parts)]
    ops = N.extract_operations(parts)
    for op in ops:
        if op not in ("_div_", "_plus_"):
            raise NotImplementedError(f"operation {op!r} in {target!r}")
    if evaluation == "left_to_right":
        acc = operands[0]
        for op, x in zip(ops, operands[1:]):
            acc = ieee_div(acc, x) if op == "_div_" else acc + x
        return acc
    terms, cur = [], operands[0]
    for op, x in zip(ops, operands[1:]):
        if op == "_div_":
            cur = ieee_div(cur, x)
        else:
            terms.append(cur)
            cur = x
    terms.append(cur)
    acc = terms[0]
    for t in terms[1:]:
        acc = acc + t
    return acc


def combine_vars(df: DataFrame, target: str, new_name: str | None = None, evaluation: str = "precedence") -> DataFrame:
    return add_columns(df, {new_name or target: expression_column(df, target, evaluation)})


def rotdiv(df: DataFrame, features, rotvar: str = "Machtor", rot_over_norot: bool = True,
           columns=None) -> DataFrame:
    """E-04: each transport column relative to the same point without rotation.

    The rot=0 value is found with a window over the other features (one shuffle, no
    self join); the feature tuple must identify a point (reduce duplicates first).
    ``True``: ``c / c(rot=0)`` named ``c_div_c_rot0``; ``False``: inverse, ``c_rot0_div_c``;
    0 wherever the denominator is 0, missing where there is no rot=0 point.
    """
    others = [f for f in features if f != rotvar]
    cols = columns if columns is not None else N.columns_where(df.columns, N.is_transport)
    w = Window.partitionBy(*others)
    new = {}
    for c in cols:
        base = F.max(F.when(F.col(rotvar) == 0, F.col(c))).over(w)
        if rot_over_norot:
            new[f"{c}_div_{c}_rot0"] = div_or_zero(F.col(c), base)
        else:
            new[f"{c}_rot0_div_{c}"] = div_or_zero(base, F.col(c))
    return add_columns(df, new)


def select_family(df: DataFrame, predicate, keep=("dimx",)) -> DataFrame:
    """E-05: keep the key plus every column the catalogue predicate accepts."""
    return df.select(*[c for c in keep if c in df.columns],
                     *[c for c in df.columns if c not in keep and predicate(c)])


def order_features(df: DataFrame, features, drop=("nions",)) -> DataFrame:
    """E-06: drop leftover dims, put features in network order."""
    rest = [c for c in df.columns if c not in features and c not in drop]
    return df.select(*features, *rest)


def convert_nustar(df: DataFrame) -> DataFrame:
    """B-27: ``logNustar = log10(Nustar)``; Nustar dropped (missing for values <= 0)."""
    if "Nustar" not in df.columns:
        return df
    cols = [F.log10(F.col(c)).alias("logNustar") if c == "Nustar" else F.col(c) for c in df.columns]
    return df.select(*cols)
