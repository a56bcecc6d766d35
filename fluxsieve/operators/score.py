"""Networks as batch operators (2.I).

Two execution paths for the same network definition:

* :func:`score` — ``mapInPandas`` over Arrow batches with the weights shipped once
  per executor as a broadcast variable; per batch it is one numpy matrix product
  per layer (the fast path for real networks such as 3 x 128 tanh);
* :func:`network_columns` — the network unrolled into native column expressions
  (JVM, whole-stage codegen); only sensible for tiny networks, and it is what
  makes scoring checkable in SQL.

Wrappers (committees, products, combinations, rotation rule, unit conversion)
are column expressions over already-scored columns.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import names as N

ACTIVATIONS = ("tanh", "relu", "none")


@dataclass
class Network:
    feature_names: list[str]
    target_names: list[str]
    weights: list[np.ndarray]            # (n_in, n_out) per layer
    biases: list[np.ndarray]
    activations: list[str]               # hidden activations + output activation
    prescale_factor: dict[str, float]    # features and targets
    prescale_bias: dict[str, float]
    feature_min: dict[str, float] = field(default_factory=dict)
    feature_max: dict[str, float] = field(default_factory=dict)
    target_min: dict[str, float] = field(default_factory=dict)
    target_max: dict[str, float] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> "Network":
        acts = list(d["hidden_activation"]) + [d["output_activation"]]
        ws, bs = [], []
        for i in range(1, len(acts) + 1):
            w = d.get(f"layer{i}/weights/Variable:0")
            if w is None:
                break
            ws.append(np.asarray(w, dtype=np.float64))
            bs.append(np.asarray(d[f"layer{i}/biases/Variable:0"], dtype=np.float64))
        for a in acts:
            if a not in ACTIVATIONS:
                raise ValueError(f"unknown activation {a!r}")
        return cls(list(d["feature_names"]), list(d["target_names"]), ws, bs, acts[:len(ws)],
                   dict(d["prescale_factor"]), dict(d["prescale_bias"]), dict(d.get("feature_min", {})),
                   dict(d.get("feature_max", {})), dict(d.get("target_min", {})), dict(d.get("target_max", {})),
                   dict(d.get("_metadata", {})))

    @classmethod
    def from_json(cls, path: str) -> "Network":
        with open(path) as fh:
            return cls.from_dict(json.load(fh))

    def to_dict(self) -> dict:
        d = {"feature_names": self.feature_names, "target_names": self.target_names,
             "hidden_activation": self.activations[:-1], "output_activation": self.activations[-1],
             "prescale_factor": self.prescale_factor, "prescale_bias": self.prescale_bias,
             "feature_min": self.feature_min, "feature_max": self.feature_max,
             "target_min": self.target_min, "target_max": self.target_max, "_metadata": self.metadata}
        for i, (w, b) in enumerate(zip(self.weights, self.biases), 1):
            d[f"layer{i}/weights/Variable:0"] = w.tolist()
            d[f"layer{i}/biases/Variable:0"] = b.tolist()
        return d

    # ---- I-12 parts
    def l2_norm(self) -> float:
        return float(sum((w ** 2).sum() for w in self.weights) / 2.0)

    def l1_norm(self) -> float:
        return float(sum(np.abs(w).sum() for w in self.weights))


def make_network(features, targets, hidden=(3,), activation="tanh", seed=0, scale=0.5,
                 prescale_factor=None, prescale_bias=None, target_bounds=(-10.0, 50.0)) -> Network:
    """A deterministic network with given topology (weights from a seeded generator,
    rounded to 4 decimals so every engine sees the same numbers)."""
    rng = np.random.RandomState(seed)
    sizes = [len(features)] + list(hidden) + [len(targets)]
    ws = [np.round(rng.uniform(-scale, scale, (a, b)), 4) for a, b in zip(sizes[:-1], sizes[1:])]
    bs = [np.round(rng.uniform(-scale, scale, b), 4) for b in sizes[1:]]
    pf = {f: 0.1 for f in features}
    pf.update({t: 0.2 for t in targets})
    pb = {f: 0.0 for f in features}
    pb.update({t: -0.1 for t in targets})
    pf.update(prescale_factor or {})
    pb.update(prescale_bias or {})
    lo, hi = target_bounds
    return Network(list(features), list(targets), ws, bs, [activation] * len(hidden) + ["none"], pf, pb,
                   {f: -1e9 for f in features}, {f: 1e9 for f in features},
                   {t: lo for t in targets}, {t: hi for t in targets})


# ------------------------------------------------------------------ numpy path (mapInPandas)

def _act_np(a: str, x: np.ndarray) -> np.ndarray:
    if a == "tanh":
        return np.tanh(x)
    if a == "relu":
        return np.maximum(x, 0.0)
    return x


def forward_numpy(net: dict, X: np.ndarray) -> np.ndarray:
    """Prescale, dense layers, descale (``net`` is the broadcast array form)."""
    h = X * net["f_fac"] + net["f_bias"]
    for w, b, a in zip(net["W"], net["B"], net["A"]):
        h = _act_np(a, h @ w + b)
    return (h - net["t_bias"]) / net["t_fac"]


def _packed(net: Network) -> dict:
    return {"features": net.feature_names, "targets": net.target_names,
            "f_fac": np.array([net.prescale_factor[f] for f in net.feature_names]),
            "f_bias": np.array([net.prescale_bias[f] for f in net.feature_names]),
            "t_fac": np.array([net.prescale_factor[t] for t in net.target_names]),
            "t_bias": np.array([net.prescale_bias[t] for t in net.target_names]),
            "W": net.weights, "B": net.biases, "A": net.activations}


def _out_name(net_name: str, target: str, single: bool) -> str:
    return target if single else f"{net_name}__{target}"


def score(df: DataFrame, nets: dict[str, Network], keep=("dimx",), scale_length: float = 1.0,
          clip_low: bool = False, clip_high: bool = False, low_bound=None, high_bound=None,
          target_names_mask: dict[str, list[str]] | None = None) -> DataFrame:
    """I-01 / I-11: score one or many networks in one pass over Arrow batches.

    Output columns: ``keep`` + one column per (network, target); a single network
    names its columns by target (or by ``target_names_mask``, I-05).  Features are
    selected by name (I-04, safe mode only).  ``scale_length`` (I-02) divides every
    target not containing ``df``, ``chie`` or ``xaxis``.  Clipping (I-03) uses the
    given bounds or, when ``True`` without bounds, the network's own target range.
    """
    spark = df.sparkSession
    single = len(nets) == 1
    names = {}
    for n, net in nets.items():
        mask = (target_names_mask or {}).get(n)
        names[n] = mask if mask else [_out_name(n, t, single) for t in net.target_names]
    features = sorted({f for net in nets.values() for f in net.feature_names})
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise KeyError(f"features missing from input: {missing}")
    packed = {n: _packed(net) for n, net in nets.items()}
    bounds = {}
    for n, net in nets.items():
        lo = [(low_bound if low_bound is not None else net.target_min.get(t, -math.inf)) if clip_low else -math.inf
              for t in net.target_names]
        hi = [(high_bound if high_bound is not None else net.target_max.get(t, math.inf)) if clip_high else math.inf
              for t in net.target_names]
        scale = [scale_length if (scale_length != 1 and not any(p in t for p in ("df", "chie", "xaxis"))) else 1.0
                 for t in net.target_names]
        bounds[n] = (np.array(lo, dtype=float), np.array(hi, dtype=float), np.array(scale))
    bc = spark.sparkContext.broadcast({"nets": packed, "bounds": bounds, "names": names})
    keep = list(keep)
    out_schema = StructType([df.schema[c] for c in keep] +
                            [StructField(c, DoubleType()) for n in nets for c in names[n]])

    def run(batches):
        import pandas as pd
        val = bc.value
        for pdf in batches:
            cols = {c: pdf[c] for c in keep}
            for n, net in val["nets"].items():
                X = pdf[net["features"]].to_numpy(dtype=np.float64)
                Y = forward_numpy(net, X)
                lo, hi, sc = val["bounds"][n]
                Y = np.clip(Y / sc, lo, hi)
                for j, c in enumerate(val["names"][n]):
                    cols[c] = Y[:, j]
            yield pd.DataFrame(cols)

    return df.select(*dict.fromkeys(keep + features)).mapInPandas(run, out_schema)


# ------------------------------------------------------------------ native-expression path (tiny nets)

def _act_col(a: str, c: Column) -> Column:
    if a == "tanh":
        return F.tanh(c)
    if a == "relu":
        return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(0.0)))     # greatest() would skip a missing value
    return c


def network_columns(net: Network) -> dict[str, Column]:
    """The network as native column expressions, target -> Column (no clipping)."""
    h = [F.col(f) * F.lit(net.prescale_factor[f]) + F.lit(net.prescale_bias[f]) for f in net.feature_names]
    for w, b, a in zip(net.weights, net.biases, net.activations):
        h = [_act_col(a, reduce(lambda x, y: x + y, [h[i] * F.lit(float(w[i, j])) for i in range(len(h))])
                      + F.lit(float(b[j]))) for j in range(w.shape[1])]
    return {t: (h[j] - F.lit(net.prescale_bias[t])) / F.lit(net.prescale_factor[t])
            for j, t in enumerate(net.target_names)}


def network_sql(net: Network) -> dict[str, str]:
    """The network rendered as SQL text (oracle side)."""
    def act(a, s):
        return f"tanh({s})" if a == "tanh" else (f"(CASE WHEN {s} IS NOT NULL THEN greatest({s}, 0e0) END)" if a == "relu" else s)
    h = [f"({f} * {net.prescale_factor[f]!r} + {net.prescale_bias[f]!r})" for f in net.feature_names]
    for w, b, a in zip(net.weights, net.biases, net.activations):
        h = [act(a, "(" + " + ".join(f"{h[i]} * {float(w[i, j])!r}" for i in range(len(h))) + f" + {float(b[j])!r})")
             for j in range(w.shape[1])]
    return {t: f"(({h[j]} - {net.prescale_bias[t]!r}) / {net.prescale_factor[t]!r})"
            for j, t in enumerate(net.target_names)}


def clip(c: Column, low=None, high=None) -> Column:
    """I-03: real clipping (missing stays missing)."""
    if low is not None:
        c = F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(float(low))))
    if high is not None:
        c = F.when(c.isNull(), c).otherwise(F.least(c, F.lit(float(high))))
    return c


# ------------------------------------------------------------------ wrappers on scored columns

def committee(members: list[Column], low=None, high=None) -> tuple[Column, Column]:
    """I-09: mean of the (clipped) members and their population standard deviation."""
    ms = [clip(m, low, high) for m in members]
    n = float(len(ms))
    mean = reduce(lambda a, b: a + b, ms) / F.lit(n)
    var = reduce(lambda a, b: a + b, [(m - mean) * (m - mean) for m in ms]) / F.lit(n)
    return mean, F.sqrt(var)


def committee_product(x: Column, ex: Column, y: Column, ey: Column) -> tuple[Column, Column]:
    """I-10: product of two committee outputs with propagated error."""
    return x * y, F.sqrt((x * ey) * (x * ey) + (ex * y) * (ex * y))


_RECIPE = re.compile(r"^\s*nn(\d+)\s*([*/+-])\s*nn(\d+)\s*$")


def committee_product_set(x: list[tuple[Column, Column]], y: list[tuple[Column, Column]], bounds_x=(None, None),
                          bounds_y=(None, None)) -> list[tuple[Column, Column]]:
    """I-10 for committees of several targets, as (value, error) pairs: values are clipped to their committee's
    bounds first; the narrower committee is padded with zeros to the width of the wider one."""
    def padded(pairs, bounds, n):
        own = [(clip(v, *bounds), e) for v, e in pairs]
        return own + [(F.lit(0.0), F.lit(0.0))] * (n - len(own))
    n = max(len(x), len(y))
    return [committee_product(a, ea, b, eb) for (a, ea), (b, eb) in zip(padded(x, bounds_x, n), padded(y, bounds_y, n))]


def self_combine(outputs: dict[str, Column], combo, indices: list[list[str | None]]) -> list[Column]:
    """I-07: new targets from the outputs of one network: ``combo`` of the named outputs, or the first of them
    as it is where a ``None`` stands among the names."""
    unknown = {n for names in indices for n in names if n is not None} - set(outputs)
    if unknown:
        raise KeyError(f"not among the network's targets: {sorted(unknown)}")
    return [outputs[names[0]] if None in names else combo(*[outputs[n] for n in names]) for names in indices]


def layered(outputs: dict[str, Column], gamma0: Column, x: Column, q: Column, smag: Column, gammaE_GB: Column,
            leading: dict[str, str] | None = None) -> dict[str, Column]:
    """I-14: the layers of a stacked set of flux networks with a growth-rate network: each flux is 0 where its
    mode's leading flux is not positive (inferred), then pure fluxes without ETG are scaled by the rotation rule."""
    leading = leading or {"ITG": "efiITG_GB", "TEM": "efeTEM_GB", "ETG": "efeETG_GB"}
    factor = rotation_rule_factor(gamma0, x, q, smag, gammaE_GB)
    out = {}
    for name, c in outputs.items():
        mode = N.parse(name).parts[0].mode
        lead = outputs.get(leading.get(mode, ""))
        c = c if lead is None else F.when(c.isNotNull() & (lead <= 0), F.lit(0.0)).otherwise(c)
        out[name] = c * factor if N.is_pure_flux(name) and mode != "ETG" else c
    return out


def combine(recipe: str, members: list[Column]) -> Column | list[Column]:
    """I-06 / L-08: whitelisted recipes ``nnA <op> nnB`` and ``np.hstack(args)`` (no eval)."""
    if recipe.replace(" ", "") in ("np.hstack(args)", "stack"):
        return list(members)
    m = _RECIPE.match(recipe)
    if not m:
        raise NotImplementedError(f"recipe {recipe!r}")
    a, op, b = members[int(m.group(1))], m.group(2), members[int(m.group(3))]
    return {"*": a * b, "/": F.try_divide(a, b), "+": a + b, "-": a - b}[op]


def combine_divnet_with_leading(div_target: str, div_col: Column, leading: dict[str, Column]) -> tuple[str, Column]:
    """I-13: an ``A_div_B`` prediction times the ``B`` prediction gives ``A``."""
    parts = N.split_parts(div_target)
    if N.extract_operations(parts) != ["_div_"]:
        raise NotImplementedError(f"only A_div_B targets can be combined, not {div_target!r}")
    a, b = N.extract_part_names(parts)
    return a, div_col * leading[b]


# fixed values: rotation-rule coefficients and physical constants of the shear conversion
ROTATION_RULE_C = (0.13, 0.09, 0.41, -1.65)
GAMMA0_FLOOR = 1e-4
R_MIN, R_0 = 1.0, 3.0
M_PROTON = 1.672621777e-27
Q_E = 1.602176565e-19


def rotation_rule_factor(gamma0: Column, x: Column, q: Column, smag: Column, gammaE_GB: Column) -> Column:
    """I-15: ``max(0, 1 + f * gammaE / max(gamma0, 1e-4))`` with ``f = 0.13 q + 0.09 / eps + 0.41 s - 1.65``,
    ``eps = x / 3``; 0 where gamma0 is at (or below) the floor.  On the axis (``x = 0``) the inverse aspect ratio
    has no value, so neither has the factor: missing there, unless the floor rule gives 0."""
    eps = x * F.lit(R_MIN / R_0)
    f = F.lit(ROTATION_RULE_C[0]) * q + F.try_divide(F.lit(ROTATION_RULE_C[1]), eps) + F.lit(ROTATION_RULE_C[2]) * smag + F.lit(ROTATION_RULE_C[3])
    g0 = F.greatest(gamma0, F.lit(GAMMA0_FLOOR))
    fac = F.when(f.isNotNull(), F.greatest(F.lit(1.0) + f * gammaE_GB / g0, F.lit(0.0)))
    return F.when(g0 == F.lit(GAMMA0_FLOOR), F.lit(0.0)).otherwise(fac)


def apply_rotation_rule(df: DataFrame, targets: list[str], factor: Column) -> DataFrame:
    """I-15: scale pure fluxes without ETG by the factor; ratios are an error."""
    repl = {}
    for t in targets:
        if N.is_flux(t) and not N.is_pure_flux(t):
            raise ValueError(f"Cannot apply the rotation rule to non-pure flux {t}")
        if N.is_pure_flux(t) and "ETG" not in t:
            repl[t] = F.col(t) * factor
    return df.withColumns(repl) if repl else df


def _c_ref() -> float:
    return math.sqrt(Q_E * 1e3 / M_PROTON)


def gammaE_GB_to_sim(g: Column, Te: Column, Ai0: Column) -> Column:
    """I-16: gyro-Bohm shear to the simulator's normalisation."""
    c_sou = F.sqrt((F.lit(Q_E) * Te * F.lit(1e3)) / (Ai0 * F.lit(M_PROTON)))
    return -g * (F.lit(R_0) * c_sou) / F.lit(R_MIN * _c_ref())


def gammaE_sim_to_GB(g: Column, Te: Column, Ai0: Column) -> Column:
    c_sou = F.sqrt((F.lit(Q_E) * Te * F.lit(1e3)) / (Ai0 * F.lit(M_PROTON)))
    return -g * F.lit(R_MIN * _c_ref()) / (F.lit(R_0) * c_sou)


def fewer_inputs(df: DataFrame, copies: dict[str, list[str]] | None = None, constants: dict[str, float] | None = None,
                 normni_from_zeff: tuple[float, float] | None = None) -> DataFrame:
    """I-08: prepare the input of a fewer-input network: copy one input to its species
    columns (``set_all_*_equal``), add constant inputs, and two-ion densities from Zeff."""
    new = {}
    for src, dsts in (copies or {}).items():
        for d in dsts:
            new[d] = F.col(src)
    for k, v in (constants or {}).items():
        new[k] = F.lit(float(v))
    if normni_from_zeff:
        from .grid import ion_densities
        z0, z1 = normni_from_zeff
        n0, n1 = ion_densities(F.lit(z0), F.lit(z1), F.col("Zeff"))
        new["normni0"], new["normni1"] = n0, n1
    return df.withColumns(new) if new else df


def range_intersection(registry: DataFrame, kind: str = "feature") -> DataFrame:
    """I-12: per name, ``max`` of the minima and ``min`` of the maxima over networks; an empty
    range (min > max) is flagged."""
    g = registry.groupBy("name").agg(F.max("min").alias("min"), F.min("max").alias("max"))
    return g.withColumn("empty", F.col("min") > F.col("max"))


def registry_ranges(spark, nets: dict[str, Network], kind: str = "feature") -> DataFrame:
    """Long table ``(net, name, min, max)`` of the networks' feature or target ranges."""
    rows = []
    for n, net in nets.items():
        names = net.feature_names if kind == "feature" else net.target_names
        lo = net.feature_min if kind == "feature" else net.target_min
        hi = net.feature_max if kind == "feature" else net.target_max
        rows += [(n, x, float(lo.get(x, -math.inf)), float(hi.get(x, math.inf))) for x in names]
    return spark.createDataFrame(rows, "net string, name string, min double, max double")


def residual_rms(scored_long: DataFrame, truth_long: DataFrame, key: str = "dimx") -> DataFrame:
    """R-09: ``sqrt(mean((pred - target)^2))`` per (network, target) from long tables
    ``(key, net, target, pred)`` and ``(key, target, value)``."""
    j = scored_long.join(truth_long, [key, "target"])
    d = F.col("pred") - F.col("value")
    return j.groupBy("net", "target").agg(F.sqrt(F.avg(d * d)).alias("rms"), F.count(F.lit(1)).alias("n"))


def residual_rms_wide(scored: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """R-09 on a scored table that still carries the truth columns: ``pairs`` of
    (net, target, prediction column); one explode + one grouped aggregate, no join."""
    long = scored.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("net"), F.lit(t).alias("target"), (F.col(p) - F.col(t)).alias("d"))
        for n, t, p in pairs])).alias("r")).select("r.*")
    return long.groupBy("net", "target").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"),
                                             F.count("d").alias("n"))
