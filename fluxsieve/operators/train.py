"""Training as Spark jobs (2.J): standardisation, goodness, costs, and a data-parallel fit.

The fit is re-aimed at Spark: each step, every partition computes the partial
gradient of the loss over its rows (``mapInPandas``, numpy), the partial results
(one small vector per partition) are summed, and the optimiser update runs once
on the driver.  The training set is cached once; minibatches are hash buckets
(G-08), so no data moves between steps.
"""

from __future__ import annotations

import json
import math
import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .score import Network, _act_np, make_network


# ----------------------------------------------------------------- J-01 .. J-03

def standardization(df: DataFrame, columns, spec: str = "normsm_1_0", nonzero_targets=None) -> DataFrame:
    """J-01 / J-02: ``(name, factor, bias)`` with ``x' = factor * x + bias``.

    ``minmax_l_u`` maps [min, max] to [l, u]; ``normsm_s_m`` gives std s (ddof 1) and mean m.
    ``nonzero_targets``: compute on rows where any of these targets is non-zero only.
    One aggregate over the data, one row per column out.
    """
    src = df
    if nonzero_targets:
        src = df.filter(F.greatest(*[F.coalesce(F.col(t) != 0, F.lit(False)) for t in nonzero_targets])
                        if len(nonzero_targets) > 1 else F.coalesce(F.col(nonzero_targets[0]) != 0, F.lit(False)))
    kind, p1, p2 = spec.split("_")[0], float(spec.split("_")[-2]), float(spec.split("_")[-1])
    if kind == "minmax":
        aggs = [F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns]
        def fb(c):
            fac = F.lit(p2 - p1) / (F.col(f"{c}.b") - F.col(f"{c}.a"))
            return fac, F.lit(p1) - F.col(f"{c}.a") * fac
    elif kind == "normsm":
        aggs = [F.struct(F.avg(c).alias("a"), F.stddev_samp(c).alias("b")).alias(c) for c in columns]
        def fb(c):
            fac = F.lit(p1) / F.col(f"{c}.b")
            return fac, F.lit(p2) - F.col(f"{c}.a") * fac
    else:
        raise ValueError(f"unknown standardization {spec!r}")
    one = src.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("name"), fb(c)[0].alias("factor"), fb(c)[1].alias("bias")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scaling_dict(table: DataFrame) -> dict[str, tuple[float, float]]:
    """The small constants table (one row per column) as a dict for building expressions."""
    return {r["name"]: (r["factor"], r["bias"]) for r in table.collect()}


def scale_columns(df: DataFrame, consts: dict[str, tuple[float, float]], inverse: bool = False) -> DataFrame:
    """J-03: ``a x + b`` (or ``(y - b) / a``) for every column in ``consts``."""
    def f(c):
        a, b = consts[c]
        return ((F.col(c) - F.lit(b)) / F.lit(a)) if inverse else (F.col(c) * F.lit(a) + F.lit(b))
    return df.select(*[f(c).alias(c) if c in consts else F.col(c) for c in df.columns])


# ----------------------------------------------------------------- J-04, J-05, J-11

def goodness(pred: Column, truth: Column, truth_descaled: Column | None = None, only_unstable: bool = False,
             weight: Column | None = None) -> list[Column]:
    """J-04 / J-11 aggregates: ``mse``, ``mabse`` (optionally only where the descaled target is
    > 0, and optionally instance-weighted ``sum(w e) / sum(w)``)."""
    d = pred - truth
    w = F.lit(1.0) if weight is None else weight
    if only_unstable:
        w = F.when((truth_descaled if truth_descaled is not None else truth) > 0, w).otherwise(F.lit(0.0))
    return [(F.sum(w * d * d) / F.sum(w)).alias("mse"), (F.sum(w * F.abs(d)) / F.sum(w)).alias("mabse")]


def stable_positive(pred: Column, truth_descaled: Column, scale: float, offset: float, function: str = "block"):
    """J-05: penalty for positive predictions where the target is stable (<= 0)."""
    stable = truth_descaled <= 0
    if function == "block":
        return F.avg(F.lit(scale) * (pred - F.lit(offset)) * F.when(stable & (pred > offset), 1.0).otherwise(0.0))
    if function == "barrier":
        return F.avg(F.when(stable, 1.0).otherwise(0.0) * F.exp(F.lit(scale) * (pred - F.lit(offset))))
    raise ValueError(function)


def weight_norms(net: Network) -> dict[str, float]:
    """J-06: l2 = sum(w^2)/2 and l1 = sum |w| over the weight matrices."""
    return {"l2_norm": net.l2_norm(), "l1_norm": net.l1_norm()}


def total_loss(goodness_value: float, net: Network, l2_scale: float, l1_scale: float,
               stable_positive_value: float = 0.0) -> dict[str, float]:
    n = weight_norms(net)
    parts = {"goodness": goodness_value, "l2_loss": l2_scale * n["l2_norm"], "l1_loss": l1_scale * n["l1_norm"],
             "stable_positive_loss": stable_positive_value}
    parts["loss"] = sum(parts.values())
    return parts


# ----------------------------------------------------------------- J-07 .. J-09

def _forward_backward(W, B, acts, X, Y, weights=None):
    hs, zs = [X], []
    h = X
    for w, b, a in zip(W, B, acts):
        z = h @ w + b
        h = _act_np(a, z)
        zs.append(z)
        hs.append(h)
    d = h - Y
    sw = np.ones(len(X)) if weights is None else weights
    loss = float((sw[:, None] * d * d).sum())
    g = 2.0 * sw[:, None] * d
    gW, gB = [None] * len(W), [None] * len(W)
    for i in range(len(W) - 1, -1, -1):
        a = acts[i]
        if a == "tanh":
            g = g * (1.0 - np.tanh(zs[i]) ** 2)
        elif a == "relu":
            g = g * (zs[i] > 0)
        gW[i] = hs[i].T @ g
        gB[i] = g.sum(0)
        g = g @ W[i].T
    return loss, gW, gB


def fit(df: DataFrame, features, targets, hidden=(8,), activation="tanh", epochs: int = 5, minibatches: int = 4,
        learning_rate: float = 1e-2, l2_scale: float = 0.0, seed: int = 0, key: str = "dimx",
        weight_col: str | None = None, early_stop_after: int = 15, optimizer: str = "adam"):
    """J-07 / J-08: fit an MLP on already-standardised columns; returns ``(network, log DataFrame)``.

    Per step one Spark job: partial gradients per partition (one vector each), summed,
    then an Adam (or plain gradient-descent) update on the driver.  Early stopping on
    the epoch loss with ``early_stop_after`` patience; the best epoch is restored; a
    non-finite loss stops training.
    """
    from .split import minibatch
    spark = df.sparkSession
    net = make_network(features, targets, hidden=hidden, activation=activation, seed=seed, scale=0.3)
    net.prescale_factor = {c: 1.0 for c in list(features) + list(targets)}
    net.prescale_bias = {c: 0.0 for c in list(features) + list(targets)}
    cols = [key, *features, *targets] + ([weight_col] if weight_col else [])
    data = df.select(*cols).dropna().cache()
    n_rows = data.count()
    params = [*net.weights, *net.biases]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    b1, b2, eps = 0.9, 0.999, 1e-8
    log, best, best_loss, since, t0, step = [], None, math.inf, 0, time.time(), 0
    nl = len(net.weights)
    schema = StructType([StructField("loss", DoubleType()), StructField("n", LongType()),
                         StructField("grad", ArrayType(DoubleType()))])
    stop_reason = "max_epochs"
    for epoch in range(epochs):
        epoch_loss = 0.0
        for mb in range(minibatches):
            bc = spark.sparkContext.broadcast((net.weights, net.biases, net.activations))
            part = data.filter(minibatch(data, minibatches, epoch, seed, key) == mb)

            def grads(batches, bc=bc):
                import pandas as pd
                W, B, acts = bc.value
                tot = None
                for pdf in batches:
                    X = pdf[list(features)].to_numpy(np.float64)
                    Y = pdf[list(targets)].to_numpy(np.float64)
                    sw = pdf[weight_col].to_numpy(np.float64) if weight_col else None
                    loss, gW, gB = _forward_backward(W, B, acts, X, Y, sw)
                    flat = np.concatenate([g.ravel() for g in gW + gB])
                    tot = (loss, len(X), flat) if tot is None else (tot[0] + loss, tot[1] + len(X), tot[2] + flat)
                if tot is not None:
                    yield pd.DataFrame({"loss": [tot[0]], "n": [tot[1]], "grad": [tot[2].tolist()]})

            rows = part.mapInPandas(grads, schema).collect()  # one small row per partition
            if not rows:
                continue
            n = sum(r["n"] for r in rows)
            loss = sum(r["loss"] for r in rows) / n
            flat = np.sum([np.asarray(r["grad"]) for r in rows], axis=0) / n
            gs, off = [], 0
            for p in params:
                gs.append(flat[off:off + p.size].reshape(p.shape))
                off += p.size
            for i in range(nl):
                gs[i] = gs[i] + l2_scale * params[i]
            step += 1
            for i, p in enumerate(params):
                if optimizer == "adam":
                    m[i] = b1 * m[i] + (1 - b1) * gs[i]
                    v[i] = b2 * v[i] + (1 - b2) * gs[i] ** 2
                    mh, vh = m[i] / (1 - b1 ** step), v[i] / (1 - b2 ** step)
                    p -= learning_rate * mh / (np.sqrt(vh) + eps)
                else:
                    p -= learning_rate * gs[i]
            net.weights, net.biases = params[:nl], params[nl:]
            epoch_loss += loss * n
            bc.unpersist()
        epoch_loss /= max(n_rows, 1)
        l2 = net.l2_norm()
        log.append((epoch, round(time.time() - t0, 3), float(epoch_loss), float(l2), float(net.l1_norm())))
        if not math.isfinite(epoch_loss):
            stop_reason = "nan_or_inf"
            break
        if epoch_loss < best_loss:
            best_loss, since = epoch_loss, 0
            best = ([w.copy() for w in net.weights], [b.copy() for b in net.biases], epoch)
        else:
            since += 1
            if since >= early_stop_after:
                stop_reason = "early_stop"
                break
    if best is not None:
        net.weights, net.biases = best[0], best[1]
        net.metadata = {"best_epoch": best[2], "best_loss": best_loss, "stop_reason": stop_reason}
    data.unpersist()
    log_df = spark.createDataFrame(log, "epoch int, walltime double, loss double, l2_norm double, l1_norm double")
    return net, log_df


def model_record(net: Network, settings: dict | None = None) -> str:
    """J-09: the network, its names, ranges, scales, settings and metadata as one JSON document."""
    d = net.to_dict()
    if settings:
        d["_parsed_settings"] = settings
    return json.dumps(d)


def grid_search(df: DataFrame, features, targets, grid: list[dict], **fit_kw) -> DataFrame:
    """J-10 re-aimed: one data-parallel fit per grid cell (each a sequence of Spark jobs over
    the cached training set); returns one row per cell with its settings and final loss."""
    spark = df.sparkSession
    rows = []
    for i, cell in enumerate(grid):
        kw = dict(fit_kw)
        kw.update(cell)
        net, log = fit(df, features, targets, **kw)
        last = log.orderBy(F.col("epoch").desc()).first()
        rows.append((i, json.dumps(cell, sort_keys=True), float(net.metadata.get("best_loss", float("nan"))),
                     int(net.metadata.get("best_epoch", -1)), float(last["l2_norm"]) if last else None))
    return spark.createDataFrame(rows, "cell int, settings string, best_loss double, best_epoch int, l2_norm double")
