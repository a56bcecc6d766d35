"""Network registry queries (2.L) as relational DataFrame jobs.

The registry is one wide table, one row per network: ``id, feature_names,
target_names, recipe, networks`` plus hyper-parameters (``hidden_neurons,
hidden_activation, output_activation, goodness, cost_l2_scale, cost_l1_scale,
early_stop_measure, early_stop_after``) and the validation ``rms``.

Partner searches never form all pairs of a group: the side that can be large is
reduced per key first (``min_by`` / ``count`` aggregates), or the probe is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import cut_lineage

TOPOLOGY = ["hidden_neurons", "hidden_activation", "output_activation"]
NETPAR = ["goodness", "cost_l2_scale", "cost_l1_scale", "early_stop_measure", "early_stop_after"]


def _probe(reg: DataFrame, net_id: int, cols) -> DataFrame:
    return reg.filter(F.col("id") == net_id).select(*[F.col(c).alias(f"__p_{c}") for c in cols])


def _match(reg: DataFrame, probe: DataFrame, cols) -> DataFrame:
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p_{c}") for c in cols])
    # the probe is one row (a key lookup): broadcasting it is bounded by construction
    return reg.join(F.broadcast(probe), cond, "inner").drop(*probe.columns)


def similar_topology(reg: DataFrame, net_id: int) -> DataFrame:
    """L-02: same hidden neurons, activations and targets, excluding the network itself."""
    cols = TOPOLOGY + ["target_names"]
    return _match(reg, _probe(reg, net_id, cols), cols).filter(F.col("id") != net_id)


def similar_networkpar(reg: DataFrame, net_id: int) -> DataFrame:
    """L-03: same goodness, l2, l1, early-stop measure and patience, and targets."""
    cols = NETPAR + ["target_names"]
    return _match(reg, _probe(reg, net_id, cols), cols).filter(F.col("id") != net_id)


def pure_partners(reg: DataFrame, net_id: int, target_names: list[str]) -> DataFrame:
    """L-04: networks trained like ``net_id`` (topology and parameters) for other targets."""
    cols = TOPOLOGY + NETPAR
    m = _match(reg, _probe(reg, net_id, cols), cols)
    want = F.array(*[F.lit(t) for t in target_names])
    return m.filter((F.col("target_names") == want) & (F.col("id") != net_id))


def div_parts(target: Column) -> tuple[Column, Column]:
    """``A_div_B`` -> (A, B) as columns (NULL when the name is not a single ratio)."""
    ok = (F.size(F.split(target, "_div_")) == 2)
    return (F.when(ok, F.split(target, "_div_")[0]), F.when(ok, F.split(target, "_div_")[1]))


def divsum_candidates(reg: DataFrame) -> DataFrame:
    """L-05 / L-06 set-based: for every single-target ``A_div_B`` network, the partner (lowest id)
    predicting ``[B]`` with the same topology and parameters; one row per ratio network:
    ``div_id, partner_id, target`` (= A), ``partner_target`` (= B)."""
    keys = TOPOLOGY + NETPAR
    single = reg.filter((F.size("target_names") == 1) & F.col("recipe").isNull())
    a, b = div_parts(F.col("target_names")[0])
    divs = single.select(F.col("id").alias("div_id"), a.alias("target"), b.alias("partner_target"), *keys) \
        .filter(F.col("partner_target").isNotNull())
    # partners reduced per key first: one row per (keys, target), however many networks share it
    partners = single.groupBy(*keys, F.col("target_names")[0].alias("partner_target")) \
        .agg(F.min("id").alias("partner_id"))
    return divs.join(partners, keys + ["partner_target"], "inner").select(
        "div_id", "partner_id", "target", "partner_target")


def compose_from_ratio(reg: DataFrame, next_id_base: int | None = None) -> DataFrame:
    """L-05: new registry rows for every ratio network with a partner: the combo network
    ``A = [div, B]`` (recipe ``nn0 * nn1``) and the multi-target ``[A, B]`` (``np.hstack(args)``).
    New ids follow the current maximum: ``base + 2 div_id - 1`` and ``base + 2 div_id`` (unique
    without any ranking)."""
    cand = divsum_candidates(reg)
    base = next_id_base if next_id_base is not None else (reg.agg(F.max("id")).first()[0] or 0)
    combo_id = F.lit(base) + 2 * F.col("div_id") - 1
    combo = cand.select(combo_id.alias("id"), F.array("target").alias("target_names"),
                        F.lit("nn0 * nn1").alias("recipe"), F.array("div_id", "partner_id").alias("networks"))
    multi = cand.select((F.lit(base) + 2 * F.col("div_id")).alias("id"),
                        F.array("target", "partner_target").alias("target_names"),
                        F.lit("np.hstack(args)").alias("recipe"), F.array(combo_id, F.col("partner_id")).alias("networks"))
    return combo.unionByName(multi)


def divsum_from_div_id(reg: DataFrame, net_id: int, raise_on_missing: bool = True) -> DataFrame:
    """L-05 for one network, with the reference's errors: multi-target or non-ratio -> ValueError,
    unknown parts -> NotImplementedError, no partner -> LookupError (or no rows)."""
    row = reg.filter(F.col("id") == net_id).select("target_names").first()
    if row is None:
        raise LookupError(net_id)
    targets = row["target_names"]
    if len(targets) != 1 or "_div_" not in targets[0]:
        raise ValueError(f"network {net_id} is not a single-target ratio network: {targets}")
    a, b = targets[0].split("_div_", 1)
    if N.parse(a) is None or N.parse(b) is None:
        raise NotImplementedError(f"no recipe for {targets[0]}")
    out = compose_from_ratio(reg).filter(F.col("networks")[0] == net_id)
    if raise_on_missing and out.limit(1).count() == 0:
        raise LookupError(f"no partner for network {net_id}")
    combo = out.filter(F.col("recipe") == "nn0 * nn1")
    multi_ids = combo.select(F.col("id").alias("__c"))
    multi = compose_from_ratio(reg).join(multi_ids, F.col("networks")[0] == F.col("__c")).drop("__c")
    return combo.unionByName(multi)


def _doubled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths of ``a`` followed by paths of ``b``."""
    return a.join(b.select(F.col("id").alias("to"), F.col("to").alias("end")), "to").select("id", F.col("end").alias("to"))


def _cycle(edges: DataFrame, looping: DataFrame) -> list:
    """Ids of a cycle, for the error message: the least looping child of each id is followed until one repeats."""
    inside = edges.join(looping.select(F.col("id").alias("to")).distinct(), "to").groupBy("id").agg(F.min("to").alias("to"))
    inside = cut_lineage(inside.join(looping.select("id").distinct(), "id"))
    at, seen = inside.agg(F.min("id")).first()[0], []
    while at not in seen and len(seen) < 100:
        seen.append(at)
        at = inside.filter(F.col("id") == at).first()["to"]
    return seen[seen.index(at):] if at in seen else seen


def leaves(reg: DataFrame) -> DataFrame:
    """L-07 helper: ``(id, leaf, n)`` for every composed network: its pure networks, and along how many ways it uses them.

    Pointer jumping: paths of 1, 2, 4, ... steps, so rounds grow with the logarithm of the depth.  Paths longer than there
    are composed networks mean a cycle, which is an error that names it.
    """
    edges = cut_lineage(reg.filter(F.col("networks").isNotNull()).select("id", F.explode("networks").alias("to")).groupBy("id", "to")
                        .agg(F.count(F.lit(1)).alias("n")))
    composed = cut_lineage(edges.select("id").distinct())
    among = edges.join(composed.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to")
    paths, rounds, total = cut_lineage(among), 0, composed.count()
    while not paths.isEmpty():
        if 1 << rounds > total:
            raise ValueError(f"networks composed of each other: {_cycle(among, paths)}")
        paths, rounds = cut_lineage(_doubled(paths, paths).distinct()), rounds + 1
    # ways to each leaf, doubled as often; a pure network leads to itself
    ways = edges.withColumnRenamed("to", "leaf")
    for _ in range(rounds):
        onward = ways.select(F.col("id").alias("leaf"), F.col("leaf").alias("end"), F.col("n").alias("m"))
        ways = cut_lineage(ways.join(onward, "leaf", "left").groupBy("id", F.coalesce("end", "leaf").alias("leaf"))
                           .agg(F.sum(F.col("n") * F.coalesce("m", F.lit(1))).alias("n")))
    return ways


def recursive_attribute(reg: DataFrame, param: str, distinct: bool = False) -> DataFrame:
    """L-07: for each composed network, the array of ``param`` over its leaves (sorted)."""
    lv = leaves(reg).join(reg.select(F.col("id").alias("leaf"), F.col(param).alias("__v")), "leaf").filter(F.col("__v").isNotNull())
    agg = F.collect_set("__v") if distinct else F.flatten(F.collect_list(F.array_repeat("__v", F.col("n").cast("int"))))
    return lv.groupBy("id").agg(F.sort_array(agg).alias(param))


def best_per_target_set(reg: DataFrame, feature_orders: list[list[str]]) -> DataFrame:
    """L-09: per distinct target list, the network with the lowest rms among those with one of the
    given feature orders (``min_by`` aggregate: a popular target list does not land in one task)."""
    ok = reduce(lambda a, b: a | b, [F.col("feature_names") == F.array(*[F.lit(f) for f in o])
                                     for o in feature_orders])
    return reg.filter(ok & F.col("rms").isNotNull()).groupBy("target_names").agg(
        F.min_by(F.struct("id", "rms"), F.struct("rms", "id")).alias("b"), F.count(F.lit(1)).alias("n")) \
        .select("target_names", F.col("b.id").alias("id"), F.col("b.rms").alias("rms"), "n")


def unprocessed(reg: DataFrame, processed: DataFrame, limit: int | None = None, exclude_ratio: bool = True,
                exclude_multi: bool = True, exclude_particle: bool = False) -> DataFrame:
    """L-11: networks without a post-processing row, optionally without ratio / multi-target /
    particle targets; ``limit`` is the batch size of the job (the feature, not a sample)."""
    r = reg.join(processed.select(F.col("network_id").alias("id")), "id", "left_anti")
    if exclude_multi:
        r = r.filter(F.size("target_names") == 1)
    if exclude_ratio:
        r = r.filter(~F.exists("target_names", lambda t: t.contains("_div_") | t.contains("_plus_")))
    if exclude_particle:
        r = r.filter(~F.exists("target_names", lambda t: t.startswith("pf")))
    return r.orderBy("id").limit(limit) if limit else r


def no_elements_in_list(field: str, words) -> Column:
    """L-12: no array element contains any of ``words``."""
    return ~F.exists(field, lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in words]))


def any_element_in_list(field: str, words) -> Column:
    return F.exists(field, lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in words]))


def distinct_targets(*tables: DataFrame) -> DataFrame:
    """L-12: distinct target names over several registry tables."""
    return reduce(lambda a, b: a.unionByName(b),
                  [t.select(F.explode("target_names").alias("target")) for t in tables]).distinct()


def leading_flag(target_col: str = "target") -> Column:
    """Catalogue predicate used by registry filters (F-21 as an expression)."""
    from ..functions.name_columns import catalog_columns
    return catalog_columns(F.col(target_col))["is_leading"]


def register_documents(documents: DataFrame) -> DataFrame:
    """L-01: network documents (``store.network_documents``) as registry rows; a document's file is its id."""
    return documents.select(
        F.col("file").alias("source"), "feature_names", "target_names", "hidden_activation", "output_activation",
        F.size("hidden_activation").alias("n_hidden"),
        (F.size(F.map_keys("prescale_factor")) == F.size("feature_names") + F.size("target_names")).alias("complete"))
