"""Registered queries for the network registry (L) over a registry table derived from ``part``
(one network per part: targets, feature order and hyper-parameters from the part's columns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources.bridge import read_table

TARGETS = ["efiITG_GB", "efeITG_GB", "efeITG_GB_div_efiITG_GB", "efeTEM_GB", "efiTEM_GB_div_efeTEM_GB",
           "pfeITG_GB_div_efiITG_GB", None, "efe_GB_div_efi_GB"]
ORDER_A = ["Zeff", "Ati", "Ate", "An", "q", "smag", "x", "Ti_Te", "logNustar"]
ORDER_B = ["Ati", "Ate", "An", "q", "smag", "x", "Ti_Te", "logNustar", "Zeff"]


def _arr(xs):
    return F.array(*[F.lit(x) for x in xs])


def registry_table(spark, sf):
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey") % 8
    tn = F.when(k == 6, _arr(["efe_GB", "efi_GB"]))
    for i, t in enumerate(TARGETS):
        if t is not None:
            tn = tn.when(k == i, _arr([t]))
    h = (F.lit(32) * (1 + F.col("p_size") % 3)).cast("int")
    act = F.when(F.col("p_size") % 5 == 0, F.lit("relu")).otherwise(F.lit("tanh"))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 2 == 0, _arr(ORDER_A)).otherwise(_arr(ORDER_B)).alias("feature_names"),
        tn.alias("target_names"), F.lit(None).cast("string").alias("recipe"),
        F.lit(None).cast("array<bigint>").alias("networks"),
        F.array(h, h, h).alias("hidden_neurons"), F.array(act, act, act).alias("hidden_activation"),
        F.lit("none").alias("output_activation"),
        F.when(F.col("p_size") % 3 == 0, F.lit("mabse")).otherwise(F.lit("mse")).alias("goodness"),
        F.when(F.col("p_size") % 4 == 0, F.lit(5e-5)).otherwise(F.lit(8e-6)).alias("cost_l2_scale"),
        F.lit(0.0).alias("cost_l1_scale"), F.lit("loss").alias("early_stop_measure"),
        F.lit(15).alias("early_stop_after"),
        F.round((F.col("p_retailprice") % 97) / 100.0, 4).alias("rms"))


def processed_table(spark, sf):
    p = read_table(spark, sf, "part")
    return p.filter(F.col("p_partkey") % 3 == 0).select(F.col("p_partkey").alias("network_id"),
                                                       F.round(F.col("p_retailprice") / 1e3, 4).alias("l2_norm"))


def _case_targets():
    parts = " ".join(f"WHEN p_partkey % 8 = {i} THEN ['{t}']" for i, t in enumerate(TARGETS) if t is not None)
    return f"CASE WHEN p_partkey % 8 = 6 THEN ['efe_GB', 'efi_GB'] {parts} END"


REG_SQL = ("reg AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN "
           + "[" + ", ".join(f"'{f}'" for f in ORDER_A) + "] ELSE [" + ", ".join(f"'{f}'" for f in ORDER_B)
           + "] END AS feature_names, " + _case_targets() + " AS target_names, CAST(NULL AS VARCHAR) AS recipe, "
           "CAST(NULL AS BIGINT[]) AS networks, "
           "[CAST(32 * (1 + p_size % 3) AS INTEGER), CAST(32 * (1 + p_size % 3) AS INTEGER), "
           "CAST(32 * (1 + p_size % 3) AS INTEGER)] AS hidden_neurons, "
           "CASE WHEN p_size % 5 = 0 THEN ['relu', 'relu', 'relu'] ELSE ['tanh', 'tanh', 'tanh'] END "
           "AS hidden_activation, 'none' AS output_activation, "
           "CASE WHEN p_size % 3 = 0 THEN 'mabse' ELSE 'mse' END AS goodness, "
           "CASE WHEN p_size % 4 = 0 THEN 5e-5 ELSE 8e-6 END AS cost_l2_scale, 0e0 AS cost_l1_scale, "
           "'loss' AS early_stop_measure, 15 AS early_stop_after, "
           "round(CAST(fmod(p_retailprice, 97e0) AS DOUBLE) / 1e2, 4) AS rms FROM part)")
PROC_SQL = ("proc AS (SELECT p_partkey AS network_id, round(p_retailprice / 1e3, 4) AS l2_norm FROM part "
            "WHERE p_partkey % 3 = 0)")
TOPO = ["hidden_neurons", "hidden_activation", "output_activation"]
NETP = ["goodness", "cost_l2_scale", "cost_l1_scale", "early_stop_measure", "early_stop_after"]


def _sql(body, *extra):
    return "WITH " + ",\n".join([REG_SQL, *extra]) + "\n" + body


def _eq(cols, a="r", b="p"):
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)


from .checks import register  # noqa: E402


@register("registry_similar_topology", _sql(
    "SELECT r.id FROM reg r JOIN (SELECT * FROM reg WHERE id = 7) p ON " + _eq(TOPO + ["target_names"])
    + " WHERE r.id <> 7"))
def registry_similar_topology(spark, sf):
    """L-02 for network 7."""
    return R.similar_topology(registry_table(spark, sf), 7).select("id")


@register("registry_similar_networkpar", _sql(
    "SELECT r.id FROM reg r JOIN (SELECT * FROM reg WHERE id = 7) p ON " + _eq(NETP + ["target_names"])
    + " WHERE r.id <> 7"))
def registry_similar_networkpar(spark, sf):
    """L-03 for network 7."""
    return R.similar_networkpar(registry_table(spark, sf), 7).select("id")


@register("registry_pure_partners", _sql(
    "SELECT r.id FROM reg r JOIN (SELECT * FROM reg WHERE id = 10) p ON " + _eq(TOPO + NETP)
    + " WHERE r.id <> 10 AND r.target_names = ['efiITG_GB']"))
def registry_pure_partners(spark, sf):
    """L-04: partners of ratio network 10 that predict ``efiITG_GB``."""
    return R.pure_partners(registry_table(spark, sf), 10, ["efiITG_GB"]).select("id")


CAND_SQL = ("cand AS (SELECT d.id AS div_id, min(p.id) AS partner_id, split_part(d.target_names[1], '_div_', 1) "
            "AS target, split_part(d.target_names[1], '_div_', 2) AS partner_target FROM reg d JOIN reg p ON "
            + _eq(TOPO + NETP, "d", "p") + " AND len(p.target_names) = 1 AND p.recipe IS NULL AND "
            "p.target_names[1] = split_part(d.target_names[1], '_div_', 2) WHERE len(d.target_names) = 1 AND "
            "d.recipe IS NULL AND len(string_split(d.target_names[1], '_div_')) = 2 GROUP BY d.id, d.target_names)")


@register("registry_divsum_candidates", _sql("SELECT div_id, partner_id, target, partner_target FROM cand", CAND_SQL))
def registry_divsum_candidates(spark, sf):
    """L-06: every ratio network with its lowest-id partner (partners reduced per key first)."""
    return R.divsum_candidates(registry_table(spark, sf))


BASE_SQL = "(SELECT max(id) FROM reg)"


@register("registry_compose", _sql(
    f"SELECT {BASE_SQL} + 2 * div_id - 1 AS id, [target] AS target_names, 'nn0 * nn1' AS recipe, "
    "[div_id, partner_id] AS networks FROM cand UNION ALL "
    f"SELECT {BASE_SQL} + 2 * div_id, [target, partner_target], 'np.hstack(args)', "
    f"[{BASE_SQL} + 2 * div_id - 1, partner_id] FROM cand", CAND_SQL))
def registry_compose(spark, sf):
    """L-05: combo and multi-target rows composed from ratio networks and their partners."""
    return R.compose_from_ratio(registry_table(spark, sf))


@register("registry_recursive_l2", _sql(
    "SELECT id, list_sort(list(v)) AS cost_l2_scale FROM ("
    "SELECT c.id, r.cost_l2_scale AS v FROM cand JOIN reg r ON r.id IN (cand.div_id, cand.partner_id) "
    f"JOIN (SELECT div_id, {BASE_SQL} + 2 * div_id - 1 AS id FROM cand) c ON c.div_id = cand.div_id "
    "UNION ALL SELECT m.id, r.cost_l2_scale FROM cand JOIN reg r ON r.id IN (cand.div_id, cand.partner_id) "
    f"JOIN (SELECT div_id, {BASE_SQL} + 2 * div_id AS id FROM cand) m ON m.div_id = cand.div_id "
    "UNION ALL SELECT m.id, r.cost_l2_scale FROM cand JOIN reg r ON r.id = cand.partner_id "
    f"JOIN (SELECT div_id, {BASE_SQL} + 2 * div_id AS id FROM cand) m ON m.div_id = cand.div_id"
    ") GROUP BY id", CAND_SQL))
def registry_recursive_l2(spark, sf):
    """L-07: l2 scale over the leaves of every composed network (recursion through combos)."""
    reg = registry_table(spark, sf)
    composed = R.compose_from_ratio(reg)
    full = reg.unionByName(composed, allowMissingColumns=True)
    return R.recursive_attribute(full, "cost_l2_scale")


@register("registry_best", _sql(
    "SELECT target_names, arg_min(id, (rms, id)) AS id, min(rms) AS rms, CAST(count(*) AS BIGINT) AS n FROM reg "
    "WHERE rms IS NOT NULL AND (feature_names = [" + ", ".join(f"'{f}'" for f in ORDER_A) + "] OR feature_names = ["
    + ", ".join(f"'{f}'" for f in ORDER_B) + "]) GROUP BY target_names"))
def registry_best(spark, sf):
    """L-09: best network per target list among two feature orders."""
    return R.best_per_target_set(registry_table(spark, sf), [ORDER_A, ORDER_B]).select(
        "target_names", "id", "rms", F.col("n").cast("bigint").alias("n"))


@register("registry_unprocessed", _sql(
    "SELECT id FROM reg WHERE id NOT IN (SELECT network_id FROM proc) AND len(target_names) = 1 AND "
    "len(list_filter(target_names, lambda t: contains(t, '_div_') OR contains(t, '_plus_'))) = 0 "
    "ORDER BY id LIMIT 100", PROC_SQL))
def registry_unprocessed(spark, sf):
    """L-11: the next batch of 100 pure networks without a post-processing row."""
    return R.unprocessed(registry_table(spark, sf), processed_table(spark, sf), limit=100).select("id")


@register("registry_array_predicates", _sql(
    "SELECT 'no_div_plus' AS what, CAST(count(*) AS BIGINT) AS n FROM reg WHERE "
    "len(list_filter(target_names, lambda t: contains(t, 'div') OR contains(t, 'plus'))) = 0 "
    "UNION ALL SELECT 'any_tem', CAST(count(*) AS BIGINT) FROM reg WHERE "
    "len(list_filter(target_names, lambda t: contains(t, 'TEM'))) > 0 "
    "UNION ALL SELECT 'distinct_targets', CAST(count(DISTINCT t) AS BIGINT) FROM (SELECT unnest(target_names) AS t "
    "FROM reg UNION ALL SELECT unnest(target_names) FROM (SELECT [target] AS target_names FROM cand))",
    CAND_SQL))
def registry_array_predicates(spark, sf):
    """L-12: array-content predicates and distinct target names over two registry tables."""
    reg = registry_table(spark, sf)
    a = reg.filter(R.no_elements_in_list("target_names", ["div", "plus"])).agg(
        F.lit("no_div_plus").alias("what"), F.count(F.lit(1)).cast("bigint").alias("n"))
    b = reg.filter(R.any_element_in_list("target_names", ["TEM"])).agg(
        F.lit("any_tem").alias("what"), F.count(F.lit(1)).cast("bigint").alias("n"))
    comb = R.compose_from_ratio(reg).filter(F.col("recipe") == "nn0 * nn1")
    c = R.distinct_targets(reg, comb).agg(F.lit("distinct_targets").alias("what"),
                                          F.count(F.lit(1)).cast("bigint").alias("n"))
    return a.unionByName(b).unionByName(c)


@register("registry_scan_query", _sql(
    "SELECT r.id, r.goodness, p.l2_norm FROM reg r LEFT JOIN proc p ON p.network_id = r.id "
    "WHERE r.target_names = ['efiITG_GB'] AND r.cost_l2_scale = 8e-6 AND "
    "r.hidden_activation[1] = 'tanh'", PROC_SQL))
def registry_scan_query(spark, sf):
    """L-10: network x post-processing x hyper-parameters with target, cast-equality and
    activation filters."""
    reg = registry_table(spark, sf)
    j = reg.join(processed_table(spark, sf).withColumnRenamed("network_id", "id"), "id", "left")
    return j.filter((F.col("target_names") == F.array(F.lit("efiITG_GB")))
                    & (F.col("cost_l2_scale") == F.lit(8e-6)) & (F.col("hidden_activation")[0] == "tanh")) \
        .select("id", "goodness", "l2_norm")


@register("grid_summary", _sql(
    "SELECT r.id, g.* FROM reg r JOIN (SELECT hidden_neurons[1] AS nodes, cost_l2_scale, count(*) AS n, round(CAST(sum(CAST(rms AS DECIMAL(38,4))) AS DOUBLE) "
    "/ count(rms), 6) AS rms, round(stddev_samp(rms), 6) AS rms_std FROM reg WHERE rms IS NOT NULL GROUP BY hidden_neurons[1], cost_l2_scale) g "
    "ON g.nodes = r.hidden_neurons[1] AND g.cost_l2_scale = r.cost_l2_scale WHERE r.rms IS NOT NULL"))
def grid_summary(spark, sf):
    """R-11: the networks of each (nodes, l2) cell of the registry with mean / std of the cell's rms."""
    from ..operators import report
    reg = registry_table(spark, sf).withColumn("nodes", F.col("hidden_neurons")[0])
    g = report.grid_members(reg, ["nodes", "cost_l2_scale"], ["rms"], decimals=4)
    return g.select("id", "nodes", "cost_l2_scale", "n", F.round("rms", 6).alias("rms"), F.round("rms_std", 6).alias("rms_std"))


@register("registry_from_folder", "WITH g AS (SELECT p_size, min(p_partkey) AS k FROM part GROUP BY p_size) "
          "SELECT 'net-' || p_size AS network, ['Ati', 'q'] AS feature_names, [CASE WHEN k % 2 = 0 THEN 'efiITG_GB' ELSE 'efeTEM_GB' END] AS target_names, "
          "CASE WHEN p_size % 5 = 0 THEN ['relu', 'relu'] ELSE ['tanh'] END AS hidden_activation, 'none' AS output_activation, "
          "CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS n_hidden, k % 3 <> 0 AS complete FROM g")
def registry_from_folder(spark, sf):
    """A-20 / L-01: a folder of network documents (one for each part size) read and registered."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.store import network_documents
    g = read_table(spark, sf, "part").groupBy("p_size").agg(F.min("p_partkey").alias("k"))
    target = F.when(F.col("k") % 2 == 0, "efiITG_GB").otherwise("efeTEM_GB")
    scales = F.map_concat(F.create_map(F.lit("Ati"), F.lit(0.1), F.lit("q"), F.lit(0.1)),
                          F.when(F.col("k") % 3 != 0, F.create_map(target, F.lit(0.2))).otherwise(F.create_map().cast("map<string,double>")))
    doc = F.struct(_arr(["Ati", "q"]).alias("feature_names"), F.array(target).alias("target_names"),
                   F.when(F.col("p_size") % 5 == 0, _arr(["relu", "relu"])).otherwise(_arr(["tanh"])).alias("hidden_activation"),
                   F.lit("none").alias("output_activation"), scales.alias("prescale_factor"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/networks-{uuid.uuid4().hex}"
    g.select(F.concat(F.lit("net-"), F.col("p_size").cast("string")).alias("network"), doc.alias("d")) \
        .select("network", "d.*").write.partitionBy("network").json(path)
    out = R.register_documents(network_documents(spark, path))
    return out.select(F.regexp_extract("source", "network=([^/]+)/", 1).alias("network"), "feature_names", "target_names",
                      "hidden_activation", "output_activation", "n_hidden", "complete")
