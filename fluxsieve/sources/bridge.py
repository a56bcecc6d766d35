"""Driver-table readers and the flux *bridge view*.

The reference works on flux-point tables (one row per scan point, features +
targets).  The driver's tables are TPC-H-like, so every flux operator runs on a
deterministic view derived from ``lineitem``: a row id ``dimx``, features, per-mode
fluxes, convergence checks and stability flags.  The same text exists in SQL for
the DuckDB oracle (``BRIDGE_SQL``); tests check they agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

FEATURES = ["Ati", "Ate", "An", "q", "x", "Machtor", "Nustar"]
TARGETS = ["efiITG_GB", "efeITG_GB", "efeTEM_GB", "efiTEM_GB", "efeETG_GB", "pfeITG_GB", "pfeTEM_GB",
           "efe_GB", "efi_GB"]

# Fixed fixture definition shared with the oracle (plain SQL, runs in Spark and DuckDB).
BRIDGE_SQL = """
WITH b AS (
  SELECT ((((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*1000 + l_suppkey)*100
           + CAST(l_quantity AS BIGINT)) AS dimx,
         l_partkey AS scan_id, l_quantity AS Ati,
         ROUND(l_discount*1e2, 0) AS Ate, ROUND(l_tax*1e2, 0) AS An,
         CAST(l_linenumber AS DOUBLE) AS q,
         CAST(l_suppkey % 10 AS DOUBLE)/1e1 AS x,
         CASE WHEN l_returnflag = 'A' THEN 0e0 WHEN l_returnflag = 'N' THEN 1e-1 ELSE 2e-1 END AS Machtor,
         CAST(POWER(1e1, -1e0 * (l_orderkey % 4)) AS DOUBLE) AS Nustar,
         CAST(ROUND(l_extendedprice*1e2, 0) AS BIGINT) AS c
  FROM lineitem),
f AS (
  SELECT b.*,
    CASE WHEN c%5=0 THEN 0e0 ELSE CAST(c%4000      AS DOUBLE)/1e2 - 1e0 END AS efiITG_GB,
    CASE WHEN c%5=0 THEN 0e0 ELSE CAST((c*31)%3000 AS DOUBLE)/1e2 END AS efeITG_GB,
    CASE WHEN c%7=0 THEN 0e0 ELSE CAST((c*17)%2500 AS DOUBLE)/1e2 END AS efeTEM_GB,
    CASE WHEN c%7=0 THEN 0e0 ELSE CAST((c*13)%2000 AS DOUBLE)/1e2 END AS efiTEM_GB,
    CASE WHEN c%3=0 THEN 0e0 ELSE CAST((c*11)%1500 AS DOUBLE)/1e2 END AS efeETG_GB,
    CASE WHEN c%5=0 THEN 0e0 ELSE CAST((c*19)%900  AS DOUBLE)/1e2 - 45e-1 END AS pfeITG_GB,
    CASE WHEN c%7=0 THEN 0e0 ELSE CAST((c*23)%900  AS DOUBLE)/1e2 - 45e-1 END AS pfeTEM_GB,
    CAST(c%250 AS DOUBLE)/1e2 + 4e-1 AS absambi,
    CAST((c*3)%60 AS DOUBLE) AS cke, CAST((c*5)%60 AS DOUBLE) - 3e1 AS cki,
    (c%5<>0) AS ITG, (c%7<>0) AS TEM, (c%3<>0) AS ETG
  FROM b)
SELECT f.*, efeITG_GB+efeTEM_GB+efeETG_GB AS efe_GB, efiITG_GB+efiTEM_GB AS efi_GB FROM f
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallel(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores.

    A large table arrives as many files / row groups and is left alone (no shuffle);
    a single unsplittable file (one row group) would otherwise run every row-wise
    operator in one task.  Decided at plan time from the scan's split count.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def bridge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flux point table over ``lineitem`` (DataFrame form of ``BRIDGE_SQL``).

    Narrow projection of one scan: no shuffle, the only columns read are the
    lineitem columns used, and later filters on fluxes stay in the same stage.
    """
    li = read_table(spark, sf_dir, "lineitem")
    c = F.round(F.col("l_extendedprice") * 1e2, 0).cast("bigint")
    li = ensure_parallel(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                   "l_extendedprice", "l_discount", "l_tax", "l_returnflag"))
    b = li.select(
        ((((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000
          + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("bigint")).alias("dimx"),
        F.col("l_partkey").alias("scan_id"),
        F.col("l_quantity").alias("Ati"),
        F.round(F.col("l_discount") * 1e2, 0).alias("Ate"),
        F.round(F.col("l_tax") * 1e2, 0).alias("An"),
        F.col("l_linenumber").cast("double").alias("q"),
        ((F.col("l_suppkey") % 10).cast("double") / 1e1).alias("x"),
        F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 0.1)
        .otherwise(0.2).alias("Machtor"),
        F.pow(F.lit(10.0), -1.0 * (F.col("l_orderkey") % 4)).cast("double").alias("Nustar"),
        c.alias("c"),
    )
    c = F.col("c")

    def flux(mod, mult, m, shift=0.0):
        v = ((c * mult) % m).cast("double") / 1e2
        if shift:
            v = v - shift
        return F.when(c % mod == 0, F.lit(0.0)).otherwise(v)

    f = b.select(
        "*",
        flux(5, 1, 4000, 1.0).alias("efiITG_GB"),
        flux(5, 31, 3000).alias("efeITG_GB"),
        flux(7, 17, 2500).alias("efeTEM_GB"),
        flux(7, 13, 2000).alias("efiTEM_GB"),
        flux(3, 11, 1500).alias("efeETG_GB"),
        flux(5, 19, 900, 4.5).alias("pfeITG_GB"),
        flux(7, 23, 900, 4.5).alias("pfeTEM_GB"),
        ((c % 250).cast("double") / 1e2 + 0.4).alias("absambi"),
        ((c * 3) % 60).cast("double").alias("cke"),
        (((c * 5) % 60).cast("double") - 30.0).alias("cki"),
        (c % 5 != 0).alias("ITG"), (c % 7 != 0).alias("TEM"), (c % 3 != 0).alias("ETG"),
    )
    return f.select("*", (F.col("efeITG_GB") + F.col("efeTEM_GB") + F.col("efeETG_GB")).alias("efe_GB"),
                    (F.col("efiITG_GB") + F.col("efiTEM_GB")).alias("efi_GB"))


def bridge_input(bridge: DataFrame, features=None) -> DataFrame:
    """The ``input`` half of the dataset triple: ``dimx`` + features."""
    return bridge.select("dimx", *(features or FEATURES))


def bridge_data(bridge: DataFrame) -> DataFrame:
    """The ``data`` half: ``dimx`` + every target, check and flag column."""
    keep = [c for c in bridge.columns if c not in set(FEATURES) | {"scan_id", "c"}]
    return bridge.select(*keep)
