"""Session helpers: a tuned local session for tests / bench and checkpoint handling."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "fluxsieve", shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    """Local session configured the way the library expects a cluster session to be.

    On a cluster the caller's session is used as it is; this only exists for tests
    and the benchmark.
    """
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS / object store) folder there; it is used as it is.  Only a
    ``local[...]`` session, whose tasks run in the driver's own process, may leave it unset (as tests
    do) and gets a scratch folder; on a cluster an unset folder is an error, since executors would
    each write to their own disk.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fluxsieve-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_CUTS: dict[str, list[str]] = {}


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table under the shared checkpoint folder and read it back.

    This cuts the lineage (iterative jobs keep a small plan, and a lost executor
    only costs re-reading files, not recomputing the history) and gives the
    optimizer real file sizes.  Never ``localCheckpoint``: executor-local blocks die
    with the executor.  :func:`drop_cut_tables` deletes the tables when a job has ended.
    ``compression`` names a codec in place of the session's own.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**({"compression": compression} if compression else {})).parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


def drop_cut_tables(spark: SparkSession) -> int:
    """Delete the tables that this application's :func:`cut_lineage` calls wrote; for the end of a job, when
    no DataFrame that reads them is used any more.  Returns how many there were."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers (once per application), so that tasks can import it
    wherever the session was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="fluxsieve-pkg-"), "fluxsieve.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
