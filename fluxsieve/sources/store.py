"""Dataset stores (2.A) as folders of Parquet tables.

Layout of a store at ``path`` (group names as in the original HDF5 stores)::

    path/input/        dimx + features
    path/flattened/    dimx + every target, one wide table
    path/output/       long form (dimx, value) partitioned by name=<target>  (separate columns)
    path/constants/    (name, value) strings
    path/filter/<f>/   ids removed by a stored filter
    path/manifest/     (kind, name, folder, rows, type): one row per stored column, constants table, ...

The manifest says what is stored, so a store is opened without listing its files; a store of
other origin has none, and then one level of folder names is listed.

The wide table is preferred on load whenever it exists (Parquet column pruning makes
reading a few columns of it as cheap as reading separate files); the separate
long form is pivoted back only when the wide table is absent.
"""

from __future__ import annotations

import json
import os
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N


class Dataset(NamedTuple):
    input: DataFrame | None
    data: DataFrame | None
    const: DataFrame | None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _group(path: str, prefix: str, group: str) -> str:
    return os.path.join(path, prefix.strip("/"), group) if prefix.strip("/") else os.path.join(path, group)


def separate_long(data: DataFrame, columns=None, key: str = "dimx", dropna: bool = True) -> DataFrame:
    """A-14 core: one ``(key, name, value)`` row per stored value (nulls dropped), in one pass."""
    cols = columns if columns is not None else [c for c in data.columns if c != key]
    long = data.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(key, cols, "name", "value")
    return long.filter(F.col("value").isNotNull()) if dropna else long


MANIFEST = "kind string, name string, folder string, rows bigint, type string"


def _folder_of(name: str) -> str:
    """Folder of a separately stored column, as a partitioned write names it."""
    return f"output/name={name}"


def write_manifest(spark: SparkSession, path: str, rows, prefix: str = "") -> None:
    """Replace the manifest rows of the kinds in ``rows``; one small file."""
    old = [] if not _exists(spark, _group(path, prefix, "manifest")) else read_manifest(spark, path, prefix).collect()
    kinds = {r[0] for r in rows}
    kept = [tuple(r) for r in old if r["kind"] not in kinds]               # one row per stored column: as wide as a schema
    spark.createDataFrame([*kept, *rows], MANIFEST).coalesce(1).write.mode("overwrite").parquet(_group(path, prefix, "manifest"))


def read_manifest(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``kind, name, folder, rows, type`` of everything a store holds."""
    return spark.read.schema(MANIFEST).parquet(_group(path, prefix, "manifest"))


def save_dataset(ds: Dataset, path: str, style: str = "both", prefix: str = "", key: str = "dimx",
                 save_flux: bool = True, save_growth: bool = True, save_all: bool = True) -> None:
    """A-13 / A-14 / A-16: write input, outputs (wide and / or separate) and constants (zstd Parquet), and the manifest."""
    w = lambda df: df.write.mode("overwrite").option("compression", "zstd")
    spark = next(d for d in ds if d is not None).sparkSession
    rows: list[tuple] = []

    def stored(kind, df, folder=None):
        cols = [c for c in df.columns if c != key]
        n = df.agg(*[F.count(c).alias(c) for c in cols]).first() if cols else {}
        rows.extend((kind, c, folder or _folder_of(c), n[c], t) for c, t in df.dtypes if c != key)

    if ds.input is not None:
        w(ds.input).parquet(_group(path, prefix, "input"))
        stored("input", spark.read.parquet(_group(path, prefix, "input")), "input")
    if ds.data is not None:
        if style in ("both", "flat"):
            w(ds.data).parquet(_group(path, prefix, "flattened"))
            stored("flattened", spark.read.parquet(_group(path, prefix, "flattened")), "flattened")
        if style in ("both", "sep"):
            cols = [c for c in ds.data.columns if c != key and (
                save_all or (save_flux and N.is_transport(c)) or (save_growth and N.is_growth(c)))]
            w(separate_long(ds.data, cols, key)).partitionBy("name").parquet(_group(path, prefix, "output"))
            counts = dict(spark.read.parquet(_group(path, prefix, "output")).groupBy("name").count().collect())
            rows += [("output", c, _folder_of(c), counts[c], "double") for c in cols if c in counts]
    if ds.const is not None:
        w(ds.const.select(F.col("name").cast("string"), F.col("value").cast("string"))).parquet(
            _group(path, prefix, "constants"))
        rows.append(("constants", "constants", "constants", None, "string"))
    write_manifest(spark, path, rows, prefix)


def column_map(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """A-04: names stored as separate columns, from the manifest (without one: from the folder names, no file being listed)."""
    if _exists(spark, _group(path, prefix, "manifest")):
        return sorted(r[0] for r in read_manifest(spark, path, prefix).filter("kind = 'output'").select("name").collect())
    out = _group(path, prefix, "output")
    if not _exists(spark, out):
        return []
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(out)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = (f.getPath().getName() for f in found)
    return sorted(n.removeprefix("name=") for n in names if n.startswith("name="))


def filter_column_map(stored: list[str], columns) -> list[str]:
    """A-05: requested names that are stored, in stored order."""
    want = set(columns)
    return [c for c in stored if c in want]


def load_dataset(spark: SparkSession, path: str, columns=None, mode: str = "bare", how: str = "left",
                 load_input: bool = True, load_const: bool = True, prefix: str = "", key: str = "dimx",
                 nustar_to_lognustar: bool = True, prefer_flat: bool = True) -> Dataset:
    """A-02 / A-03 / A-06..A-12: read (input, data, const).

    ``columns``: None = every target (A-03 ``return_all``), False = ids only (``return_no``),
    a string or list = those targets (a missing one is an error).  ``mode`` for separate
    columns: ``bare`` (reindex to the input ids; first column must match them exactly),
    ``concat`` (full outer), ``join`` / ``merge`` (``how``), ``assign`` (left on the first
    column's ids), ``update`` (fill, error on conflicting overlaps).
    """
    from ..operators.derive import convert_nustar
    if isinstance(columns, str):
        columns = [columns]
    inp = spark.read.parquet(_group(path, prefix, "input")) if load_input else None
    if inp is not None and nustar_to_lognustar and "Nustar" in inp.columns:
        inp = convert_nustar(inp)
    const = None
    if load_const:
        cpath = _group(path, prefix, "constants")
        const = spark.read.parquet(cpath) if _exists(spark, cpath) else None
    flat_path = _group(path, prefix, "flattened")
    has_flat = _exists(spark, flat_path)
    if columns is False:
        base = inp if inp is not None else spark.read.parquet(flat_path)
        return Dataset(inp, base.select(key), const)
    stored = column_map(spark, path, prefix)
    if has_flat and (prefer_flat or columns is None or any(c not in stored for c in columns)):
        flat = spark.read.parquet(flat_path)
        if columns is not None:
            missing = [c for c in columns if c not in flat.columns]
            if missing:
                raise KeyError(f"columns not in store: {missing}")
            flat = flat.select(key, *columns)
        return Dataset(inp, flat, const)
    cols = stored if columns is None else columns
    missing = [c for c in cols if c not in stored]
    if missing:
        raise KeyError(f"columns not in store: {missing}")
    out = _group(path, prefix, "output")
    # the folders of the wanted columns only
    long = spark.read.option("basePath", out).parquet(*[_group(path, prefix, _folder_of(c)) for c in cols])
    per_col = {c: long.filter(F.col("name") == c).select(key, F.col("value").alias(c)) for c in cols}
    return Dataset(inp, assemble(per_col, cols, mode, how, inp, key), const)


def assemble(per_col: dict[str, DataFrame], cols, mode: str, how: str, inp: DataFrame | None,
             key: str = "dimx") -> DataFrame:
    """A-06..A-10: glue separate columns into one frame."""
    if mode == "concat":
        # one shuffle for all columns: union the long forms and pivot, instead of n-way full joins
        long = reduce(lambda a, b: a.unionByName(b),
                      [df.select(key, F.lit(c).alias("__n"), F.col(c).alias("__v")) for c, df in per_col.items()])
        return long.groupBy(key).pivot("__n", list(cols)).agg(F.first("__v"))
    if mode in ("join", "merge"):
        return reduce(lambda a, b: a.join(b, key, how), [per_col[c] for c in cols])
    if mode == "assign":
        return reduce(lambda a, b: a.join(b, key, "left"), [per_col[c] for c in cols])
    if mode == "update":
        return reduce(lambda a, b: update_frames(a, b, key), [per_col[c] for c in cols])
    if mode == "bare":
        if inp is None:
            raise ValueError("mode 'bare' needs the input ids (load_input=True)")
        ids = inp.select(key)
        first = per_col[cols[0]]
        one_sided = first.select(key).exceptAll(ids).unionAll(ids.exceptAll(first.select(key)))
        if not one_sided.isEmpty():
            raise ValueError(f"the ids of {cols[0]} and of the input differ")
        return reduce(lambda a, b: a.join(b, key, "left"), [per_col[c] for c in cols], ids)
    raise ValueError(f"unknown mode {mode!r}")


def update_frames(base: DataFrame, other: DataFrame, key: str = "dimx") -> DataFrame:
    """A-09: fill ``base`` with ``other`` on the same columns; conflicting non-null overlaps raise."""
    cols = [c for c in other.columns if c != key]
    j = base.join(other.select(key, *[F.col(c).alias(f"__o_{c}") for c in cols]), key, "full")
    shared = [c for c in cols if c in base.columns]
    clash = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & F.col(f"__o_{c}").isNotNull()
                                        & (F.col(c) != F.col(f"__o_{c}")) for c in shared], F.lit(False))
    if shared and j.filter(clash).limit(1).count():
        raise ValueError("update would overwrite existing values")
    return j.select(key, *[F.coalesce(F.col(c), F.col(f"__o_{c}")).alias(c) if c in cols else F.col(c)
                           for c in base.columns if c != key],
                    *[F.col(f"__o_{c}").alias(c) for c in cols if c not in base.columns])


def put_column(df: DataFrame, name: str, col_df: DataFrame, key: str = "dimx") -> DataFrame:
    """A-15: add one column aligned on the id."""
    return df.join(col_df.select(key, F.col(col_df.columns[-1]).alias(name)), key, "left")


# fixed value: the dataset naming grammar
DATASET_NAME = r"^(unstable_)?(?:(sane|test|training)_)?gen(\d+)_(\d+)D_(.*)_filter(\d+)(?:\.\w+)?$"


def parse_dataset_name(col):
    """A-17 as columns: unstable flag, set, generation, dimension, dataset id, filter id."""
    pat = DATASET_NAME
    return {
        "unstable": F.regexp_extract(col, pat, 1) != "",
        "set": F.regexp_extract(col, pat, 2),
        "gen": F.regexp_extract(col, pat, 3).cast("int"),
        "dim": F.regexp_extract(col, pat, 4).cast("int"),
        "dataset": F.regexp_extract(col, pat, 5),
        "filter_id": F.regexp_extract(col, pat, 6).cast("int"),
        "valid": col.rlike(pat),
    }


def dataset_name(gen: int, dim: int, dataset: str, filter_id: int, set_name: str = "", unstable: bool = False) -> str:
    """A-18: ``<unstable_><set_>gen<g>_<d>D_<dataset>_filter<n>``."""
    return f"{'unstable_' if unstable else ''}{set_name + '_' if set_name else ''}gen{gen}_{dim}D_{dataset}_filter{filter_id}"


def dataset_names(gen, dim, dataset, filter_id, set_name=None, unstable=None):
    """A-18 as a column, from columns."""
    first = F.lit("") if unstable is None else F.when(unstable, "unstable_").otherwise("")
    kind = F.lit("") if set_name is None else F.when(set_name != "", F.concat(set_name, F.lit("_"))).otherwise("")
    return F.concat(first, kind, F.lit("gen"), gen.cast("string"), F.lit("_"), dim.cast("string"), F.lit("D_"), dataset, F.lit("_filter"),
                    filter_id.cast("string"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """A-19: one row per settings JSON document."""
    return spark.read.option("multiLine", True).json(path)


#: The parts of a network document that describe it (its weights are read only to score).
NETWORK_SCHEMA = ("feature_names array<string>, target_names array<string>, hidden_activation array<string>, "
                  "output_activation string, prescale_factor map<string, double>, prescale_bias map<string, double>, "
                  "_metadata map<string, string>")


def network_documents(spark: SparkSession, path: str) -> DataFrame:
    """A-20: the ``*.json`` documents below a folder, one row each: ``file``, ``text`` and the described parts
    (missing where a document is no JSON object).  Spark lists and reads the files, so any store it can read will do."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    parsed = docs.select(F.input_file_name().alias("file"), F.col("value").alias("text"), F.from_json("value", NETWORK_SCHEMA).alias("d"))
    return parsed.select("file", "text", "d.*")


def read_network_folder(spark: SparkSession, path: str):
    """A-20: networks keyed by target, for scoring; every document must predict one target, and an empty
    folder is an error.  The networks come to the driver as objects, since a scoring job broadcasts them."""
    from ..operators.score import Network
    docs = network_documents(spark, path)
    bad = docs.filter(F.size("target_names") != 1).select("file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]}: a network of one target is expected")
    nets = {r["target_names"][0]: Network.from_dict(json.loads(r["text"])) for r in docs.select("target_names", "text").collect()}
    if not nets:
        raise FileNotFoundError(f"no networks in {path}")
    return nets


def export_csv(df: DataFrame, path: str) -> None:
    """A-21: a small report table as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def combine_input_threshold(inp: DataFrame, thresh: DataFrame, turb: str, key: str = "dimx") -> DataFrame:
    """A-22: input rows that have a threshold, with the threshold of the leading flux
    (``efi`` for ITG, else ``efe``)."""
    lead = "efi" if turb == "ITG" else "efe"
    return inp.join(thresh.select(key, F.col("thresh").alias(f"{lead}{turb}_thresh")), key, "inner")


def save_runs(runs: dict[str, DataFrame], base: str) -> None:
    """Run files ``base/<name>`` and their manifest (``type`` is the run's schema), so that gluing reads no file twice."""
    spark = next(iter(runs.values())).sparkSession
    for name, df in runs.items():
        df.write.mode("overwrite").parquet(os.path.join(base, name))
    write_manifest(spark, base, [("run", n, n, None, df.schema.json()) for n, df in runs.items()])


def glue_runs(spark: SparkSession, paths: list[str] | str, drop_columns=(), with_source: bool = False) -> DataFrame:
    """A-01: concatenate run files along the point dimension, dropping internal columns.

    ``paths``: run folders, or one folder with a manifest (:func:`save_runs`).  With a manifest runs of one schema are one scan,
    so the plan grows with the number of schemas, not of runs.
    """
    from pyspark.sql.types import StructType
    if isinstance(paths, str):
        by_schema: dict[str, list[str]] = {}
        for r in read_manifest(spark, paths).filter("kind = 'run'").orderBy("name").collect():
            by_schema.setdefault(r["type"], []).append(os.path.join(paths, r["folder"]))
        scans = [spark.read.schema(StructType.fromJson(json.loads(t))).parquet(*folders) for t, folders in by_schema.items()]
    else:
        scans = [spark.read.parquet(p) for p in paths]
    frames = []
    for df in scans:
        if with_source:
            df = df.withColumn("source_file", F.input_file_name())
        frames.append(df.drop(*[c for c in drop_columns if c in df.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def select_dims(df: DataFrame, dims, fmt: str | None = None) -> DataFrame:
    """A-24: features / targets chosen by a ``dims`` list; unknown formats warn."""
    import warnings
    if fmt and not re.match(r"^(parquet|csv|json|h5)$", fmt):
        warnings.warn(f"unknown format {fmt}")
    return df.select(*dims)
