"""Session construction and small shared helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry") -> SparkSession:
    """Build (or reuse) a session with the settings every job here relies on.

    On a cluster the master, memory and partition counts come from the
    submitter; locally we default to all cores and a partition count near the
    core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # cp932 / euc_jp report files need the JDK charsets (Spark 4 blocks
        # them unless this legacy flag is on).
        .config("spark.sql.legacy.javaCharsets", "true")
        # written element tables / checkpoints are removed once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the Python workers of this context.

    Stages that run Python inside tasks (HTML parsing, charset trial
    decoding, the page-change state) pickle functions of this package by
    reference, so the executors need the package: it is zipped once per
    driver process and added with ``addPyFile`` (Spark ships it to every
    executor, including replacements of lost ones).
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator to shared storage, and a missing
    setting is an error: a folder of one machine would lose the data. Only
    a local master (tests) gets a scratch folder, and then only for this
    context (the setting itself cannot change at runtime).
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if conf_dir and not current:
        sc.setCheckpointDir(conf_dir)
        current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return conf_dir or current


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bytes(size: str) -> int:
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", size.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 128 << 20


def spread(df: DataFrame, *keys: str, per_core: int = 1) -> DataFrame:
    """Hash-spread a CPU-heavy input over the cluster's cores when it is
    smaller than one scan split per core (small files hold a single row
    group and cannot be split by the scan). Larger inputs already have more
    splits than cores and are left as they are (no shuffle). The size is the
    optimizer's estimate from file metadata, so no job runs here; where rows are built
    wider than that estimate, ``per_core`` partitions a core keep each task short.
    """
    if df.isStreaming:
        return df  # micro-batches are sized by the source options
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")):
        return df
    return df.repartition(cores * per_core, *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and
    continue from the written copy: expensive stages (Python parsing) that
    several branches of a plan consume run once, each branch reads only the
    columns it needs, and the lineage is cut so a lost executor does not send
    the job back to the raw input."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quarry-tables/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
