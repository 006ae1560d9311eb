"""Spark session helpers. On a cluster the session is given; nothing here overrides its sizing."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wiretally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. ``master`` is for local runs and tests only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where none is set, a session
    that runs in one process gets a folder of its own; on a cluster that would lose files, so it
    is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wiretally-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def reliable(df: DataFrame) -> DataFrame:
    """Compute a small intermediate result once and keep it in the shared folder, so that several
    uses do not repeat the scan behind it and a lost executor loses nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def state_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's checkpoint or a table below the shared folder."""
    return os.path.join(checkpoint_root(spark), f"{name}-{os.urandom(6).hex()}")


#: Folders written by ``landed`` within each running ``landed_alone``.
_written: list[list[str]] = []


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut, a lost executor
    loses nothing, and the planner knows its size in bytes, so it broadcasts it only when it is small."""
    folder = state_folder(df.sparkSession, name)
    df.write.parquet(folder)
    if _written:
        _written[-1].append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def landed_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``landed(make(), name)``; the tables that ``make`` itself lands are removed once the result is written, because
    nothing depends on them any more. ``make`` must return nothing else that is read later."""
    _written.append([])
    try:
        result = landed(make(), name)
    finally:
        folders = _written.pop()
        for folder in folders[:-1]:
            remove(spark, folder)
    if _written:
        _written[-1] += folders[-1:]
    return result


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table of few, small files. A table of any size has far more splits than cores and
    passes unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_groups(table: DataFrame) -> DataFrame:
    """Deal a stored table's rows to all cores before heavy work on each of them. Tasks share a Parquet file by its row
    groups, and a file of 100 MB may be one: most of its splits then are empty. Splits are of full size, with a row group
    each, once a table has several per core; it passes unchanged then. For narrow tables, whose rows are cheap to move."""
    cores, splits = table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions()
    return table.repartition(max(cores, splits)) if splits < 4 * cores else table


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this job in whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
