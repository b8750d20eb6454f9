"""Input tables and the cutting of lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table, dealt out over the cores where its files would leave more than half of them
    idle, as a table of one small file does. Anything larger stays as it is scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def one_machine(spark: SparkSession) -> bool:
    """Whether all executors are threads of this process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one. Only in
    local runs and tests a temporary folder is made where it is unset; on a cluster that raises,
    for no folder of one machine would do."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        defined = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = defined.get() if defined.isDefined() else None
    if not known:
        if not one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillon-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that later stages neither recompute them nor
    lose them with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path in the part of the shared folder that belongs to this application."""
    return "/".join([shared_dir(spark).rstrip("/"), f"quillon-{spark.sparkContext.applicationId}", *parts])


def release(spark: SparkSession) -> None:
    """Removes all this application kept in the shared folder: kept tables, stores, logs. Call it
    when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """A file: URI or plain path as a plain path."""
    return os.path.normpath(path.removeprefix("file://").removeprefix("file:"))


def keep(df: DataFrame) -> DataFrame:
    """The same rows, as a compressed columnar table in the shared folder: for wide rows of which
    later stages read different columns."""
    path = shared_path(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Removes a kept table no later stage reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def signature(spark: SparkSession, path: str) -> tuple:
    """What changes when a table's files do: how many, how large, how new."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ()
    files = [s for s in fs.listStatus(at) if s.isFile()]
    return (len(files), sum(s.getLen() for s in files), max((s.getModificationTime() for s in files), default=0))
