"""Applying a stream of inserts, updates and deletes (problem 4).

The log is a stream. Keyed state holds, for each document, its newest record: payload, place in the
log, whether it is a tombstone, and the time of the micro-batch that brought it. Only a record of a
later place replaces it, so repeated and late records change nothing. Each micro-batch writes the
documents whose state it changed, and no others, as upserts into a folder named by the batch,
overwriting what an earlier try of the same batch left. The current table is the newest version of
each document; ``compact`` merges the versions of many batches into a base.

The state is a streaming aggregation, so the records of one document are reduced where they are
read before any exchange: a document with a third of all records sends one row a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_path
from .ingest import read_stream

# Spellings of the two kinds of record, trimmed and in upper case.
ADD = ("ADD", "0")
DELETE = ("DELETE", "1")

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _deleted(kind: Column) -> Column:
    """False for an ADD, true for a DELETE, null for anything else."""
    name = F.upper(F.regexp_replace(kind, r"^\s+|\s+$", ""))
    return F.when(name.isin(*ADD), False).when(name.isin(*DELETE), True)


def newest(records: DataFrame) -> DataFrame:
    """``document_id, last``: the newest record of each document, batch or stream.

    Records without a document or of an unknown kind are ignored. Place is (generation, seq); a
    null place is before all others. Two different records of one place should not exist; then a
    DELETE wins, then the greater title and text, so the result does not depend on the order.
    A null title or text of an ADD is the empty string; a DELETE keeps none.
    """
    deleted = _deleted(F.col("kind"))
    gone = F.when(deleted, F.lit(""))
    last = F.struct(
        F.col("generation").cast("int").alias("generation"),
        F.col("seq").cast("long").alias("seq"),
        deleted.alias("deleted"),
        F.coalesce(gone, F.col("title"), F.lit("")).alias("title"),
        F.coalesce(gone, F.col("text"), F.lit("")).alias("text"),
        # of equal records the one that came first stays, so a repeated one changes nothing
        (-F.unix_micros(F.current_timestamp())).alias("came"),
    )
    rows = records.where(F.col("document_id").isNotNull() & deleted.isNotNull()).select(F.col("document_id").cast("long").alias("document_id"), last.alias("last"))
    return rows.groupBy("document_id").agg(F.max("last").alias("last"))


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the finished folders ``<name>=<number>`` under a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


_VERSION = "document_id long, generation int, seq long, deleted boolean, title string, text string, came long"


def _versions(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The newest base and the batches after it."""
    bases = _folders(spark, f"{out}/bases", "base")
    base = bases[-1] if bases else -1
    batches = [n for n in _folders(spark, f"{out}/versions", "batch") if n > base and (before is None or n < before)]
    paths = [f"{out}/bases/base={base}"] * bool(bases) + [f"{out}/versions/batch={n}" for n in batches]
    return spark.read.schema(_VERSION).parquet(*paths) if paths else spark.createDataFrame([], _VERSION)


def apply_changes(spark: SparkSession, log: str, out: str, files_per_batch: int = 64, batches: int = 32) -> str:
    """Runs all of the log that is there, from where an earlier run with the same ``out`` ended,
    and returns ``out``. ``log`` is a Parquet file or folder. More than ``batches`` batches since the
    last base are compacted. The session's settings stay as they are."""
    own = spark.newSession()
    own.conf.set(_STORE, _ROCKS)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    stream = read_stream(own, log, files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        # records that were there before this batch came came earlier
        earlier = _versions(spark, out, before=number).agg(F.min("came")).first()[0]
        rows = batch.select("document_id", "last.*")
        if earlier is not None:
            rows = rows.where(F.col("came") < earlier)
        rows.write.mode("overwrite").parquet(f"{out}/versions/batch={number}")

    newest(stream).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if len(_folders(spark, f"{out}/versions", "batch")) > batches:
        compact(spark, out)
    return out


def _latest(rows: DataFrame) -> DataFrame:
    place = F.struct("generation", "seq", "deleted", "title", "text", "came").alias("last")
    return rows.select("document_id", place).groupBy("document_id").agg(F.max("last").alias("last")).select("document_id", "last.*")


def compact(spark: SparkSession, out: str) -> None:
    """Merges all versions into one of each document, tombstones too, as a base named by the last
    batch in it, and then removes what the base replaces. A base that was not finished is not read."""
    done = _folders(spark, f"{out}/versions", "batch")
    if not done:
        return
    last, bases = done[-1], _folders(spark, f"{out}/bases", "base")
    if not bases or bases[-1] < last:
        _latest(_versions(spark, out)).write.mode("overwrite").parquet(f"{out}/bases/base={last}")
    old = [f"{out}/versions/batch={n}" for n in done if n <= last] + [f"{out}/bases/base={n}" for n in bases if n < last]
    for path in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def current(spark: SparkSession, out: str) -> DataFrame:
    """``document_id, generation, seq, title, text`` of each live document. Without any version the
    table is empty."""
    return _latest(_versions(spark, out)).where("NOT deleted").select("document_id", "generation", "seq", "title", "text")


def rebuilt(spark: SparkSession, log: str, files_per_batch: int = 64) -> DataFrame:
    """The current documents after the whole log, by a run of its own."""
    out = shared_path(spark, f"changes-{uuid.uuid4().hex}")
    return current(spark, apply_changes(spark, log, out, files_per_batch))
