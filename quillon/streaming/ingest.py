"""Streams of Parquet files, and feeding a segment store from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import SegmentStore


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The files of a Parquet table, one file or a folder, as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Upserts each micro-batch of ``doc_id, title, text`` as one segment, and returns the query.
    Repeating a batch after a failure upserts the same documents again, which changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        SegmentStore(batch.sparkSession, path).upsert(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
