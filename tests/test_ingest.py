from quillon.operators.store import SegmentStore
from quillon.streaming.ingest import ingest

SCHEMA = "doc_id long, title string, text string"


def test_stream_into_a_store(spark, tmp_path):
    source, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    spark.createDataFrame([(1, "a", "old words"), (2, "b", "two")], SCHEMA).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    ingest(stream(), store, state).awaitTermination()
    spark.createDataFrame([(1, "a", "new words"), (3, None, "three")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    ingest(stream(), store, state).awaitTermination()
    opened = SegmentStore(spark, store).open()
    assert {tuple(r) for r in opened.docs.collect()} == {(1, "a", "new words"), (2, "b", "two"), (3, "", "three")}
    assert opened.document_frequency("old") == 0 and opened.document_frequency("new") == 1
