from pyspark.sql import functions as F

from lexloom.functions.text import clean_text
from lexloom.session import new_stage_path
from lexloom.streaming.cleaning import clean_stream, read_documents, write_stream


def test_stream_equals_batch(spark, small):
    out, state = new_stage_path(spark, "stream"), new_stage_path(spark, "stream-state")
    docs = read_documents(spark, small, "doc_id bigint, text string", "documents.parquet")
    assert docs.isStreaming
    query = write_stream(clean_stream(docs, "doc_id"), out, state)
    query.awaitTermination(120)
    batch = spark.read.parquet(f"{small}/documents.parquet")
    expected = batch.select("doc_id", clean_text(F.col("text")).alias("text"))
    assert spark.read.parquet(out).exceptAll(expected).count() == 0
    assert spark.read.parquet(out).count() == batch.count()
