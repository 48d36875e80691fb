"""Cleaning of a stream of documents.

Projection, cleaning and length filters are plain column expressions, so they
hold for a streaming table as they do for a batch; the checkpoint of the sink
carries the progress over lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions.text import clean_text


def read_documents(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def clean_stream(df: DataFrame, key: str, text: str = "text", mask_first: bool = False) -> DataFrame:
    return df.select(key, clean_text(F.col(text), mask_first).alias(text))


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
