"""Scans, stages and the tokenizer's tables, as checkable queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import clean_text
from lexloom.plans import sql
from lexloom.plans.registry import query, spread, table
from lexloom.session import new_stage_path
from lexloom.sources import readers, stages

TEXT_TABLES = ("documents", "conversations", "benchmark")


@query(
    "multi_file_scan",
    """select text from documents union all select text from conversations
       union all select text from benchmark""",
)
def multi_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    return readers.read_parquet(spark, [f"{folder}/{t}.parquet" for t in TEXT_TABLES], "text string")


@query(
    "text_line_scan",
    """select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents)
       group by line""",
)
def text_line_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = new_stage_path(spark, "lines")
    table(spark, folder, "documents").select("text").write.option("lineSep", "\n").text(path)
    lines = readers.read_lines(spark, path)
    return lines.groupBy(F.col("text").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("pattern_scan", "select count(*) as n_rows, sum(n_chars)::bigint as n_chars from documents")
def pattern_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = readers.read_subset(spark, folder, "doc*.parquet")
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query(
    "recursive_scan",
    "select lang as folder, count(*) as n_rows, sum(n_chars)::bigint as n_chars from documents group by lang",
)
def recursive_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written to one folder for each language, read back as one flat folder."""
    path = new_stage_path(spark, "folders")
    table(spark, folder, "documents").withColumn("name", F.col("lang")).write.partitionBy("name").parquet(path)
    found = readers.read_recursive(spark, path)
    named = found.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "name=([^/]*)/[^/]*$", 1))
    return named.groupBy("folder").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query(
    "rows_from_lists",
    """select doc_id, nth, part, size from (
         select doc_id, unnest(range(len(p))) as nth, unnest(p) as part,
                unnest(list_transform(p, lambda x: length(x))) as size
         from (select doc_id, string_split(text, chr(10)) as p from documents))""",
)
def rows_from_lists(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "documents").select("doc_id", F.split("text", "\n").alias("part"))
    listed = parts.withColumn("size", F.transform("part", lambda x: F.length(x).cast("bigint")))
    return readers.rows_from_lists(listed, ["doc_id"], ["part", "size"]).withColumn("nth", F.col("nth").cast("bigint"))


@query("cached_stage", f"select doc_id, {sql.clean('text')} as text from documents")
def cached_stage(spark: SparkSession, folder: str) -> DataFrame:
    path = new_stage_path(spark, "cleaned")

    def build() -> DataFrame:
        docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
        return docs.select("doc_id", clean_text(F.col("text")).alias("text"))

    stages.cached_stage(spark, path, build)
    return stages.cached_stage(spark, path, build)


@query("split_pick", "select doc_id, quality, toxic from labels where quality = 1")
def split_pick(spark: SparkSession, folder: str) -> DataFrame:
    return readers.pick_split(table(spark, folder, "labels"), "quality", 1)
