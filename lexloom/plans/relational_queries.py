"""Projection, filter, limit, shard and batch assignment, as checkable queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import relational as rel
from lexloom.operators.position import with_row_position, with_source_position
from lexloom.plans import sql
from lexloom.plans.registry import query, table

SHARDS, BATCH = 4, 60

WORDS_SQL = "select doc_id, string_split(text, ' ') as words from documents"


def words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.split("text", " ").alias("words"))


def batched(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return rel.assign_batches(docs, "doc_id", SHARDS, BATCH)


@query("keep_text", "select doc_id, text from documents")
def keep_text(spark: SparkSession, folder: str) -> DataFrame:
    return rel.keep_text(table(spark, folder, "documents"), key="doc_id")


@query("drop_columns", "select doc_id, lang, source from documents")
def drop_columns(spark: SparkSession, folder: str) -> DataFrame:
    return rel.drop_columns(table(spark, folder, "documents"), ["text", "n_chars"])


@query(
    "keep_allowed_columns",
    "select doc_id, text, 'lang,n_chars,source' as ignored from documents",
)
def keep_allowed_columns(spark: SparkSession, folder: str) -> DataFrame:
    kept, ignored = rel.keep_allowed(table(spark, folder, "documents"), ["text", "doc_id", "labels"])
    return kept.withColumn("ignored", F.lit(",".join(sorted(ignored))))


@query("min_length_filter", f"select doc_id, len(words)::bigint as n from ({WORDS_SQL}) where len(words) >= 300")
def min_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = rel.min_length(words(spark, folder), "words", 300)
    return kept.select("doc_id", F.size("words").cast("bigint").alias("n"))


@query("head_limit", "select doc_id, text from documents order by doc_id limit 100")
def head_limit(spark: SparkSession, folder: str) -> DataFrame:
    return rel.head(table(spark, folder, "documents").select("doc_id", "text"), 100, "doc_id")


@query(
    "head_limit_ties",
    """select k, doc_id, text from (
      select case when doc_id % 7 = 0 then null else lang end as k, doc_id, text from documents)
    order by k nulls first, doc_id limit 300""",
)
def head_limit_ties(spark: SparkSession, folder: str) -> DataFrame:
    """A key that many rows share and some lack: the tied rows are taken by their other columns."""
    lang = F.when(F.col("doc_id") % 7 != 0, F.col("lang"))
    return rel.head(table(spark, folder, "documents").select(lang.alias("k"), "doc_id", "text"), 300, "k")


STRING_KEY = "concat('document-', lpad(cast(doc_id * 7919 % 1000003 as varchar(20)), 12, '0'))"


@query("head_limit_string", f"select {STRING_KEY} as k, text from documents order by k limit 150")
def head_limit_string(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.expr(STRING_KEY).alias("k"), "text")
    return rel.head(docs, 150, "k")


LINE_KEY = "concat('order-', lpad(cast(l_orderkey as varchar(20)), 12, '0'), '-line-', cast(l_linenumber as varchar(20)))"


@query(
    "string_key_position",
    f"select k, row_number() over (order by k) - 1 as pos from (select {LINE_KEY} as k from lineitem)",
)
def string_key_position(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that share their first characters."""
    return with_row_position(table(spark, folder, "lineitem").select(F.expr(LINE_KEY).alias("k")), "k")


@query(
    "source_order_batches",
    f"""with turns as (select row_number() over () - 1 as row_no, text from conversations),
{sql.batches('turns', 'row_no', SHARDS, BATCH)}
select row_no, text, shard::bigint as shard, batch_id, pos_in_batch from batched""",
)
def source_order_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A table without a unique key, batched in the order of its files: no row is moved."""
    turns = with_source_position(table(spark, folder, "conversations").select("text"))
    rows = rel.assign_batches(turns, None, SHARDS, BATCH, pos="row_no")
    return rows.select("row_no", "text", *[F.col(c).cast("bigint").alias(c) for c in ("shard", "batch_id", "pos_in_batch")])


@query(
    "shard_and_batch",
    f"""with {sql.batches('documents', 'doc_id', SHARDS, BATCH)}
        select doc_id, shard::bigint as shard, batch_id, pos_in_batch,
               count(*) over (partition by batch_id) as batch_rows from batched""",
)
def shard_and_batch(spark: SparkSession, folder: str) -> DataFrame:
    out = batched(spark, folder)
    return out.select("doc_id", *[F.col(c).cast("bigint") for c in ("shard", "batch_id", "pos_in_batch", "batch_rows")])


@query(
    "drop_partial_batches",
    f"""with {sql.batches('documents', 'doc_id', SHARDS, BATCH)}
        select doc_id, batch_id from batched
        qualify count(*) over (partition by shard, batch_id) = {BATCH}""",
)
def drop_partial_batches(spark: SparkSession, folder: str) -> DataFrame:
    return rel.drop_partial_batches(batched(spark, folder), BATCH).select("doc_id", "batch_id")


@query(
    "required_columns",
    """select unnest(['text', 'lang', 'lines']) as column_name, unnest([count(*), count(*), count(*)]) as n_rows,
              unnest([count(*) - count(text), count(*) - count(lang), 0]) as n_null,
              unnest([0, 0, count(*) filter (where not contains(text, chr(10)))]) as n_empty
       from documents""",
)
def required_columns(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("text", "lang")
    # The lines after the first: empty for a text of one line.
    docs = docs.withColumn("lines", F.split("text", "\n"))
    docs = docs.withColumn("lines", F.slice("lines", 2, F.size("lines")))
    return rel.required_columns_report(docs, ["text", "lang", "lines"])


@query("row_count", "select count(*) as n_rows from documents")
def row_count(spark: SparkSession, folder: str) -> DataFrame:
    return rel.count_rows(table(spark, folder, "documents"))


@query("sequence_lengths", f"select doc_id, len(words)::bigint as length from ({WORDS_SQL})")
def sequence_lengths(spark: SparkSession, folder: str) -> DataFrame:
    out = rel.with_length(words(spark, folder), "words")
    return out.select("doc_id", F.col("length").cast("bigint").alias("length"))


@query(
    "longest_in_batch",
    f"""with {sql.batches('documents', 'doc_id', SHARDS, BATCH)}
        select batch_id, max(len(string_split(text, ' ')))::bigint as longest from batched group by batch_id""",
)
def longest_in_batch(spark: SparkSession, folder: str) -> DataFrame:
    docs = rel.assign_batches(words(spark, folder), "doc_id", SHARDS, BATCH)
    out = rel.longest_per_batch(docs, "words")
    return out.select("batch_id", F.col("longest").cast("bigint").alias("longest"))


@query(
    "bin_totals",
    f"""with {sql.batches('documents', 'doc_id', SHARDS, BATCH)}
        select batch_id, pos_in_batch % 7 as bin, sum(n_chars)::bigint as total from batched group by all""",
)
def bin_totals(spark: SparkSession, folder: str) -> DataFrame:
    binned = batched(spark, folder).withColumn("bin", (F.col("pos_in_batch") % 7).cast("bigint"))
    return rel.bin_totals(binned, "n_chars")
