"""Nested values and what workers do together, as checkable queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import nested
from lexloom.operators import workers
from lexloom.plans import sql
from lexloom.plans.packing_queries import joined, word_ids
from lexloom.plans.registry import query, table

WORKERS = 4


def nested_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Per document a struct of one list, one list of lists and a number."""
    docs = table(spark, folder, "documents")
    lines = F.split("text", "\n")
    value = F.struct(
        F.transform(lines, lambda x: F.length(x)).alias("lines"),
        F.struct(
            F.transform(lines, lambda x: F.transform(F.split(x, " "), lambda w: F.length(w))).alias("words")
        ).alias("inner"),
        F.col("n_chars").cast("int").alias("n_chars"),
    )
    return docs.select("doc_id", value.alias("value"))


NESTED_SQL = """nested as (
  select doc_id, n_chars, list_transform(string_split(text, chr(10)), lambda x: length(x)) as lines,
    list_transform(string_split(text, chr(10)), lambda x: list_transform(string_split(x, ' '), lambda w: length(w)))
      as words from documents)"""


@query(
    "flatten_leaves",
    f"""with {NESTED_SQL} select doc_id,
      array_to_string(list_concat(lines, flatten(words), [n_chars]), ',') as leaves from nested""",
)
def flatten_leaves(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested_lengths(spark, folder)
    return rows.select("doc_id", joined(nested.flatten_leaves(rows, "value", "bigint")).alias("leaves"))


@query(
    "map_leaves",
    f"""with {NESTED_SQL} select doc_id,
      array_to_string(list_transform(lines, lambda x: 2 * x + 1), ',') as lines,
      array_to_string(flatten(list_transform(words, lambda r: list_transform(r, lambda x: 2 * x + 1))), ',') as words,
      2 * n_chars + 1 as n_chars from nested""",
)
def map_leaves(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested_lengths(spark, folder)
    rows = rows.withColumn("value", nested.map_numbers(rows, "value", lambda x: 2 * x + 1))
    return rows.select(
        "doc_id",
        joined("value.lines").alias("lines"),
        joined(F.flatten("value.inner.words")).alias("words"),
        F.col("value.n_chars").cast("bigint").alias("n_chars"),
    )


@query(
    "describe_structure",
    f"""with {NESTED_SQL} select doc_id, unnest(['value.lines', 'value.inner.words', 'value.n_chars']) as path,
      unnest([len(lines)::varchar, len(words) || ',' || len(words[1]), '']) as shape, 'int' as dtype from nested""",
)
def describe_structure(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested_lengths(spark, folder)
    return rows.select("doc_id", F.inline(nested.describe_structure(rows, "value")))


@query(
    "slice_leaves",
    f"""with {NESTED_SQL} select doc_id, array_to_string(lines[2:4], ',') as lines,
      array_to_string(flatten(words[2:4]), ',') as words from nested""",
)
def slice_leaves(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested_lengths(spark, folder)
    rows = rows.withColumn("value", F.col("value").dropFields("n_chars"))
    rows = rows.withColumn("value", nested.slice_leaves(rows, "value", 1, 3))
    return rows.select(
        "doc_id", joined("value.lines").alias("lines"), joined(F.flatten("value.inner.words")).alias("words")
    )


@query(
    "shape_mismatch",
    """select doc_id % 4 as part, len(string_split(text, chr(10)))::varchar as shape, count(*) as n_values
       from documents group by all""",
)
def shape_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        (F.col("doc_id") % WORKERS).alias("part"), F.size(F.split("text", "\n")).cast("string").alias("shape")
    )
    return workers.shape_mismatch(docs, "part", "shape")


@query(
    "shape_match",
    """select vec_id % 4 as part, len(embedding)::varchar as shape, count(*) as n_values from embeddings
       where (select count(distinct len(embedding)) from embeddings) > 1 group by all""",
)
def shape_match(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of one length: nothing to report."""
    vectors = table(spark, folder, "embeddings").select(
        (F.col("vec_id") % WORKERS).alias("part"), F.size("embedding").cast("string").alias("shape")
    )
    return workers.shape_mismatch(vectors, "part", "shape")


@query("gather", f"with {sql.IDS} select doc_id, array_to_string(ids, ',') as ids from ids")
def gather(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's ids dealt to the workers in equal runs, then gathered."""
    docs = word_ids(spark, folder)
    per = F.ceil((F.size("ids") + 1) / WORKERS).cast("int")
    shares = F.transform(
        F.sequence(F.lit(0), F.lit(WORKERS - 1)),
        lambda r: F.struct(r.alias("rank"), F.slice("ids", r * per + 1, per).alias("ids")),
    )
    dealt = docs.select("doc_id", F.inline(shares))
    return workers.gather(dealt, "doc_id", "rank", "ids").select("doc_id", joined("ids").alias("ids"))


@query(
    "reduce_average",
    """select label, at_pos - 1 as nth, round(avg(v), 5) as value from (
         select label, unnest(embedding)::double as v, unnest(range(1, len(embedding) + 1)) as at_pos from embeddings)
       group by label, at_pos""",
)
def reduce_average(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    reduced = workers.reduce_elementwise(vectors, "label", "e")
    return reduced.select("label", F.posexplode("e").alias("nth", "value")).select(
        "label", F.col("nth").cast("bigint").alias("nth"), F.round("value", 5).alias("value")
    )


@query(
    "split_evenly",
    """select doc_id, (row_number() over (order by doc_id) - 1) // (count(*) over () // 4) as part from documents""",
)
def split_evenly(spark: SparkSession, folder: str) -> DataFrame:
    """Equal shares for any number of documents; those left over are a part of their own."""
    docs = table(spark, folder, "documents").select("doc_id")
    return workers.split_evenly(docs, "doc_id", WORKERS, remainder=True).select("doc_id", F.col("part").cast("bigint").alias("part"))
