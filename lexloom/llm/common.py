"""Registry of the subpackage, word patterns, and row numbers without one big task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.session import write_and_read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def stored_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``: 0, 1, 2, ... over its rows, the same in every job that reads it.

    A row is named by its file and its place in it, not by the partition that a job
    happens to read it in: Spark may cut the same files otherwise for the next job.
    Anything but rows picked from parquet files is written once, and numbered there.
    """
    if not _picks_from_files(docs):
        docs = write_and_read(docs, "numbered")
    place = docs.metadataColumn("_metadata")
    placed = docs.withColumn("__file", place["file_path"]).withColumn("__at", place["row_index"])
    # One row for each file of the table; no column of it is read.
    sizes = placed.groupBy("__file").agg((F.max("__at") + 1).alias("n")).collect()
    bases, base = [], 0
    for file, n in sorted(map(tuple, sizes)):
        bases.append((file, base))
        base += n
    given = docs.sparkSession.createDataFrame(bases, "__file string, __base bigint")
    numbered = placed.join(F.broadcast(given), "__file").withColumn("__row", F.col("__base") + F.col("__at"))
    return numbered.drop("__file", "__at", "__base")


def named_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``docs`` with columns named by their place, the new name of each column, and the columns
    as they were: whatever names a table has, they do not meet those of an operator."""
    apart = docs.toDF(*[f"__column{i}" for i in range(len(docs.columns))])
    names = dict(zip(docs.columns, apart.columns))
    return apart, names, [F.col(new).alias(old) for old, new in names.items()]


def _picks_from_files(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of parquet files, or columns and rows picked from one by fixed rules."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation") and not plan.nodeName().startswith("Relation"):
        return False
    try:
        df.select(df.metadataColumn("_metadata")["row_index"]).schema
    except AnalysisException:  # no files, or not of parquet
        return False
    return True


def place_rows(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``__part`` and ``__index``: dealt by range of ``order_by``, nulls first, and sorted.

    Rows that are equal in ``order_by`` are told apart by their place in the input, so
    that a key that many rows share is split over partitions.  The placed rows are
    written to the shared folder before anything is read from them, so that a task
    that runs again gives the same places.
    """
    placed = (
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(*order_by, "__tie")
        .sortWithinPartitions(*order_by, "__tie")
        .withColumn("__place", F.monotonically_increasing_id())
        .select(
            *df.columns,
            F.shiftright("__place", 33).alias("__part"),
            F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)).alias("__index"),
        )
    )
    return write_and_read(placed, name)


def part_bases(placed: DataFrame, amount: Column, out: str) -> DataFrame:
    """``__part`` and the sum of ``amount`` over all partitions before it: one row for each partition."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    return sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("bigint").alias(out))


def number_rows(df: DataFrame, order_by: Sequence[str], out: str, name: str = "numbered") -> DataFrame:
    """``out``: 0, 1, 2, ... over all rows in the order of ``order_by``, nulls first."""
    placed = place_rows(df, order_by, name)
    bases = part_bases(placed, F.lit(1), "__base")
    # As many rows as partitions were written.
    numbered = placed.join(F.broadcast(bases), "__part")
    return numbered.select(*df.columns, (F.col("__base") + F.col("__index")).alias(out))


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage of the shared folder that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
