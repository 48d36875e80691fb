"""Scans of corpus files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a file that is no data.
JUNK_FILES = (".DS_Store",)


def read_parquet(spark: SparkSession, paths: str | Sequence[str], columns: str | None = None) -> DataFrame:
    """Every file as one table.  ``columns`` (a DDL schema) reads only these from files
    that differ in their other columns."""
    reader = spark.read if columns is None else spark.read.schema(columns)
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def read_subset(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The tables of a folder whose names match ``pattern``, be they files or folders of files."""
    # A filter of file names would look at the names of the files inside a folder instead.
    return spark.read.parquet(f"{folder.rstrip('/')}/{pattern}")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per line of one or more text files: ``text``."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("lineSep", "\n").text(listed).withColumnRenamed("value", "text")


def read_recursive(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All matching files of all subfolders as one flat folder, with ``file_name``; junk is skipped."""
    found = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(folder)
    )
    named = found.withColumn("file_name", F.col("_metadata.file_name"))
    return named.filter(~F.col("file_name").isin(*JUNK_FILES))


def pick_split(df: DataFrame, column: str, split: str | int) -> DataFrame:
    """One named split; the filter reaches the scan."""
    return df.filter(F.col(column) == split)


def table_from_columns(
    spark: SparkSession, columns: Mapping[str, Sequence], schema: T.StructType | str | None = None
) -> DataFrame:
    """A small table from a dictionary of equally long lists."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError("all columns must have the same length")
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, schema if schema is not None else list(columns))


def rows_from_lists(df: DataFrame, keep: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """The same for lists that are columns of a table: one row per list position, ``nth``."""
    zipped: Column = F.arrays_zip(*lists)
    places = df.select(*keep, F.posexplode(zipped).alias("nth", "row"))
    return places.select(*keep, "nth", *[F.col(f"row.{c}").alias(c) for c in lists])
