"""What workers do together: compare shapes, gather, reduce and split evenly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.position import row_count, with_row_position


def shape_mismatch(df: DataFrame, part: str, shape: str) -> DataFrame:
    """Every worker's shape when they are not all the same; no rows when they are.

    A missing shape is a shape of its own.
    """
    shapes = df.groupBy(part, shape).agg(F.count(F.lit(1)).alias("n_values"))
    missing = F.max(F.col(shape).isNull().cast("int"))
    different = shapes.agg((F.count_distinct(F.col(shape)) + missing).alias("n")).scalar()
    return shapes.withColumn("__n", different).filter("__n > 1").drop("__n")


def gather(df: DataFrame, key: str, rank: str, rows: str) -> DataFrame:
    """The rows of all workers in rank order; a group has one entry per worker."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(rows).alias("rows"))))
    return df.groupBy(key).agg(parts.alias("parts")).select(key, F.flatten(F.col("parts.rows")).alias(rows))


def reduce_elementwise(df: DataFrame, key: str, values: str, how: str = "avg") -> DataFrame:
    """Position by position over all workers; partial sums are made before the shuffle."""
    reducer = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how]
    single = df.select(key, F.posexplode(values).alias("at", "value"))
    reduced = single.groupBy(key, "at").agg(reducer("value").alias("value"))
    listed = F.sort_array(F.collect_list(F.struct("at", "value")))
    return reduced.groupBy(key).agg(listed.alias("l")).select(key, F.col("l.value").alias(values))


def check_equal_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails at run time on a row whose array columns differ in length."""
    first, *others = columns
    same = F.lit(True)
    for c in others:
        same = same & (F.size(c) == F.size(first))
    message = F.lit("all values must have the same length")
    return df.withColumn(first, F.when(same, F.col(first)).otherwise(F.raise_error(message)))


def split_evenly(df: DataFrame, key: str, parts: int, remainder: bool = False) -> DataFrame:
    """``part``: equal contiguous shares; rows not divisible by ``parts`` are a run-time error.

    With ``remainder`` the rows left over, fewer than ``parts``, come last as a part of their own,
    numbered ``parts``; with fewer rows than ``parts`` these are all rows.
    """
    placed = with_row_position(df, key, "__pos").withColumn("__n", row_count(df))
    share = F.floor(F.col("__n") / parts)
    if remainder:
        part = F.when(F.col("__pos") < share * parts, F.floor(F.col("__pos") / share)).otherwise(parts)
    else:
        message = F.lit(f"the number of rows must be evenly divisible by {parts}")
        part = F.floor(F.col("__pos") / F.when(F.col("__n") % parts == 0, share).otherwise(F.raise_error(message)))
    return placed.withColumn("part", part.cast("int")).drop("__pos", "__n")
