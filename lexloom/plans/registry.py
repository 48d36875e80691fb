"""Registered queries: a Spark plan over the given tables, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.sources.readers import read_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(plan: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


# A task of a corpus gets about this many rows.
ROWS_PER_TASK = 2_000


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of a scan dealt over all cores, and over more tasks as the table grows.

    A scan alone gives one task a whole row group, and up to 128 MB of a larger file, so that its
    tasks grow with the files.
    """
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(cores, -(-df.count() // rows_per_task)))
