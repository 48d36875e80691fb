"""One answer for every size, and no row lost to a null."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions.arrays import pad_structure
from lexloom.functions.nested import flatten_leaves
from lexloom.operators import relational, runlog, sampling, workers
from lexloom.operators.position import with_row_position


@pytest.mark.parametrize("n", [2, 100_001])
def test_head_keeps_null_keys_first(spark, n):
    df = spark.createDataFrame([(None,), (1,), (2,)], "k bigint")
    got = [r["k"] for r in relational.head(df, n, "k").collect()]
    assert sorted(got, key=lambda x: (x is not None, x)) == [None, 1, 2][:n]


def test_string_keys_have_positions(spark):
    keys = ["b", "a", "é", "", "aaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaaa", None]
    rows = with_row_position(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()
    order = sorted(keys, key=lambda k: (k is not None, (k or "").encode()))
    assert [k for k, _ in sorted(rows, key=lambda r: r["pos"])] == order


@pytest.mark.parametrize("size", [10, 200_000, None])
def test_null_lengths_come_last_at_every_size(spark, size):
    df = spark.createDataFrame([(0, 5), (1, None), (2, 7)], "perm_pos bigint, length bigint")
    flat = sampling.sort_in_mega_batches(df, "length", size=size).collect()
    assert len(flat) == 3
    if size:
        assert [r["length"] for r in sorted(flat, key=lambda r: r["flat_pos"])] == [7, 5, None]


def test_counters_keep_null_runs_and_sizes(spark):
    log = spark.createDataFrame(
        [(None, 1, 4), (None, 2, 2), (1, 1, 2), (1, 2, None)], "run bigint, step bigint, batch_size int"
    )
    got = {(r["run"], r["step"]): (r["n_batches"], r["n_examples"]) for r in runlog.with_counters(log).collect()}
    assert got == {(None, 1): (1, 4), (None, 2): (2, 6), (1, 1): (1, 2), (1, 2): (2, 2)}


def test_throughput_without_runtime_is_null(spark):
    log = spark.sql("SELECT 'a' AS split, timestamp_ntz'2024-01-01' AS ts, 3 AS batch_size, 5L AS n_tokens")
    assert runlog.throughput(log, "split").first()["samples_per_second"] is None


def test_null_branches_keep_other_leaves(spark):
    df = spark.sql("SELECT named_struct('a', array(1, 2), 'b', cast(null AS array<int>), 'c', 3) AS v")
    assert df.select(flatten_leaves(df, "v", "int").alias("x")).first()["x"] == [1, 2, 3]


def test_null_struct_stays_null_when_padded(spark):
    df = spark.sql("SELECT cast(null AS struct<a: array<array<int>>>) AS v")
    assert df.select(pad_structure(df, "v", 2).alias("x")).first()["x"] is None


def test_missing_shape_differs(spark):
    df = spark.createDataFrame([(0, "3"), (1, None)], "part int, shape string")
    assert workers.shape_mismatch(df, "part", "shape").count() == 2
    assert workers.shape_mismatch(df.filter("shape = '3'"), "part", "shape").count() == 0
