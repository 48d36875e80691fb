import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexloom.functions import nested
from lexloom.functions.arrays import pad_structure
from lexloom.operators import workers
from lexloom.plans import nested_queries


def test_strings_only(spark):
    df = spark.sql("select struct(1 as n, array('A', null) as l, map('k', struct('B' as s)) as m) as v")
    got = df.select(nested.map_strings(df, "v", F.lower)).first()[0]
    assert got.n == 1 and got.l == ["a", None] and got.m["k"].s == "b"


def test_unsupported_leaf_is_an_error(spark):
    df = spark.sql("select struct(1 as n, 'x' as s) as v")
    with pytest.raises(TypeError):
        nested.map_numbers(df, "v", lambda c: c + 1)


def test_pad_structure(spark):
    df = spark.sql("select struct(array(array(1), array(1, 2, 3)) as a, array(struct(array(array(5)) as b)) as c) as v")
    got = df.select(pad_structure(df, "v", 2, 0)).first()[0]
    assert got.a == [[1, 0], [1, 2, 3]] and got.c[0].b == [[5, 0]]
    for bad in ("struct(1 as n)", "array(1, 2)", "'x'", "true"):
        broken = spark.sql(f"select {bad} as v")
        with pytest.raises(ValueError):
            pad_structure(broken, "v", 2)


def test_flatten_mixed_containers(spark):
    df = spark.sql("select struct(array(struct(1 as a, array(2, 3) as b)) as l, map('k', array(array(4))) as m, 5 as n) as v")
    assert df.select(nested.flatten_leaves(df, "v", "bigint")).first()[0] == [1, 2, 3, 4, 5]


def test_even_split_needs_divisible_rows(spark):
    parts = workers.split_evenly(spark.range(6), "id", 3).orderBy("id").collect()
    assert [r.part for r in parts] == [0, 0, 1, 1, 2, 2]
    with pytest.raises(PySparkException, match="evenly divisible"):
        workers.split_evenly(spark.range(7), "id", 3).collect()


def test_even_split_of_any_number_of_rows(spark, tmp_path):
    for n, wanted in ((6, [0, 0, 1, 1, 2, 2]), (8, [0, 0, 1, 1, 2, 2, 3, 3]), (2, [3, 3]), (0, [])):
        parts = workers.split_evenly(spark.range(n), "id", 3, remainder=True).orderBy("id").collect()
        assert [r.part for r in parts] == wanted
    spark.range(10).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = nested_queries.split_evenly(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.part for r in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_columns_of_unequal_length_are_an_error(spark):
    df = spark.sql("select array(1, 2) as a, array(1) as b")
    with pytest.raises(PySparkException, match="same length"):
        workers.check_equal_lengths(df, ["a", "b"]).collect()


def test_gather_and_reduce(spark):
    df = spark.createDataFrame([(0, 1, [3.0, 4.0]), (0, 0, [1.0, 2.0])], "k int, rank int, x array<double>")
    assert workers.gather(df, "k", "rank", "x").first().x == [1.0, 2.0, 3.0, 4.0]
    assert workers.reduce_elementwise(df, "k", "x").first().x == [2.0, 3.0]
    assert workers.reduce_elementwise(df, "k", "x", "sum").first().x == [4.0, 6.0]
