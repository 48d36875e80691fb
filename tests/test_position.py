import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators import relational as rel
from lexloom.operators.position import integer_levels, running_totals, with_row_position, with_source_position, with_string_levels
from lexloom.session import new_stage_path

SPREADS = {
    "dense": list(range(3000)),
    "negative": list(range(-1500, 1500)),
    "clustered": [2**62, -(2**62), *range(1000), *range(2**40, 2**40 + 500)],
    "random": list({random.Random(i).getrandbits(64) - 2**63 for i in range(2000)}),
}


@pytest.mark.parametrize("name", list(SPREADS))
def test_positions_equal_the_plain_window(spark, name):
    df = spark.createDataFrame([(k,) for k in SPREADS[name]], "k bigint")
    expected = {k: i for i, k in enumerate(sorted(SPREADS[name]))}
    assert {r.k: r.pos for r in with_row_position(df, "k").collect()} == expected


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_running_totals_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(5000).select(
            "id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 11 + 2).alias("g"), (F.col("id") % 17).alias("v")
        )
        got = running_totals(df, {"t": F.col("v"), "n": F.lit(1)}, ["id"], integer_levels("id"), within=["g"])
        w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        want = df.withColumns(
            {"t": F.coalesce(F.sum("v").over(w), F.lit(0)), "n": F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0))}
        )
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n, shards, size", [(10, 3, 2), (3, 5, 4), (16, 4, 4), (1, 16, 2024), (101, 7, 5)])
def test_shards_and_batches(spark, n, shards, size):
    got = {r.id: r for r in rel.assign_batches(spark.range(n), "id", shards, size).collect()}
    d, m = divmod(n, shards)
    expected, position, batch = [], 0, -1
    for shard in range(shards):
        rows = d + (shard < m)
        for i in range(rows):
            batch += i % size == 0
            expected.append((position, shard, batch, i % size, min(size, rows - i // size * size)))
            position += 1
    assert [(i, got[i].shard, got[i].batch_id, got[i].pos_in_batch, got[i].batch_rows) for i in range(n)] == expected


def test_head_keeps_the_first_rows(spark):
    df = spark.range(0, 3000, 3)
    assert [r.id for r in rel.head(df, 50, "id").orderBy("id").collect()] == list(range(0, 150, 3))
    assert rel.head(df, -1, "id").count() == 1000


def test_missing_columns_are_errors(spark):
    with pytest.raises(ValueError):
        rel.drop_columns(spark.range(3), ["nope"])
    with pytest.raises(ValueError):
        rel.required_columns_report(spark.range(3), ["nope"])


@pytest.mark.parametrize("few", [100_000, 60, 2])
def test_nth_key_of_any_table(spark, few):
    rng = random.Random(2)
    keys = [None] * 20 + [rng.randint(-400, 400) for _ in range(900)] + [7] * 500
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    ordered = sorted(keys, key=lambda k: (k is not None, k or 0))
    for n in (1, 20, 21, 450, 700, 900, 1419):
        assert rel.nth_key(df, "k", n, few) == ordered[n - 1]
    text = df.select(F.concat(F.lit("document-"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("k"))
    named = sorted(r.k for r in text.collect() if r.k is not None)
    for n in (21, 700, 1419):
        assert rel.nth_key(text, "k", n, few) == named[n - 21]


def test_head_with_ties_nulls_and_repeated_rows(spark):
    rows = [(None, i, {"a": i}) for i in range(3)] + [(1, i % 4, {"a": 1}) for i in range(9)] + [(2, 0, None)]
    df = spark.createDataFrame(rows, "k int, v int, m map<string,int>")
    for n in range(0, 15):
        got = sorted((r.k if r.k is not None else -1, r.v) for r in rel.head(df, n, "k").collect())
        assert got == sorted((-1 if k is None else k, v) for k, v, _ in rows)[:n]


def test_head_moves_no_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    plan = rel.head(docs, 100, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan and "PushedFilters: [Or" in plan


def test_positions_of_long_string_keys_are_dealt_evenly(spark):
    df = spark.range(1_000_000).select(F.concat(F.lit("document-of-the-same-host-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k"), "id")
    leveled, levels = with_string_levels(df, "k")
    sizes = sorted(r["count"] for r in leveled.groupBy(*levels).count().collect())
    assert len(sizes) > 200 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    placed = with_row_position(df, "k")
    assert placed.filter("pos <> id").isEmpty() and placed.count() == 1_000_000


def test_positions_of_odd_string_keys(spark):
    keys = [None, "", "a", "a" * 400, "a" * 400 + "b", "ab", "b", "\U0001f600", "\uffee", *(f"k{i:05}" for i in range(3000))]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.pos for r in with_row_position(df, "k").collect()}
    assert got == {k: i for i, k in enumerate([None, *sorted(keys[1:])])}
    leveled, levels = with_string_levels(df, "k", rows_per_bucket=1)
    assert len(levels) == 3
    ordered = leveled.orderBy("k").select(*levels).collect()
    assert [tuple(r) for r in ordered] == sorted(tuple(r) for r in ordered)


def test_source_positions_follow_the_files(spark):
    path = new_stage_path(spark, "in-files")
    spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), F.lit("x").alias("text")).repartition(7).write.parquet(path)
    df = spark.read.parquet(path)
    expected = [r.v for f in sorted(df.inputFiles()) for r in spark.read.parquet(f).collect()]
    for files in (100, 3):
        got = with_source_position(df.select("text", "v"), "n", broadcast_files=files)
        assert [r.v for r in got.orderBy("n").collect()] == expected
        assert got.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (0, 999, 1000)
    plan = with_source_position(df, "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Sort" not in plan
    # Anything else is written first: rows that are left are numbered without gaps.
    some = with_source_position(df.filter("v % 2 = 0"), "n")
    assert some.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (0, 499, 500)
    assert with_source_position(df.filter("v < 0"), "n").count() == 0
