import datetime as dt

import pytest

from lexloom.operators import runlog

DAY = dt.datetime(2024, 1, 1)


def manifest(spark, rows):
    full = [(t, n, DAY + dt.timedelta(days=d), s, *([ok] * 5)) for t, n, d, s, ok in rows]
    schema = (
        "trial int, name string, mtime timestamp_ntz, score double, has_model boolean, has_optimizer boolean, "
        "has_schedule boolean, has_state boolean, has_config boolean"
    )
    return spark.createDataFrame(full, schema)


@pytest.mark.parametrize(
    "max_keep, keep_best, kept",
    [(2, False, {"b", "c"}), (2, True, {"a", "c"}), (0, True, set()), (-1, False, {"a", "b", "c"})],
)
def test_retention(spark, max_keep, keep_best, kept):
    df = manifest(spark, [(1, "a", 0, 3.0, True), (1, "b", 1, 1.0, True), (1, "c", 2, 2.0, True)])
    got = runlog.with_retention(df, max_keep, keep_best).filter("keep").collect()
    assert {r.name for r in got} == kept


def test_unscored_rows_go_last_with_keep_best(spark):
    df = manifest(spark, [(1, "a", 0, None, True), (1, "b", 1, 9.0, True), (1, "c", 2, None, True), (1, "d", 3, 1.0, True)])
    kept = runlog.with_retention(df, 3, True).filter("keep").collect()
    assert {r.name for r in kept} == {"a", "b", "c"}
    kept = runlog.with_retention(df, 1, True).filter("keep").collect()
    assert {r.name for r in kept} == {"c"}


def test_latest_counts_incomplete_ones(spark):
    df = manifest(spark, [(1, "a", 0, 3.0, True), (1, "b", 1, 1.0, False), (2, "c", 0, 1.0, False)])
    assert [tuple(r) for r in runlog.latest_checkpoint(df).collect()] == [(1, "b")]
    assert [tuple(r) for r in runlog.latest_checkpoint(df, valid_only=True).collect()] == [(1, "a")]
    assert [tuple(r) for r in runlog.best_checkpoint(df).collect()] == [(1, "a")]


def test_flags_can_be_off(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "n_batches")
    got = runlog.with_interval_flags(df, 5, -1).orderBy("n_batches").collect()
    assert [r.n_batches for r in got if r.should_log] == [5, 10]
    assert not any(r.should_checkpoint for r in got)


def test_absent_measures(spark):
    df = spark.createDataFrame([("train", DAY), ("train", DAY + dt.timedelta(seconds=4))], "split string, ts timestamp_ntz")
    got = runlog.throughput(df, "split", samples=None, tokens=None)
    assert got.columns == ["split", "runtime", "steps_per_second"]
    assert tuple(got.first()) == ("train", 4.0, 0.5)


def test_one_run_may_hold_everything(spark):
    df = spark.range(3000).selectExpr("1 as run", "id as step", "2 as batch_size", "if(id = 1500, double('nan'), 1.0) as loss")
    last = runlog.with_counters(df).filter("step = 2999").first()
    assert (last.n_batches, last.n_examples) == (3000, 6000)
    assert runlog.with_skipped_updates(df).filter("skipped").count() == 1499


def test_names_without_a_checkpoint_are_null(spark):
    df = spark.createDataFrame([("/x/y",), ("/x/checkpoint_2024-05-06_07-08-09/z",)], "p string")
    none, found = runlog.parse_checkpoint_path(df, "p").collect()
    assert none.checkpoint is None and none.saved_at is None
    assert found.checkpoint == "checkpoint_2024-05-06_07-08-09"
    assert found.saved_at == dt.datetime(2024, 5, 6, 7, 8, 9)
