import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom import session
from lexloom.operators import permutation
from lexloom.operators import sampling as sp


def positions(spark, n):
    return spark.range(n).select("id", F.col("id").alias("flat_pos"))


@pytest.mark.parametrize(
    "n, ranks, drop, total",
    [(10, 4, True, 8), (10, 4, False, 12), (2, 5, False, 5), (8, 4, True, 8), (8, 4, False, 8), (3, 7, True, 0)],
)
def test_even_out(spark, n, ranks, drop, total):
    got = {r.flat_pos: r.id for r in sp.even_out(positions(spark, n), ranks, drop).collect()}
    assert got == {p: p % n for p in range(total)}


def test_stride(spark):
    got = sp.stride(positions(spark, 8), 4).filter("rank = 1").orderBy("idx").collect()
    assert [r.id for r in got] == [1, 5]


def test_ranks_are_disjoint_equal_and_repeatable(spark):
    df = spark.range(1003).select("id", (F.col("id") * 7 % 50).alias("n"))
    rows = sp.grouped_sampler(df, "id", "n", 4, mega_size=100, seed=1, drop_last=True).collect()
    assert len(rows) == 1000 and len({r.id for r in rows}) == 1000
    assert {r.rank: sum(x.rank == r.rank for x in rows) for r in rows} == {0: 250, 1: 250, 2: 250, 3: 250}
    again = sp.grouped_sampler(df.repartition(13), "id", "n", 4, mega_size=100, seed=1, drop_last=True).collect()
    assert sorted(rows) == sorted(again)
    other = sp.grouped_sampler(df, "id", "n", 4, mega_size=100, seed=1, epoch=1, drop_last=True).collect()
    assert sorted(rows) != sorted(other)


def test_bucketed_ranks_equal_the_window(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 512).otherwise(F.col("id") % 40).alias("n"))
    permuted = sp.permute(df, "id", 4)
    order = Window.partitionBy("mega").orderBy(F.desc("n"), "perm_pos")
    plain = permuted.withColumn("mega", F.floor(F.col("perm_pos") / 1700))
    plain = plain.select("id", (F.col("mega") * 1700 + F.row_number().over(order) - 1).alias("flat_pos"))
    bucketed = sp.sort_in_mega_batches(permuted, "n", 1700).select("id", "flat_pos")
    assert sorted(plain.collect()) == sorted(bucketed.collect())


@pytest.mark.parametrize("share", [0.05, 0.95])
def test_split_sizes(spark, share):
    split = sp.split_train_eval(spark.range(1000), "id", share, 64)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 896, "eval": 104}


def test_parameters():
    assert sp.per_device_batch(150, 4) == 148
    with pytest.raises(ValueError):
        sp.per_device_batch(3, 4)
    with pytest.raises(ValueError):
        sp.check_rank(4, 4)


def test_refused_arguments(spark):
    with pytest.raises(ValueError):
        sp.split_train_eval(spark.range(10), "id", 5, 2)
    with pytest.raises(ValueError):
        sp.repeat_epochs(spark.range(3), 0)


def test_batches_keep_their_order(spark):
    rows = spark.range(40).select("id", F.col("id").alias("v"))
    assigned = sp.plain_sampler(rows, "id", 3)
    got = sp.collate(sp.assign_rank_batches(assigned, 5), rows, "id", ["v"]).orderBy("rank", "batch").collect()
    assert [(r.rank, r.batch, r.v) for r in got] == [
        (k, b, [(b * 5 + i) * 3 + k for i in range(5)]) for k in range(3) for b in range(2)
    ]


def test_all_epochs_are_one_plan(spark):
    df = spark.range(500).select("id", (F.col("id") * 7 % 50).alias("n"))
    plan_of = lambda k: sp.grouped_sampler_of_epochs(df, "id", "n", 3, k, 40, 5)
    rows = plan_of(4).collect()
    for epoch in range(4):
        one = sp.grouped_sampler(df, "id", "n", 3, mega_size=40, seed=5, epoch=epoch)
        assert sorted(tuple(r) for r in one.collect()) == sorted((r.id, r.flat_pos, r.rank, r.idx, r.per_rank) for r in rows if r.epoch == epoch)
    size = lambda k: plan_of(k)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(20) == size(2)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 5003])
def test_keyed_permutation_and_its_inverse(spark, n):
    df = spark.range(n).select("id", permutation.shuffled_position(F.col("id"), n, 3).alias("p"))
    rows = df.select("id", "p", permutation.original_position(F.col("p"), n, 3).alias("back")).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n > 1000:
        other = df.select("id", "p", permutation.shuffled_position(F.col("id"), n, 4).alias("q"))
        assert other.filter("p = q").count() < 10 and other.filter("abs(p - id) < 50").count() < 150
        assert abs(other.stat.corr("id", "p")) < 0.05


def test_large_positions_stay_exact(spark):
    n = 2**61 + 12345
    df = spark.createDataFrame([(0,), (1,), (n - 1,), (2**60,)], "x bigint")
    df = df.withColumn("p", permutation.shuffled_position(F.col("x"), n, 9))
    rows = df.withColumn("back", permutation.original_position(F.col("p"), n, 9)).collect()
    assert all(0 <= r.p < n and r.back == r.x for r in rows) and len({r.p for r in rows}) == 4


def test_resumed_batches_are_the_rest_of_the_epoch(spark):
    whole = permutation.batch_rows(spark, 1003, 4, 16, seed=2, epoch=1).collect()
    assert len(whole) == 1003 // 4 // 16 * 64 and len({r.pos for r in whole}) == len(whole)
    rest = permutation.batch_rows(spark, 1003, 4, 16, seed=2, epoch=1, first_batch=9).collect()
    assert sorted(rest) == sorted(r for r in whole if r.batch >= 9) and min(r.batch for r in rest) == 9
    assert permutation.batch_rows(spark, 1003, 4, 16, first_batch=99).count() == 0 == permutation.batch_rows(spark, 0, 4, 16).count()


def test_packed_columns_are_small_and_come_back(spark):
    texts = ["", None, "é😀\n", *(",".join(str((i * j) % 997) for j in range(400)) for i in range(3, 30))]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, t string, n long")
    assigned = sp.repeat_epochs(rows.select("id", F.lit(0).alias("rank"), (F.col("id") % 4).alias("batch"), F.col("id").alias("idx")), 3)
    by = ["epoch", "rank", "batch"]
    plain = sp.collate(assigned, rows, "id", ["t", "n"], by).orderBy(*by).collect()
    assert sp.collate(assigned, rows, "id", ["t", "n"], by, packed=["t"]).orderBy(*by).collect() == plain and len(plain) == 12
    pack, _ = sp.packing()
    # 400 ids to a row: less than half of what they take as four bytes each.
    assert rows.filter("id > 2").agg(F.max(F.length(pack(F.col("t"))))).first()[0] < 2 * 400
    nothing = sp.collate(assigned.limit(0), rows, "id", ["t"], by, packed=["t"])
    assert nothing.collect() == []


def test_epochs_collated_in_turns_equal_all_at_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    rows = spark.range(90).select("id", F.repeat(F.col("id").cast("string"), 3).alias("text"), F.col("id").alias("doc"), F.lit(1).alias("n"))

    def assigned(first, epochs):
        made = sp.grouped_sampler_of_epochs(rows, "id", "n", 3, epochs, 10, seed=2, drop_last=True, first=first)
        return sp.assign_rank_batches(made, 4)

    by, columns = ["epoch", "rank", "batch"], ["text", "doc"]
    turns = []

    def made(batches):
        turns.append(batches)
        return batches.withColumn("text", F.array_join("text", "|"))

    plain = sp.collate(assigned(0, 5), rows, "id", columns, by, packed=["text"])
    got = sp.collate_epochs(assigned, rows, "id", columns, 5, made, by, packed=["text"], at_once=2)
    assert sorted(got.collect()) == sorted(plain.withColumn("text", F.array_join("text", "|")).collect())
    assert len(turns) == 3 and got.select("epoch").distinct().count() == 5
    # What is left on disk is what was made of each turn: the packed rows are gone.
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"epochs"}
