import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import packing as pk

EOS, PAD = -10, -100


def docs(spark, lengths, batch=0):
    rows, n = [], 1
    for i, size in enumerate(lengths):
        rows.append((batch, i, list(range(n, n + size))))
        n += size
    return spark.createDataFrame(rows, "batch_id bigint, doc_id bigint, ids array<int>")


def rows_of(df):
    return [r.ids for r in df.orderBy("batch_id", "row_no").collect()]


def cut(stream, length, pad):
    rows = [stream[i : i + length] for i in range(0, len(stream), length)]
    return [r + [pad] * (length - len(r)) for r in rows]


def test_chunk(spark):
    got = pk.chunk(docs(spark, [3, 4, 2]), "doc_id", ["ids"], 4).orderBy("row_no").collect()
    assert [(r.row_no, r.ids) for r in got] == [(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])]


def test_chunk_with_empty_and_long_documents(spark):
    lengths = [0, 5, 0, 0, 33, 1, 0, 2]
    got = pk.chunk(docs(spark, lengths), "doc_id", ["ids"], 4).orderBy("row_no").collect()
    stream = list(range(1, sum(lengths) + 1))
    assert [r.ids for r in got] == [stream[i : i + 4] for i in range(0, len(stream) - 3, 4)]


def test_constant_length(spark):
    got = rows_of(pk.constant_length_pack(docs(spark, [7, 3, 9, 8, 4]), "doc_id", {"ids": (EOS, PAD)}, 8, 1))
    assert got == [
        [1, 2, 3, 4, 5, 6, 7, PAD],
        list(range(11, 20)),
        list(range(20, 28)),
        [8, 9, 10, EOS, 28, 29, 30, 31],
        [EOS] + [PAD] * 7,
    ]


def expected_constant(lengths, length, threshold):
    n, alone, stream = 1, [], []
    for size in lengths:
        ids = list(range(n, n + size))
        n += size
        if abs(size - length) <= threshold:
            alone.append(ids + [PAD] * (length - size))
        else:
            stream += [*ids, EOS]
    return alone + cut(stream, length, PAD)


@pytest.mark.parametrize("seed", range(3))
def test_constant_length_on_random_batches(spark, seed):
    r = random.Random(seed)
    lengths = {b: [r.choice([0, 1, 5, 15, 16, 17, 40, 200]) for _ in range(r.randint(1, 12))] for b in range(5)}
    table = None
    for b, sizes in lengths.items():
        part = docs(spark, sizes, b)
        table = part if table is None else table.union(part)
    got = rows_of(pk.constant_length_pack(table, "doc_id", {"ids": (EOS, PAD)}, 16, 2))
    assert got == [row for sizes in lengths.values() for row in expected_constant(sizes, 16, 2)]


def test_balanced_bins():
    assert pk.bin_packer(8)([5, 3, 7, 2]) == [[3], [2], [0, 1]]


def test_balanced_pack(spark):
    got = rows_of(pk.balanced_pack(docs(spark, [5, 3, 7, 2]), "doc_id", {"ids": (EOS, PAD)}, 8))
    assert got == [
        [16, 17, EOS] + [PAD] * 5,
        [*range(9, 16), EOS],
        [1, 2, 3, 4, 5, EOS, 6, 7],
        [8, EOS] + [PAD] * 6,
    ]


@pytest.mark.parametrize("seed", range(3))
def test_balanced_pack_on_random_batches(spark, seed):
    r = random.Random(seed)
    lengths = [r.choice([0, 1, 3, 8, 9, 16, 31, 100]) for _ in range(40)]
    got = rows_of(pk.balanced_pack(docs(spark, lengths), "doc_id", {"ids": (EOS, PAD)}, 16))
    starts = [1 + sum(lengths[:i]) for i in range(len(lengths))]
    expected = []
    for members in pk.bin_packer(16)(lengths):
        stream = []
        for i in members:
            stream += [*range(starts[i], starts[i] + lengths[i]), EOS]
        expected += cut(stream, 16, PAD)
    assert got == expected


def test_bins_cover_each_document_once_and_loads_fit():
    r = random.Random(3)
    lengths = [r.randint(0, 300) for _ in range(500)]
    bins = pk.bin_packer(64)(lengths)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(lengths[i] % 64 for i in b) <= 64 for b in bins)
    totals = [sum(lengths[i] for i in b) for b in bins]
    assert totals == sorted(totals)


def test_mask_values(spark):
    df = docs(spark, [3]).withColumn("attention_mask", F.array_repeat(F.lit(1), 3))
    both = ["ids", "attention_mask"]
    plain = pk.constant_length_pack(df, "doc_id", pk.fill_values(both, EOS, PAD), 6, 0).first()
    assert plain.attention_mask == [1, 1, 1, 1, 0, 0]
    compat = pk.constant_length_pack(df, "doc_id", pk.fill_values(both, EOS, PAD, mask_compat=True), 6, 0).first()
    assert compat.attention_mask == [1, 1, 1, EOS, PAD, PAD] and compat.ids == [1, 2, 3, EOS, PAD, PAD]


def test_padding(spark):
    df = spark.createDataFrame([(0, [1]), (0, [1, 2, 3])], "batch_id bigint, ids array<int>")
    to_two = sorted(r.ids for r in pk.pad_batches(df, "ids", 2).collect())
    assert to_two == [[1, 0], [1, 2, 3]]
    longest = sorted(r.ids for r in pk.pad_batches(df, "ids", None).collect())
    assert longest == [[1, 0, 0], [1, 2, 3]]


def test_balanced_pack_with_null_and_repeated_keys(spark):
    rows = [(None if i % 5 == 0 else i // 3, 0, i, [i] * (i % 6)) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, batch_id int, pos_in_batch int, ids array<int>")
    packed = pk.balanced_pack(df, "k", {"ids": (-1, -2)}, 8).collect()
    tokens = sorted(t for r in packed for t in r.ids if t >= 0)
    assert tokens == sorted(i for i in range(30) for _ in range(i % 6))
    assert sum(t == -1 for r in packed for t in r.ids) == 30 and all(len(r.ids) == 8 for r in packed)


def test_batches_are_binned_by_many_tasks(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 40).alias("batch_id"), F.lit(5).alias("n"))
    bins = pk.assign_bins(df, "k", "n", 16)
    assert bins.count() == 400
    assert bins.select(F.spark_partition_id().alias("task")).distinct().count() > 3
