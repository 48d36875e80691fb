"""Permutation, length grouping, distribution over ranks, splits and batches.

All of this works on keys, lengths and positions; the wide rows are joined once,
when batches are collated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators.position import FINE_BITS, hash_levels, row_count, running_totals, with_row_position
from lexloom.session import drop_read, write_and_read, write_bucketed

# Epochs whose rows are on the move at the same time.
EPOCHS_AT_ONCE = 4


def permute(df: DataFrame, key: str, seed: int = 0, epoch: int | Column = 0, out: str = "perm_pos", within: Sequence[str] = ()) -> DataFrame:
    """A repeatable random position for every row; another epoch gives another order.

    ``epoch`` may be a column; with ``within`` each of these groups has an order of its own.
    """
    salt = F.lit(str(seed + epoch)) if isinstance(epoch, int) else (F.lit(seed) + epoch).cast("string")
    hashed = df.withColumn("__hash", F.md5(F.concat_ws("|", salt, F.col(key).cast("string"))))
    placed = running_totals(hashed, {out: F.lit(1)}, ["__hash", key], hash_levels("__hash"), within)
    return placed.drop("__hash")


def mega_batches(
    df: DataFrame, size: int | None = None, pos: str = "perm_pos", n: Column | None = None
) -> DataFrame:
    """``mega``: runs of ``size`` positions, by default a thousandth of the ``n`` rows."""
    n = row_count(df) if n is None else n
    per = F.lit(size) if size else F.greatest(F.floor(n / 1000), F.lit(1))
    return df.withColumns({"__mega_size": per.cast("bigint"), "mega": F.floor(F.col(pos) / per).cast("bigint")})


def sort_in_mega_batches(
    df: DataFrame,
    length: str,
    size: int | None = None,
    pos: str = "perm_pos",
    out: str = "flat_pos",
    n: Column | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Longest first inside each mega-batch, null lengths last, equal lengths in permutation order.

    A mega-batch grows with the table by default, and after packing all its rows
    are equally long; so its ranks come from buckets of (length, position), not
    from one window over the group.
    """
    grouped = mega_batches(df, size, pos, n)
    base = F.col("mega") * F.col("__mega_size")
    grouped = grouped.withColumn("__shorter", F.coalesce(-F.col(length), F.lit(1)))  # a length is 0 at least
    ranked = running_totals(
        grouped,
        {"__rank": F.lit(1)},
        ["__shorter", pos],
        [F.col("__shorter"), F.shiftright(pos, FINE_BITS)],
        within=[*within, "mega"],
    )
    return ranked.withColumn(out, (base + F.col("__rank")).cast("bigint")).drop("__rank", "__mega_size", "__shorter")


def samples_per_rank(n: Column, ranks: int, drop_last: bool) -> Column:
    if not drop_last:
        return F.ceil(n / ranks)
    return F.when(n % ranks != 0, F.ceil((n - ranks) / ranks)).otherwise(F.floor(n / ranks))


def even_out(
    df: DataFrame, ranks: int, drop_last: bool, pos: str = "flat_pos", n: Column | None = None
) -> DataFrame:
    """Positions 0 … total-1 with ``total`` a multiple of ``ranks``.

    Dropping truncates.  Otherwise rows repeat from the start, as often as
    needed: a row at ``p`` also stands at ``p + n``, ``p + 2n``, …, so nothing is
    joined or moved.
    """
    counted = df.withColumn("__n", row_count(df) if n is None else n)
    total = samples_per_rank(F.col("__n"), ranks, drop_last) * ranks
    if drop_last:
        return counted.filter(F.col(pos) < total).drop("__n")
    copies = F.sequence(F.col(pos), total - 1, F.col("__n"))
    others = [c for c in df.columns if c != pos]
    return counted.select(*others, F.explode(copies).alias(pos)).select(*df.columns)


def stride(df: DataFrame, ranks: int, pos: str = "flat_pos") -> DataFrame:
    """Rank ``r`` takes positions ``r``, ``r + ranks``, …"""
    return df.withColumns({"rank": (F.col(pos) % ranks).cast("int"), "idx": F.floor(F.col(pos) / ranks)})


def check_rank(rank: int | None, ranks: int) -> None:
    if ranks < 1 or (rank is not None and not 0 <= rank < ranks):
        raise ValueError(f"invalid rank {rank}, it should be in the interval [0, {ranks - 1}]")


def grouped_sampler(
    df: DataFrame,
    key: str,
    length: str,
    ranks: int,
    rank: int | None = None,
    mega_size: int | None = None,
    seed: int = 0,
    epoch: int = 0,
    drop_last: bool = False,
) -> DataFrame:
    """``key``, ``flat_pos``, ``rank``, ``idx``, ``per_rank``: similar lengths together,
    the same number for every rank.  With ``rank`` only that rank's rows are kept."""
    check_rank(rank, ranks)
    n = row_count(df)
    permuted = permute(df.select(key, length), key, seed, epoch)
    flat = sort_in_mega_batches(permuted, length, mega_size, n=n).select(key, "flat_pos")
    shared = stride(even_out(flat, ranks, drop_last, n=n), ranks)
    shared = shared.withColumn("per_rank", samples_per_rank(n, ranks, drop_last))
    return shared if rank is None else shared.filter(F.col("rank") == rank)


def grouped_sampler_of_epochs(
    df: DataFrame,
    key: str,
    length: str,
    ranks: int,
    epochs: int,
    mega_size: int | None = None,
    seed: int = 0,
    drop_last: bool = False,
    first: int = 0,
) -> DataFrame:
    """``grouped_sampler`` for epochs 0 … ``epochs - 1``, or as many from ``first`` on, at once, with
    a column ``epoch``.

    The table is scanned once and the plan is that of one epoch: an epoch is one more level of
    grouping for the permutation and for the order inside mega-batches.
    """
    check_rank(None, ranks)
    n = row_count(df)
    every = repeat_epochs(df.select(key, length), epochs, first)
    permuted = permute(every, key, seed, F.col("epoch"), within=["epoch"])
    flat = sort_in_mega_batches(permuted, length, mega_size, n=n, within=["epoch"]).select("epoch", key, "flat_pos")
    shared = stride(even_out(flat, ranks, drop_last, n=n), ranks)
    return shared.withColumn("per_rank", samples_per_rank(n, ranks, drop_last))


def plain_sampler(df: DataFrame, key: str, ranks: int, rank: int | None = None) -> DataFrame:
    """Row order, truncated to equal shares, dealt out in turn."""
    check_rank(rank, ranks)
    n = row_count(df)
    flat = with_row_position(df.select(key), key, "flat_pos")
    shared = stride(even_out(flat, ranks, True, n=n), ranks)
    shared = shared.withColumn("per_rank", samples_per_rank(n, ranks, True))
    return shared if rank is None else shared.filter(F.col("rank") == rank)


def per_device_batch(per_device: int, processes: int) -> int:
    """The largest batch per device, at most ``per_device``, that the processes divide."""
    fitting = per_device - per_device % max(processes, 1)
    if fitting < 1:
        raise ValueError(f"no batch of at most {per_device} can be divided by {processes} processes")
    return fitting


def train_rows(n: Column, fraction: float, full_batch: int) -> Column:
    share = F.lit(max(1 - fraction, fraction)) * n
    return (share - share % full_batch).cast("bigint")


def split_train_eval(df: DataFrame, key: str, fraction: float, full_batch: int, seed: int = 0) -> DataFrame:
    """``split`` = train or eval: exact sizes, train a multiple of ``full_batch``, random members."""
    if not isinstance(fraction, float) or not 0 < fraction < 1:
        raise ValueError("the split must be a fraction between 0 and 1")
    placed = permute(df, key, seed, out="__split_pos").withColumn("__n", row_count(df))
    train = F.col("__split_pos") < train_rows(F.col("__n"), fraction, full_batch)
    return placed.withColumn("split", F.when(train, "train").otherwise("eval")).drop("__split_pos", "__n")


def assign_rank_batches(df: DataFrame, batch_size: int) -> DataFrame:
    """``batch``: consecutive rows of a rank; the short last batch of each rank is dropped.

    Every rank holds ``per_rank`` rows, so a batch is full exactly when all its
    indices lie below the last multiple of ``batch_size``.
    """
    usable = df.filter(F.col("idx") < F.col("per_rank") - F.col("per_rank") % batch_size)
    batches = F.floor(F.col("per_rank") / batch_size).alias("batches_per_rank")
    return usable.select(
        *[c for c in df.columns if c != "per_rank"], F.floor(F.col("idx") / batch_size).alias("batch"), batches
    )


def packing() -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """A text as its compressed bytes, and a list of such bytes as the texts again."""

    # Nested, so that they travel to the workers by value.
    def pack(texts: pd.Series) -> pd.Series:
        codec = pa.Codec("zstd", 9)
        return texts.map(lambda t: len(b := t.encode()).to_bytes(8, "little") + codec.compress(b, asbytes=True), na_action="ignore")

    def unpack(lists: pd.Series) -> pd.Series:
        codec = pa.Codec("zstd")

        def text(b: bytes | None) -> str | None:
            if b is None:
                return None
            size = int.from_bytes(b[:8], "little")
            return codec.decompress(b[8:], size, asbytes=True).decode() if size else ""

        return lists.map(lambda row: [text(b) for b in row], na_action="ignore")

    return F.pandas_udf(pack, T.BinaryType()), F.pandas_udf(unpack, T.ArrayType(T.StringType()))


def narrowed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with those ``columns`` that are arrays of int, and hold no value that needs more, as arrays
    of two-byte numbers: half as much to move.  One pass over them finds out."""
    ids = [c for c in columns if rows.schema[c].dataType.simpleString() == "array<int>"]
    if not ids:
        return rows
    ends = rows.agg(*[f(g(F.col(c))) for c in ids for f, g in ((F.min, F.array_min), (F.max, F.array_max))]).first()
    small = [c for i, c in enumerate(ids) if all(v is None or -(1 << 15) <= v < 1 << 15 for v in ends[2 * i : 2 * i + 2])]
    return rows.withColumns({c: F.col(c).cast("array<smallint>") for c in small})


def collate(
    assigned: DataFrame,
    rows: DataFrame,
    key: str,
    columns: Sequence[str],
    by: Sequence[str] = ("rank", "batch"),
    packed: Sequence[str] = (),
) -> DataFrame:
    """One row per batch, named by the columns ``by``: each column becomes the list of its values in order.

    A group holds one batch, so it is as small as the batch size.  Columns of text named in ``packed``
    are compressed once for each row, moved so, and unpacked in their batches: for rows
    that are taken in many epochs.
    """
    pack, unpack = packing()
    whole = rows.select(key, *[pack(F.col(c)).alias(c) if c in packed else c for c in columns])
    placed = assigned.select(*by, "idx", key).join(whole, key)
    members = F.sort_array(F.collect_list(F.struct("idx", *columns)))
    grouped = placed.groupBy(*by).agg(members.alias("__rows"))
    listed = grouped.select(*by, *[F.col(f"__rows.{c}").alias(c) for c in columns])
    return listed.withColumns({c: unpack(F.col(c)) for c in packed}) if packed else listed


def collate_epochs(
    assigned: Callable[[int, int], DataFrame],
    rows: DataFrame,
    key: str,
    columns: Sequence[str],
    epochs: int,
    made: Callable[[DataFrame], DataFrame],
    by: Sequence[str] = ("epoch", "rank", "batch"),
    packed: Sequence[str] = (),
    at_once: int = EPOCHS_AT_ONCE,
) -> DataFrame:
    """``made`` of the batches of many epochs, collated ``at_once`` epochs at a time.

    ``assigned`` gives the rows of so many epochs from the first on.  An epoch moves every row once, so that the
    disk for all epochs in one plan grows with their number.  Here the rows are written once, packed and in buckets by
    key, what ``made`` makes of each turn is written, and its shuffles are gone before the next turn.
    """
    spark = rows.sparkSession
    pack, unpack = packing()
    whole = rows.select(key, *[pack(F.col(c)).alias(c) if c in packed else c for c in columns])
    stored = write_bucketed(whole, key, int(spark.conf.get("spark.sql.shuffle.partitions")), "rows")
    turns = []
    for first in range(0, epochs, at_once):
        batches = collate(assigned(first, min(at_once, epochs - first)), stored, key, columns, by)
        turns.append(write_and_read(made(batches.withColumns({c: unpack(F.col(c)) for c in packed})), "epochs"))
    drop_read(stored)
    return reduce(DataFrame.unionAll, turns)


def repeat_epochs(df: DataFrame, n: int, first: int = 0) -> DataFrame:
    """All batches ``n`` times over, numbered by ``epoch`` from ``first`` on."""
    if n < 1:
        raise ValueError("repeat needs n >= 1: an endless repetition is not a table")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))


def resume(df: DataFrame, epoch: int, batches_done: int, batches_per_epoch: int) -> DataFrame:
    """Batches still to come for a run that stopped in ``epoch``."""
    skip = batches_done % batches_per_epoch
    return df.filter((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("batch") >= skip)))


def epoch_plan(
    batches: DataFrame, epochs: int, accumulation: int, max_training_steps: int = -1
) -> DataFrame:
    """Which batch of each rank completes which update; ``batches`` has ``rank``, ``batch``
    and ``batches_per_rank``, one row per batch.

    ``step`` counts batches from one, ``is_sync`` marks every ``accumulation``-th,
    and ``update_id`` counts updates done by then.  Training ends when all updates
    of all epochs are done; ``max_training_steps`` caps the updates per epoch.
    """
    per_epoch = F.col("batches_per_rank")
    updates = F.greatest(F.floor(per_epoch / accumulation), F.lit(1))
    if max_training_steps > 0:
        updates = F.least(updates, F.lit(max_training_steps))
    step = F.col("epoch") * per_epoch + F.col("batch") + 1
    done_before = F.floor((step - 1) / accumulation)
    return repeat_epochs(batches, epochs).filter(done_before < updates * epochs).select(
        "epoch",
        "rank",
        "batch",
        step.cast("bigint").alias("step"),
        (step % accumulation == 0).alias("is_sync"),
        F.floor(step / accumulation).alias("update_id"),
    )
