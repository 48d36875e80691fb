"""Cutting and packing token arrays into rows of fixed length.

Tokens are never exploded one by one.  Each document knows where it starts in
the stream of its batch, so it emits one array slice per output row it touches;
slices are grouped by output row, ordered by their start and joined.  A group
holds one output row, so its size is bounded by the row length.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from lexloom.functions.arrays import pad_right
from lexloom.operators.position import integer_levels, running_totals

BINS_SCHEMA_TAIL = "bin int, pos_in_bin int"


def _leaf(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.elementType.simpleString()


def _emit_slices(
    df: DataFrame, keep: Sequence[str], columns: Sequence[str], start: Column, length: int, uncut: Column
) -> DataFrame:
    """One row per (document, output row): ``__row`` within the stream, ``__at`` for order.

    ``uncut`` marks documents that are an output row by themselves; for them
    ``start`` is the row number.  Slices are taken before the explode, so a long
    document is not copied once per output row.
    """
    df = df.withColumn("__start", start.cast("bigint")).withColumn("__uncut", uncut)
    begin, size = F.col("__start"), F.size(columns[0])
    whole = F.array(
        F.struct(begin.alias("__row"), F.lit(0).alias("__at"), *[F.col(c).alias(c) for c in columns])
    )

    def cut(row: Column) -> Column:
        skipped = F.greatest(row * length - begin, F.lit(0)).cast("int")
        at = F.greatest(begin - row * length, F.lit(0)).cast("int")
        slices = [F.slice(c, skipped + 1, F.lit(length) - at).alias(c) for c in columns]
        return F.struct(row.alias("__row"), at.alias("__at"), *slices)

    rows = F.sequence(F.floor(begin / length), F.floor((begin + size - 1) / length))
    pieces = F.when(F.col("__uncut"), whole).when(size > 0, F.transform(rows, cut))
    return df.select(*keep, F.inline(pieces))


def _join_slices(
    slices: DataFrame, keys: Sequence[str], columns: Sequence[str], full: int | None = None
) -> DataFrame:
    """Slices of an output row in order, joined; with ``full`` only rows of that size."""
    parts = F.sort_array(F.collect_list(F.struct("__at", *columns)))
    grouped = slices.groupBy(*keys).agg(parts.alias("__parts"), F.sum(F.size(columns[0])).alias("__size"))
    if full is not None:
        grouped = grouped.filter(F.col("__size") == full)
    return grouped.select(*keys, *[F.flatten(F.col(f"__parts.{c}")).alias(c) for c in columns])


def chunk(
    df: DataFrame, key: str, columns: Sequence[str], length: int, size: str | None = None
) -> DataFrame:
    """Concatenate all rows in key order, cut into ``length``, drop the remainder.

    ``columns`` are cut alike; the first gives the lengths, or the stored column
    ``size`` does, so that its totals are read without the arrays.  Returns
    ``row_no`` and the columns.
    """
    measure = F.col(size) if size else F.size(columns[0])
    narrow = df.select(key, *columns, *([size] if size else []))
    sized = running_totals(narrow, {"__before": measure}, [key], integer_levels(key))
    slices = _emit_slices(sized, [], columns, F.col("__before"), length, F.lit(False))
    return _join_slices(slices, ["__row"], columns, full=length).withColumnRenamed("__row", "row_no")


def fill_values(
    columns: Sequence[str], eos: int, pad: int, mask: str | None = "attention_mask", mask_compat: bool = False
) -> dict[str, tuple[int, int]]:
    """(end mark, padding) per column: a mask gets 1 and 0, or the ids with ``mask_compat``."""
    return {c: (1, 0) if c == mask and not mask_compat else (eos, pad) for c in columns}


def _with_eos(df: DataFrame, fill: Mapping[str, tuple[int, int]], where: Column | None = None) -> DataFrame:
    def ended(c: str) -> Column:
        joined = F.concat(F.col(c), F.array(F.lit(fill[c][0]).cast(_leaf(df, c))))
        return joined if where is None else F.when(where, joined).otherwise(F.col(c))

    return df.withColumns({c: ended(c) for c in fill})


def _pad_all(df: DataFrame, fill: Mapping[str, tuple[int, int]], length: int) -> DataFrame:
    return df.withColumns({c: pad_right(F.col(c), length, pad, _leaf(df, c)) for c, (_, pad) in fill.items()})


def constant_length_pack(
    df: DataFrame,
    key: str,
    fill: Mapping[str, tuple[int, int]],
    length: int = 1024,
    threshold: int = 10,
    batch: str = "batch_id",
    truncate_overlong: bool = False,
) -> DataFrame:
    """Rows of ``length`` per batch.

    Documents within ``threshold`` of the length stand alone, padded and first;
    those a little longer stay long unless ``truncate_overlong``.  The others,
    each followed by an end mark, are concatenated and cut; the last row is
    padded.  ``batch`` must have a bounded number of rows.  The windows and the
    final grouping all run on one exchange by ``batch``.
    """
    columns = list(fill)
    narrow = df.select(batch, key, *columns)
    narrow = narrow.withColumn("__alone", F.abs(F.size(columns[0]) - length) <= threshold)
    narrow = _with_eos(narrow, fill, ~F.col("__alone"))
    before = Window.partitionBy(batch).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(batch)
    alone = F.col("__alone").cast("bigint")
    stream = F.when(F.col("__alone"), 0).otherwise(F.size(columns[0]))
    placed = narrow.withColumns(
        {
            "__alone_before": F.coalesce(F.sum(alone).over(before), F.lit(0)),
            "__stream_before": F.coalesce(F.sum(stream).over(before), F.lit(0)),
            "__n_alone": F.sum(alone).over(whole),
        }
    )
    start = F.when(F.col("__alone"), F.col("__alone_before")).otherwise(
        F.col("__stream_before") + F.col("__n_alone") * length
    )
    slices = _emit_slices(placed, [batch], columns, start, length, F.col("__alone"))
    rows = _join_slices(slices, [batch, "__row"], columns).withColumnRenamed("__row", "row_no")
    if truncate_overlong:
        rows = rows.withColumns({c: F.slice(c, 1, length) for c in columns})
    return _pad_all(rows, fill, length)


def bin_packer(capacity: int) -> Callable[[Sequence[int]], list[list[int]]]:
    """Worst-fit decreasing on ``length mod capacity``; bins in order of their true total.

    The emptiest bin is the one with the smallest (load, members); ties of the
    final order keep the order of the heap, so the heap of the standard library
    is used itself.  The function is nested so that it travels to the workers by
    value.
    """

    def pack(lengths: Sequence[int]) -> list[list[int]]:
        loads = [n % capacity for n in lengths]
        bins: list[tuple[int, list[int]]] = []
        for i in sorted(range(len(loads)), key=loads.__getitem__, reverse=True):
            # Pop, then push: a replace in place would leave another heap order.
            fits = bool(bins) and bins[0][0] + loads[i] <= capacity
            load, members = heapq.heappop(bins) if fits else (0, [])
            heapq.heappush(bins, (load + loads[i], [*members, i]))
        return sorted((members for _, members in bins), key=lambda members: sum(lengths[i] for i in members))

    return pack


def assign_bins(
    df: DataFrame, key: str, length: str, capacity: int, batch: str = "batch_id"
) -> DataFrame:
    """A bin and a place in it for every row: ``batch``, ``key``, ``bin``, ``pos_in_bin``.

    The greedy step is sequential inside a batch, so it sees only keys and
    lengths of one batch of bounded size; batches run in parallel.  They are dealt into a fixed
    number of tasks: their bytes are few, and would be put together into one task.
    """

    pack = bin_packer(capacity)

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, kind="stable").reset_index(drop=True)
        rows = [
            (i, b, p)
            for b, members in enumerate(pack(group["__length"].tolist()))
            for p, i in enumerate(members)
        ]
        index, bins, places = (list(c) for c in zip(*rows))
        taken = group.loc[index]
        return pd.DataFrame(
            {batch: taken[batch].to_numpy(), key: taken[key].to_numpy(), "bin": bins, "pos_in_bin": places}
        )

    narrow = df.select(batch, key, F.col(length).cast("int").alias("__length"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = f"{batch} {types[batch]}, {key} {types[key]}, {BINS_SCHEMA_TAIL}"
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return narrow.repartition(slots, batch).groupBy(batch).applyInPandas(place, schema)


def pack_bins(
    df: DataFrame,
    bins: DataFrame,
    key: str,
    fill: Mapping[str, tuple[int, int]],
    length: int = 1024,
    batch: str = "batch_id",
    size: str | None = None,
    arrays: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Each bin's documents, every one followed by an end mark, cut at ``length`` and padded.

    Bins ignore the end marks, so one may spill into a further, padded row.
    Places are worked out on (key, size) alone and joined to the arrays once; with
    a stored column ``size`` the arrays are read only for that join.  They are taken from
    ``df``, or from another table by a column that is unique in both, as ``arrays`` names them:
    then ``df`` holds none and no array is moved to find its batch.
    """
    columns = list(fill)
    table, by = (arrays[0], [arrays[1]]) if arrays else (df, [batch, key])
    sizes = df.select(*dict.fromkeys([batch, key, *by]), ((F.col(size) if size else F.size(columns[0])) + 1).alias("__size"))
    in_bin = Window.partitionBy(batch, "bin")
    before = in_bin.orderBy("pos_in_bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(batch).orderBy("bin", "pos_in_bin").rowsBetween(Window.unboundedPreceding, 0)
    places = (
        bins.join(sizes, [batch, key])
        .withColumn("__in_bin", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        .withColumn("__bin_rows", F.ceil(F.sum("__size").over(in_bin) / length))
        .withColumn(
            "__first_row",
            F.sum(F.when(F.col("pos_in_bin") == 0, F.col("__bin_rows")).otherwise(0)).over(earlier)
            - F.col("__bin_rows"),
        )
        .select(*dict.fromkeys([batch, *by]), (F.col("__first_row") * length + F.col("__in_bin")).alias("__place"))
    )
    placed = _with_eos(table.select(*by, *columns), fill).join(places, by)
    slices = _emit_slices(placed, [batch], columns, F.col("__place"), length, F.lit(False))
    rows = _join_slices(slices, [batch, "__row"], columns).withColumnRenamed("__row", "row_no")
    return _pad_all(rows, fill, length)


def balanced_pack(
    df: DataFrame,
    key: str,
    fill: Mapping[str, tuple[int, int]],
    length: int = 1024,
    batch: str = "batch_id",
    size: str | None = None,
    arrays: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Length-balanced bins per batch, then packed.  Read ``df`` from a written stage:
    sizes and arrays are scanned separately.

    Rows with a ``pos_in_batch`` are told apart by it, so keys may be null or repeated.
    ``arrays`` is that of ``pack_bins``, and then ``size`` is needed.
    """
    column = next(iter(fill))
    place = "pos_in_batch" if "pos_in_batch" in df.columns else key
    sized = df.withColumn("__length_of", F.col(size) if size else F.size(column))
    bins = assign_bins(sized, place, "__length_of", length, batch)
    return pack_bins(df, bins, place, fill, length, batch, size, arrays)


def pad_batches(
    df: DataFrame, ids: str, length: int | None, value: int = 0, batch: str = "batch_id"
) -> DataFrame:
    """Pad each row to ``length``, or with ``None`` to the longest row of its batch."""
    if length is not None:
        return df.withColumn(ids, pad_right(F.col(ids), length, value, _leaf(df, ids)))
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    padded = df.withColumn("__longest", longest)
    return padded.withColumn(ids, pad_right(F.col(ids), F.col("__longest"), value, _leaf(df, ids))).drop(
        "__longest"
    )


def causal_labels(df: DataFrame, ids: str = "input_ids", pad: int | None = None, ignored: int = -100) -> DataFrame:
    """Labels equal to the ids; with ``pad`` given, padding becomes ``ignored``.  The ids are those
    of a row, or lists of them for the rows of a batch."""
    if pad is None:
        return df.withColumn("labels", F.col(ids))

    def labels(row: str | Column) -> Column:
        return F.transform(row, lambda t: F.when(t == pad, ignored).otherwise(t))

    of_batch = isinstance(df.schema[ids].dataType.elementType, ArrayType)
    return df.withColumn("labels", F.transform(ids, labels) if of_batch else labels(ids))
