"""Projection, filter, limit, shard and batch assignment, checks and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.position import row_count, sampled_keys, with_row_position


def keep_text(df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Only the text column, and the order key where one is named."""
    return df.select(*([key] if key else []), text)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns to drop are not in the table: {missing}")
    return df.drop(*names)


def keep_allowed(df: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, set[str]]:
    """The allowed columns in table order, and the set of those ignored."""
    kept = [c for c in df.columns if c in set(allowed)]
    return df.select(*kept), set(df.columns) - set(allowed)


def min_length(df: DataFrame, ids: str, n: int) -> DataFrame:
    return df.filter(F.size(ids) >= n)


# Keys of a range that is small enough to be sorted as it is, and bounds tried in one pass.
FEW_KEYS = 100_000
BOUNDS_TRIED = 32


def nth_key(df: DataFrame, key: str, n: int, few: int = FEW_KEYS):
    """The key of the ``n``-th row (from 1) of a table with more rows, in key order, null for a null key.

    Rows are counted between bounds from a sample of the keys; the range that holds
    the ``n``-th row is cut again until it is small or holds one key.  Only the key column is
    read, each pass is one count, and one row for each bound comes back.
    """
    keys = df.select(F.col(key).alias("k"))
    rows, known = keys.agg(F.count(F.lit(1)), F.count("k")).first()
    if n <= rows - known:
        return None
    left, size, inside = n - (rows - known), known, keys.filter("k IS NOT NULL")
    while size > few:
        bounds = sampled_keys(inside, "k", BOUNDS_TRIED, size)
        if not bounds:
            break
        listed = F.array(*[F.lit(b) for b in bounds])
        counted = inside.groupBy(F.size(F.filter(listed, lambda b: b < F.col("k"))).alias("i")).agg(
            F.count(F.lit(1)).alias("n"), F.min("k").alias("least"), F.max("k").alias("most")
        )
        for part in counted.orderBy("i").collect():
            if left <= part.n:
                break
            left -= part.n
        if part.least == part.most:
            return part.least
        if part.n == size:
            break  # no bound inside this range was sampled
        size, inside = part.n, keys.filter((F.col("k") >= F.lit(part.least)) & (F.col("k") <= F.lit(part.most)))
    return inside.orderBy("k").limit(left).agg(F.max("k")).first()[0]


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` rows in key order, nulls first; a negative ``n`` keeps all.

    The rows are those of a filter by the ``n``-th key, found beforehand: nothing but the key is
    read for it and no row is moved.  Only where several rows have that key and some of them
    are too many, those rows alone are ordered by the other columns (as far as these have an
    order), and the first are taken.
    """
    if n < 0:
        return df
    if n == 0 or df.count() <= n:
        return df if n else df.filter(F.lit(False))
    last = nth_key(df, key, n)
    tied = F.col(key).isNull() if last is None else F.col(key) == F.lit(last)
    before = F.lit(False) if last is None else F.col(key).isNull() | (F.col(key) < F.lit(last))
    n_before, n_tied = df.agg(F.count_if(before), F.count_if(tied)).first()
    if n_before + n_tied == n:
        return df.filter(before | tied)
    others = [f.name for f in df.schema.fields if f.name != key and "map<" not in f.dataType.simpleString()]
    return df.filter(before).unionAll(df.filter(tied).orderBy(*others).limit(n - n_before))


def assign_batches(
    df: DataFrame, key: str | None, shards: int = 16, batch_size: int = 2024, pos: str | None = None
) -> DataFrame:
    """Contiguous shards of almost equal size, and consecutive batches inside each.

    With ``pos``, a column that already holds the row positions, no key is needed and no
    row is moved.

    Adds ``shard``, ``batch_id`` (consecutive over all shards), ``pos_in_batch``
    and ``batch_rows``.  The first ``n mod shards`` shards have one row more.
    """
    if shards < 1 or batch_size < 1:
        raise ValueError("shards and batch_size must be positive")
    out = df.withColumn("__pos", F.col(pos)) if pos else with_row_position(df, key, "__pos")
    out = out.withColumn("__n", row_count(df))
    n, pos = F.col("__n"), F.col("__pos")
    small = F.floor(n / shards)
    extra = n % shards
    in_large = extra * (small + 1)
    # With fewer rows than shards every row lies in a large shard.
    shard = F.when(pos < in_large, F.floor(pos / (small + 1))).otherwise(
        extra + F.floor((pos - in_large) / F.greatest(small, F.lit(1)))
    )
    out = out.withColumn("__small", small).withColumn("__extra", extra).withColumn("shard", shard.cast("int"))
    small, extra, shard = F.col("__small"), F.col("__extra"), F.col("shard")
    in_shard = pos - (small * shard + F.least(shard, extra))
    shard_rows = small + F.when(shard < extra, 1).otherwise(0)
    large_batches = F.ceil((small + 1) / batch_size)
    small_batches = F.ceil(small / batch_size)
    batches_before = F.least(shard, extra) * large_batches + F.greatest(shard - extra, F.lit(0)) * small_batches
    in_batch = F.floor(in_shard / batch_size)
    return out.select(
        *df.columns,
        "shard",
        (batches_before + in_batch).cast("bigint").alias("batch_id"),
        (in_shard % batch_size).cast("int").alias("pos_in_batch"),
        F.least(F.lit(batch_size), shard_rows - in_batch * batch_size).cast("int").alias("batch_rows"),
    )


def drop_partial_batches(df: DataFrame, batch_size: int = 2024) -> DataFrame:
    """Without the short last batch of each shard; sizes are known, so nothing moves."""
    return df.filter(F.col("batch_rows") == batch_size)


def required_columns_report(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows, nulls and empty arrays of each required column, in one pass.

    A missing column is an error when the plan is analysed.
    """
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}")
    is_array = {f.name: f.dataType.typeName() == "array" for f in df.schema.fields}

    entries = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(n).isNull()).alias("n_null"),
            (F.count_if(F.size(n) == 0) if is_array[n] else F.lit(0).cast("bigint")).alias("n_empty"),
        )
        for n in names
    ]
    return df.agg(F.array(*entries).alias("r")).select(F.inline("r"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def with_length(df: DataFrame, ids: str, out: str = "length") -> DataFrame:
    return df.withColumn(out, F.size(ids))


def longest_per_batch(df: DataFrame, ids: str, batch: str = "batch_id") -> DataFrame:
    return df.groupBy(batch).agg(F.max(F.size(ids)).alias("longest"))


def bin_totals(df: DataFrame, length: str, batch: str = "batch_id", bin_col: str = "bin") -> DataFrame:
    return df.groupBy(batch, bin_col).agg(F.sum(length).alias("total"))
