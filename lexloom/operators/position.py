"""Row positions and running totals over a whole table, without one big task.

``Window.orderBy`` with no partition pulls a table into a single task, and a
window per group does the same to a group that holds much of the table.  Here
rows fall into small buckets that are monotone in the order key, coarse to fine;
totals per bucket are tiny tables, and a row's running total is the total inside
its fine bucket plus the offset of that bucket.

The buckets are computed from the key itself, so a task that runs again after
losing an executor gives the same answer.  With a unique integer key every
window group is bounded by the bucket widths, whatever the spread of the keys.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from lexloom.session import write_and_read

# Widths of the buckets of a 64-bit key, as bits left of the key: 1,024 rows in a fine
# bucket, then 2**22 buckets in each coarser one, and 1,024 in all.
FINE_BITS = 10
KEY_BITS = (54, 32, FINE_BITS)
# Buckets of a string key: at each of up to MAX_DEPTH levels a key is compared with FAN - 1 bounds.
FAN = 32
MAX_DEPTH = 3
ROWS_PER_BUCKET = 4096
SAMPLED_PER_BUCKET = 16
BOUND_CHARS = 256
# More files than this are joined to their first positions by sort instead of broadcast.
BROADCAST_FILES = 100_000


def sampled_keys(df: DataFrame, key: str, wanted: int, rows: int) -> list:
    """About ``wanted`` distinct keys out of ``rows``, four times as many at most, in order.  They are
    chosen by their hash, so the same table gives the same keys again."""
    every = max(1, rows // wanted)
    hashed = F.xxhash64(F.col(key))
    chosen = df.filter(F.col(key).isNotNull() & (F.pmod(hashed, F.lit(every)) == 0)).select(F.col(key).alias("k")).distinct()
    return sorted(r.k for r in chosen.orderBy(F.xxhash64("k"), "k").limit(4 * wanted).collect())


def with_string_levels(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that hold the bucket of a string key, coarse to fine, and their names.

    The bounds are values in the plan: a task that runs again puts a row into the same bucket.
    """
    rows = df.select(key).count()
    depth = 1
    while depth < MAX_DEPTH and FAN**depth * rows_per_bucket < rows:
        depth += 1
    sample = sampled_keys(df, key, FAN**depth * SAMPLED_PER_BUCKET, rows)
    # A bound is cut: then it comes a little earlier, and buckets are still in key order.
    bounds = [sample[i * len(sample) // FAN**depth][:BOUND_CHARS] if sample else "" for i in range(FAN**depth)]
    names: list[str] = []
    for level in range(depth):
        width = FAN ** (depth - level - 1)
        listed = [[bounds[(i * FAN + j) * width] for j in range(1, FAN)] for i in range(FAN**level)]
        all_bounds = F.from_json(F.lit(json.dumps(listed)), "array<array<string>>")
        above = F.col(names[-1]) if names else F.lit(0)
        passed = F.size(F.filter(F.get(all_bounds, above), lambda b: b <= F.col(key)))
        names.append(f"__bucket{level}")
        df = df.withColumn(names[-1], above * FAN + F.when(F.col(key).isNull(), 0).otherwise(passed))
    return df, names


def integer_levels(key: str) -> list[Column]:
    """Buckets of a unique integer key, coarse to fine; no window over them has more than
    2**22 rows, whatever the keys are."""
    return [F.shiftright(F.col(key).cast("bigint"), bits) for bits in KEY_BITS]


def hash_levels(hex_col: str) -> list[Column]:
    """65,536 even buckets of a hexadecimal hash: under a million rows each for 50 billion."""
    return [F.substring(hex_col, 1, 4)]


def _before(keys: Sequence[str], order_by: Sequence[str | Column]) -> WindowSpec:
    spec = Window.partitionBy(*keys).orderBy(*order_by) if keys else Window.orderBy(*order_by)
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    df: DataFrame,
    measures: dict[str, Column],
    order_by: Sequence[str | Column],
    levels: Sequence[Column],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add, for each measure, the total over all earlier rows of the same ``within`` group.

    ``order_by`` must order the rows of a group without ties; each of ``levels``
    must be monotone in it.  A null group is a group of its own, a null key comes first.
    """
    names = [f"__level{i}" for i in range(len(levels))]
    parts = {out: f"__part_{out}" for out in measures}
    # Keys are wrapped: a struct that holds a null is itself not null, equals its like in a
    # join, and comes first in order.
    wrapped = {f"__within{i}": F.struct(F.col(w).alias("v")) for i, w in enumerate(within)}
    base = df.withColumns(
        wrapped
        | {name: F.struct(level.alias("v")) for name, level in zip(names, levels)}
        | {parts[out]: m.cast("bigint") for out, m in measures.items()}
    )
    within = list(wrapped)

    def total_of(frame: DataFrame, keys: list[str]) -> DataFrame:
        return frame.groupBy(*keys).agg(*[F.sum(p).alias(p) for p in parts.values()])

    # Totals per bucket, finest first; each table is built from the finer one.
    totals = [total_of(base, within + names)]
    for depth in range(len(names) - 1, 0, -1):
        totals.insert(0, total_of(totals[0], within + names[:depth]))

    def offset_name(out: str) -> str:
        return f"__offset_{out}"

    offsets: DataFrame | None = None
    for depth, table in enumerate(totals):
        keys = within + names[:depth]
        spec = _before(keys, [names[depth]])
        table = table.select(
            *within,
            *names[: depth + 1],
            *[F.coalesce(F.sum(p).over(spec), F.lit(0)).alias(f"__local_{o}") for o, p in parts.items()],
        )
        if offsets is not None:
            table = table.join(offsets, keys)
        offsets = table.select(
            *within,
            *names[: depth + 1],
            *[
                (F.col(f"__local_{o}") + (F.col(offset_name(o)) if depth else F.lit(0))).alias(offset_name(o))
                for o in measures
            ],
        )

    spec = _before(within + names, order_by)
    local = base.withColumns(
        {f"__local_{o}": F.coalesce(F.sum(p).over(spec), F.lit(0)) for o, p in parts.items()}
    )
    out_columns = {o: F.col(f"__local_{o}") + F.col(offset_name(o)) for o in measures}
    joined = local.join(offsets, within + names)
    return joined.select(*df.columns, *[c.alias(o) for o, c in out_columns.items()])


def with_row_position(df: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """Zero-based position of each row in the order of a unique integer or string key, nulls first."""
    if not isinstance(df.schema[key].dataType, T.StringType):
        return running_totals(df, {out: F.lit(1)}, [key], integer_levels(key))
    leveled, levels = with_string_levels(df, key)
    return running_totals(leveled, {out: F.lit(1)}, [key], [F.col(c) for c in levels]).drop(*levels)


def _is_whole_scan(df: DataFrame) -> bool:
    """Whether ``df`` is all rows of parquet files, with columns picked or worked out row by row."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.nodeName().startswith(("LogicalRelation", "Relation")):
        return False
    try:
        df.select(df.metadataColumn("_metadata")["row_index"]).schema
    except AnalysisException:  # not files, or not of parquet
        return False
    return True


def with_source_position(df: DataFrame, out: str = "row_no", broadcast_files: int = BROADCAST_FILES) -> DataFrame:
    """Zero-based position of each row in the order of the files' paths and of the rows in a file.

    Nothing is sorted or moved: a row's place in its file is known to the scan, and a table of
    one row for each file holds how many rows stand in the files before it.  That table
    is stored and broadcast up to ``broadcast_files`` files, and joined by sort beyond.  A
    table that is not a plain scan of parquet files is written first, and numbered there.
    """
    if not _is_whole_scan(df):
        df = write_and_read(df, "in-order")
    place = df.metadataColumn("_metadata")
    placed = df.withColumn("__file", place["file_path"]).withColumn("__at", place["row_index"])
    sizes = placed.groupBy("__file").agg((F.max("__at") + 1).alias("__rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    bases = write_and_read(sizes.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base")), "file-bases")
    small = bases.limit(broadcast_files + 1).count() <= broadcast_files
    numbered = placed.join(F.broadcast(bases) if small else bases.hint("merge"), "__file")
    return numbered.select(*df.columns, (F.col("__base") + F.col("__at")).alias(out))


def row_count(df: DataFrame) -> Column:
    """The row count as a scalar subquery: no action on the driver.

    Take it from the table as it was read, not from one derived by joins and
    windows: the subquery runs its plan again.
    """
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()
