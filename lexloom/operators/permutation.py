"""A keyed permutation of row positions with an inverse: no table is ranked or stored.

The positions 0 … n-1 lie in a square of side ``ceil(sqrt(n))``.  Each round swaps the two
coordinates and adds a keyed function of the one to the other, so it can be undone
whatever that function is.  A position that comes out at ``n`` or above is put through
again until it comes out below; the square has fewer than ``2 * side`` such places.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
PRIME = 2**31 - 1
# For up to 1,000 rows a walk cannot be longer; for more it is so with a chance under 1e-70.
MOST_WALKS = 66


def round_keys(seed: int) -> list[tuple[int, int]]:
    """The factor and the addend of each round."""

    def number(i: int, part: str) -> int:
        return int(hashlib.md5(f"{seed}|{i}|{part}".encode()).hexdigest()[:12], 16) % (PRIME - 1) + 1

    return [(number(i, "factor"), number(i, "addend")) for i in range(ROUNDS)]


def _added(x: Column, key: Column) -> Column:
    line = (x * key["f"] + key["a"]) % PRIME
    return line * line % PRIME + x * key["a"] % PRIME


def _walk(pos: Column, n: int, seed: int, inverse: bool) -> Column:
    side = math.isqrt(n - 1) + 1 if n else 1
    if side > PRIME:
        raise ValueError("more rows than a permutation of 62 bits can hold")
    pairs = round_keys(seed)
    keys = F.array(*[F.struct(F.lit(f).cast("bigint").alias("f"), F.lit(a).cast("bigint").alias("a")) for f, a in pairs[:: -1 if inverse else 1]])

    def forth(at: Column, key: Column) -> Column:
        return F.struct(at["r"].alias("l"), ((at["l"] + _added(at["r"], key)) % side).alias("r"))

    def back(at: Column, key: Column) -> Column:
        return F.struct(F.pmod(at["r"] - _added(at["l"], key), F.lit(side)).alias("l"), at["l"].alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, F.lit(side)).alias("l"), (x % side).alias("r"))
        return F.aggregate(keys, start, back if inverse else forth, lambda at: at["l"] * side + at["r"])

    walks = F.sequence(F.lit(1), F.lit(min(2 * side, MOST_WALKS)))
    end = F.aggregate(walks, once(pos.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("a walk of the permutation did not end")).cast("bigint"))


def shuffled_position(pos: Column, n: int, seed: int = 0) -> Column:
    """Where the row at ``pos`` stands after the permutation of ``n`` rows named by ``seed``."""
    return _walk(pos, n, seed, inverse=False)


def original_position(pos: Column, n: int, seed: int = 0) -> Column:
    """Which row stands at ``pos`` after that permutation."""
    return _walk(pos, n, seed, inverse=True)


def batch_rows(
    spark: SparkSession, n: int, ranks: int, batch_size: int, seed: int = 0, epoch: int = 0, first_batch: int = 0
) -> DataFrame:
    """``rank``, ``batch``, ``idx``, ``pos``: the rows of all batches of an epoch from ``first_batch`` on.

    Rows left over after equal shares and full batches are dropped.  The positions are worked
    out from the batch numbers: a run that starts again reads no rows of finished batches.
    """
    if ranks < 1 or batch_size < 1 or first_batch < 0:
        raise ValueError("ranks and batch_size must be positive, and no batch is before the first")
    per_batch = ranks * batch_size
    batches = n // ranks // batch_size
    flat = spark.range(min(first_batch, batches) * per_batch, batches * per_batch)
    idx = F.floor(F.col("id") / ranks)
    return flat.select(
        (F.col("id") % ranks).cast("int").alias("rank"),
        F.floor(F.col("id") / per_batch).alias("batch"),
        idx.alias("idx"),
        original_position(F.col("id"), n, seed + epoch).alias("pos"),
    )
