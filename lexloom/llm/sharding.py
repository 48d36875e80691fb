"""Sharding by a Feistel permutation of global row numbers; native.

Row i of n goes to place p(i), where p is a keyed permutation of 0 .. n-1: a Feistel
network over the smallest rectangle a x b of at least n cells, walked on along its
cycle while it lands outside 0 .. n-1.  Place p belongs to shard ``p mod shards`` at
slot ``p div shards``, so shard sizes differ by one row at most, slots have no gaps,
and shard and slot of any row can be computed from its number alone.

Defined cases: rows are numbered in the order of key, text checksum and size, nulls
first; rows equal in all three are interchangeable.  A null text has size 1 and the
checksum of nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import number_rows

MASK = (1 << 31) - 1
ROUNDS = 6
WALK = 40


def rectangle(rows: int) -> tuple[int, int]:
    """(a, b): a * b is at least ``rows`` and exceeds it by less than a."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def round_keys(seed: int) -> list[int]:
    return [((seed + 1) * 747796405 + (i + 1) * 277803737) & MASK for i in range(ROUNDS)]


def permuted(number: Column | str, rows: int, seed: int) -> Column:
    """One pass of the network over 0 .. a*b-1."""
    a, b = rectangle(rows)
    number = F.col(number) if isinstance(number, str) else number
    # A struct for each round keeps the expression linear in the number of rounds.
    state = F.struct((number % a).alias("l"), divided(number, a).alias("r"))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).cast("bigint").alias("k")) for i, k in enumerate(round_keys(seed))])

    def step(s: Column, key: Column) -> Column:
        even = key["i"] % 2 == 0
        half = F.when(even, s["r"]).otherwise(s["l"])
        hashed = hash31(half, key["k"])
        return F.struct(
            F.when(even, (s["l"] + hashed) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + hashed) % b).alias("r"),
        )

    return F.aggregate(keys, state, step, lambda s: s["l"] + s["r"] * a)


def divided(number: Column, by: int) -> Column:
    """Whole quotient in integers: a division of doubles is inexact beyond 2**53."""
    return F.call_function("div", number, F.lit(by).cast("bigint"))


def hash31(value: Column, key: Column) -> Column:
    x = (value + key).bitwiseAND(F.lit(MASK))
    for factor, shift in ((739982445, 15), (695872825, 12)):
        x = (x * F.lit(factor).cast("bigint")).bitwiseAND(F.lit(MASK))
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x


def permute(number: Column, rows: int, seed: int = 0) -> Column:
    """Place of row ``number`` of ``rows``: the network, walked on while it lands outside.

    Fewer than a of the a * b cells lie outside, so a step stays outside with a chance
    of 1 in b at most; a walk of over 40 steps is an error, not a wrong place.
    """
    first = permuted(number, rows, seed)
    steps = F.sequence(F.lit(1), F.lit(WALK))
    walked = F.aggregate(steps, first, lambda p, _: F.when(p < rows, p).otherwise(permuted(p, rows, seed)))
    checked = F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))
    return F.when(first < rows, first).otherwise(checked)


def assign_shards(docs: DataFrame, key: str, text: str, shards: int, seed: int = 0) -> DataFrame:
    """``key``, ``size`` (UTF-8 bytes plus one), ``text_crc32``, ``row_no``, ``shard``, ``slot``.

    Only keys, sizes and checksums are moved; texts are read once to be measured.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("__key"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    numbered = number_rows(rows, ["__key", "text_crc32", "size"], "row_no", "shard-rows")
    total = numbered.count()
    place = permute(F.col("row_no"), total, seed)
    return numbered.withColumn("__place", place).select(
        F.col("__key").alias(key),
        "size",
        "text_crc32",
        "row_no",
        (F.col("__place") % shards).cast("int").alias("shard"),
        divided(F.col("__place"), shards).alias("slot"),
    )
