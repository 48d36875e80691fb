"""Mixing sources to target weights by entropy balancing; native.

Each source has a target number of words.  Among all rates r of its documents that
reach the target, none above ``MOST`` times, entropy balancing takes those nearest to
one in relative entropy.  The dual of that convex problem has one multiplier for each
token constraint, so for each source, and rates are exponentially tilted by size:
``r = min(MOST, exp(multiplier * size / mean size))``.  Safeguarded Newton iterations
find the multipliers; each is one distributed sum over the counts of (source, size).

Rates become whole copies by adding a fixed random fraction to each rate, from the number of
the row, and taking the whole part.  What then lacks to a source's target is made up by a shift
of all its fractions, found from sums over narrowing ranges of fractions: the largest shift that
does not go beyond the target.  So the copies of a row are an expression of the row and of
its source's few numbers: no row is moved, ordered or looked up.  Rates are taken to 2**-24 and
sums of rates are sums of integers, so reruns agree.

Defined cases: a null source is one source, last in order; sources that are not strings are
ordered by their own order and come back as they are; a null text has no words and is taken
once, for nothing; repeated rows are rounded one by one, rows of one key too; an empty table
gives no rows; columns may have any names.  More sources than ``max_sources`` are an error: their
targets are settled on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import named_apart, stored_rows, word_count
from lexloom.session import write_and_read

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
MAX_SOURCES = 100_000
ROUND_LIMIT = 100
FRACTION_BITS = 24
RANGE_BITS = 12  # a range of fractions is cut into so many, twice
SUM_SCALE = 1024


def source_targets(sizes: Sequence[int], weights: Sequence[float], most: int = MOST) -> list[float]:
    """Shares of all sizes by repeated weights; what a source cannot take (over ``most``
    times its size) goes to the others by weight, until none is above."""
    shares = [weights[i % len(weights)] for i in range(len(sizes))]
    targets, open_ones, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_ones:
        unit = rest / math.fsum(shares[i] for i in open_ones)
        full = {i for i in open_ones if shares[i] * unit > most * sizes[i]}
        for i in full or open_ones:
            targets[i] = float(most * sizes[i]) if full else shares[i] * unit
        if not full:
            break
        open_ones -= full
        rest = float(sum(sizes)) - math.fsum(targets[i] for i in range(len(sizes)) if i not in open_ones)
    return targets


def tilted(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    """min(most, exp(multiplier * size / mean)); the exponent is cut where exp would overflow."""
    exponent = F.least(multiplier * size / mean, F.lit(math.log(most)))
    return F.least(F.exp(exponent), F.lit(float(most)))


def solve_multipliers(counts: DataFrame, sources: list[dict], most: int = MOST, tolerance: float = 1e-9) -> None:
    """Set ``multiplier`` of each source; ``counts``: ``__number`` of the source, ``size``, ``n``.

    Newton's step on the dual where it stays within the bracket of signs seen so far,
    half the bracket (or twice its end, while it is open) where it does not.
    """
    spark = counts.sparkSession
    for s in sources:
        s["multiplier"], s["low"], s["high"], s["done"] = 0.0, -math.inf, math.inf, False
        if s["target"] >= most * s["size"]:  # all at the limit
            s["multiplier"], s["done"] = math.inf, True
    for _ in range(ROUND_LIMIT):
        live = [s for s in sources if not s["done"]]
        if not live:
            return
        given = spark.createDataFrame(
            [(s["index"], s["multiplier"], s["mean"]) for s in live], "__number int, multiplier double, mean double"
        )
        joined = counts.join(F.broadcast(given), "__number")  # at most max_sources rows
        rate = tilted(F.col("multiplier"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
        whole = lambda c: F.sum(F.round(c * SUM_SCALE).cast("bigint"))
        sums = joined.groupBy("__number").agg(whole(words).alias("words"), whole(slope).alias("slope")).collect()
        for row in sums:
            s = sources[row["__number"]]
            over = row["words"] / SUM_SCALE - s["target"]
            at = s["multiplier"]
            if abs(over) <= max(tolerance * s["target"], 1 / SUM_SCALE) or at in (s["low"], s["high"]):
                s["done"] = True
                continue
            s["high" if over > 0 else "low"] = at
            step = at - over * SUM_SCALE / row["slope"] if row["slope"] else math.nan
            if not s["low"] < step < s["high"]:
                if math.isinf(s["low"]) or math.isinf(s["high"]):
                    step = at + math.copysign(max(1.0, abs(at)), -over)
                else:
                    step = (s["low"] + s["high"]) / 2
            s["multiplier"] = step


def fraction_of(row: Column) -> Column:
    """A number below 2**FRACTION_BITS that belongs to the row."""
    return F.xxhash64(row).bitwiseAND(F.lit((1 << FRACTION_BITS) - 1))


def copies_of(size: Column, rate: Column, fraction: Column, shift: Column, most: int) -> Column:
    """Rate, fraction and shift together, rounded down; a row without words is taken once."""
    unit = 1 << FRACTION_BITS
    total = F.round(rate * unit).cast("bigint") + fraction + shift
    return F.when(size == 0, 1).otherwise(F.least(F.greatest(F.shiftright(total, FRACTION_BITS), F.lit(0)), F.lit(most))).cast("int")


def rate_of(size: Column, most: int) -> Column:
    return F.when(size == 0, F.lit(1.0)).otherwise(tilted(F.col("multiplier"), size, F.col("mean"), most))


def find_shifts(rated: DataFrame, sources: list[dict], most: int) -> None:
    """Set ``shift`` of each source; ``rated``: ``__number``, ``size``, ``__rate``, ``__fraction``."""
    spark = rated.sparkSession
    copies = copies_of(F.col("size"), F.col("__rate"), F.col("__fraction"), F.lit(0), most)
    counted = write_and_read(rated.withColumn("copies", copies), "mix-fractions")
    for s in sources:
        s["shift"] = 0
    taken = counted.groupBy("__number").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    lacks = {r["__number"]: int(round(sources[r["__number"]]["target"] - r["taken"])) for r in taken}
    # How far a row is from one copy more, or from one less where the source has too much.
    lack = F.col("__lack")
    total = F.round(F.col("__rate") * (1 << FRACTION_BITS)).cast("bigint") + F.col("__fraction")
    beyond = total - F.shiftleft(F.shiftright(total, FRACTION_BITS), FRACTION_BITS)
    way = F.when(lack > 0, (1 << FRACTION_BITS) - beyond).otherwise(beyond + 1) - 1
    can = (F.col("size") > 0) & F.when(lack > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    start = {n: 0 for n, x in lacks.items() if x}
    left = {n: abs(lacks[n]) for n in start}
    for level in range(FRACTION_BITS // RANGE_BITS):
        if not start:
            break
        step = FRACTION_BITS - RANGE_BITS * (level + 1)
        given = spark.createDataFrame([(n, lacks[n], start[n], left[n]) for n in start], "__number int, __lack bigint, __start bigint, __left bigint")
        near = counted.join(F.broadcast(given), "__number").filter(can)  # at most max_sources rows
        near = near.withColumn("__range", F.shiftright(way - F.col("__start"), step)).filter(f"__range BETWEEN 0 AND {(1 << RANGE_BITS) - 1}")
        sums = near.groupBy("__number", "__left", "__range").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("__number").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passed = sums.withColumn("upto", F.sum("words").over(upto)).filter("upto <= __left")
        # The ranges before the first one that would go too far, empty ones included.
        over = sums.withColumn("upto", F.sum("words").over(upto)).filter("upto > __left").groupBy("__number").agg(F.min("__range").alias("first"))
        reached = passed.groupBy("__number").agg(F.max("upto").alias("words"))
        found = reached.join(over, "__number", "full").collect()
        first = {r["__number"]: (1 << RANGE_BITS) if r["first"] is None else r["first"] for r in found}
        for n in list(start):
            start[n] += first.get(n, 1 << RANGE_BITS) << step
            left[n] -= next((r["words"] or 0 for r in found if r["__number"] == n), 0)
            sources[n]["shift"] = start[n] if lacks[n] > 0 else -start[n]
            if first.get(n, 1 << RANGE_BITS) == 1 << RANGE_BITS:
                del start[n], left[n]  # every row that could change has changed


def source_table(sized: DataFrame, weights: Sequence[float], most: int, max_sources: int) -> DataFrame:
    """``__number``, ``__name``, ``source_size``, ``target``, ``mean``, ``multiplier``, ``shift``: one row for
    each source, at most ``max_sources``; ``sized`` has ``__row``, ``__source``, ``size``."""
    spark = sized.sparkSession
    kind = sized.schema["__source"].dataType.simpleString()
    found = sized.groupBy("__source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = found.limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    # Python orders strings by code point, as UTF-8 does.
    named, unnamed = [r for r in found if r["__source"] is not None], [r for r in found if r["__source"] is None]
    found = sorted(named, key=lambda r: r["__source"]) + unnamed
    targets = source_targets([r["size"] for r in found], weights, most)
    sources = [
        {"index": i, "name": r["__source"], "size": r["size"], "target": t, "mean": max(r["size"] / r["n"], 1e-9)}
        for i, (r, t) in enumerate(zip(found, targets))
    ]
    schema = f"__number int, __name {kind}, source_size bigint, target double, mean double, multiplier double, shift bigint"

    def given() -> DataFrame:
        fields = ("index", "name", "size", "target", "mean")
        rows = [(*(s[f] for f in fields), s.get("multiplier", 0.0), s.get("shift", 0)) for s in sources]
        return F.broadcast(spark.createDataFrame(rows, schema))

    def with_source() -> DataFrame:
        return sized.join(given(), F.col("__source").eqNullSafe(F.col("__name")))

    counts = with_source().filter("size > 0").groupBy("__number", "size").agg(F.count(F.lit(1)).alias("n"))
    solve_multipliers(write_and_read(counts, "mix-counts"), sources, most)
    rated = with_source().select(
        "__number", "size", rate_of(F.col("size"), most).alias("__rate"), fraction_of(F.col("__row")).alias("__fraction")
    )
    find_shifts(rated, sources, most)
    return given()


def mix(
    docs: DataFrame,
    key: str,
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """``key``, ``size`` (words), ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    Row numbers, keys, sources and sizes are written once; every later pass reads those, not the texts.
    """
    apart, names, _ = named_apart(docs)
    rows = stored_rows(apart).select(
        "__row", F.col(names[key]).alias("__key"), F.col(names[source]).alias("__source"), word_count(F.col(names[text])).alias("size")
    )
    sized = write_and_read(rows, "mix-sizes")
    given = source_table(sized.select("__row", "__source", "size"), weights, most, max_sources)
    rated = sized.join(given, F.col("__source").eqNullSafe(F.col("__name"))).withColumn("rate", rate_of(F.col("size"), most))
    copies = copies_of(F.col("size"), F.col("rate"), fraction_of(F.col("__row")), F.col("shift"), most)
    return rated.withColumn("copies", copies).select(
        F.col("__key").alias(key), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat_rows(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with their columns as they were.

    The copies of a row are worked out where it stands: no text is moved.
    """
    apart, names, as_they_were = named_apart(docs)
    marked = stored_rows(apart)
    size = word_count(F.col(names[text]))
    sized = write_and_read(marked.select("__row", F.col(names[source]).alias("__source"), size.alias("size")), "mix-sizes")
    given = source_table(sized, weights, most, max_sources)
    # The size is worked out once more, beside the text, rather than joined to it.
    rows = marked.withColumn("__size", size).join(given, F.col(names[source]).eqNullSafe(F.col("__name")))
    copies = copies_of(F.col("__size"), rate_of(F.col("__size"), most), fraction_of(F.col("__row")), F.col("shift"), most)
    times = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("__copy", F.explode(times)).select(*as_they_were)
