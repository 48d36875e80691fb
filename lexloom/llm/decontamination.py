"""Benchmark decontamination: size-partitioned MinHash containment search; native.

A test item is contained in a document when ``threshold`` or more of its distinct
shingles of ``SHINGLE`` words stand in it.  Items are short and documents long, so a
MinHash of the document says little about one item.  The minima are therefore taken on
the item's side: under each of ``MINIMA`` hash functions an item's least shingle stands
in a document with a chance equal to the containment, so a contained item is missed
with a chance of (1 - threshold) ** MINIMA (4e-9 as set).  Items and documents are
partitioned by size: an item is looked for only in the partitions whose documents have
enough shingles to contain it.  Documents are never sampled or cut; each candidate is
verified by exact containment of the shingle sets.

Words are runs of letters and digits in lower case.

Defined cases: null texts have no shingles; an item of fewer than ``SHINGLE`` words has
none and is found nowhere; repeated items and documents are reported row by row; an
empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import named_apart, stored_rows
from lexloom.session import write_and_read

SHINGLE = 5
THRESHOLD = 0.8
MINIMA = 12
WORDS = r"[\\p{L}\\p{N}]+"  # as a SQL literal


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: 64-bit hashes of all runs of ``SHINGLE`` words, in order.

    The words are bound to a variable of a lambda: as a column they would be put into
    the inner lambda by the optimizer, and found anew for every run.
    """
    words = f"regexp_extract_all(lower(coalesce(`{text}`, '')), '{WORDS}', 0)"
    run = ", ".join(f"w[i + {j}]" for j in range(SHINGLE))
    return df.withColumn(
        out,
        F.expr(
            f"""element_at(transform(array({words}), w -> CASE WHEN size(w) >= {SHINGLE}
            THEN transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({run}))
            ELSE cast(array() AS array<bigint>) END), 1)"""
        ),
    )


def unsearched_items(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``item_key`` of the items that ``find_items`` looks for nowhere: those of fewer words than a shingle."""
    rows = items.select(F.col(item_key).alias("__item"), F.col(item_text).alias("__text"))
    return with_shingles(rows, "__text", "__set").filter(F.size("__set") == 0).select(F.col("__item").alias(item_key))


def size_class(n: Column) -> Column:
    """Partition of a set of n shingles: the power of two at or below n."""
    # Never null, so that no test for null makes the shingles twice.
    return F.coalesce(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0))


def find_items(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, threshold: float = THRESHOLD
) -> DataFrame:
    """``key``, ``item``, ``n_shared``, ``n_item``, ``containment``: one row for each contained item.

    Rows are told apart by their place in the stored table.
    """
    return find_in(stored_rows(docs), key, text, items, item_key, item_text, threshold)


def find_in(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, threshold: float = THRESHOLD
) -> DataFrame:
    """``find_items`` for rows that have their number, ``__row``."""
    item_rows = items.select(F.col(item_key).alias("__item"), F.col(item_text).alias("__text")).withColumn(
        "__item_row", F.monotonically_increasing_id()
    )
    sets = with_shingles(item_rows, "__text", "__set").withColumn("__set", F.array_distinct("__set"))
    sets = write_and_read(sets.filter(F.size("__set") > 0).select("__item", "__item_row", "__set"), "items")
    least = F.min_by("__shingle", F.xxhash64("__shingle", "__seed"))
    probes = (
        sets.select("__item_row", F.size("__set").alias("__n"), F.explode("__set").alias("__shingle"))
        .withColumn("__seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(MINIMA - 1).cast("bigint"))))
        .groupBy("__item_row", "__seed", "__n")
        .agg(least.alias("__shingle"))
        .select("__item_row", "__shingle", size_class(F.ceil(F.col("__n") * threshold)).alias("__class"))
        .distinct()
    )
    # Written, so that Spark knows its size and broadcasts it only when it is small.
    probes = write_and_read(probes, "probes")
    rows = docs.select("__row", F.col(key).alias("__key"), F.col(text).alias("__text"))
    marked = with_shingles(rows, "__text", "__shingles").select(
        "__row", size_class(F.size("__shingles")).alias("__size_class"), F.explode_outer("__shingles").alias("__shingle")
    )  # explode() would test the size first, in a filter that makes the shingles twice
    hits = marked.join(probes, "__shingle").filter("__size_class >= __class")
    candidates = write_and_read(hits.select("__row", "__item_row").distinct(), "candidates")
    texts = rows.join(candidates, "__row")
    shared = with_shingles(texts, "__text", "__shingles").join(sets, "__item_row")
    shared = shared.select(
        F.col("__key").alias(key),
        F.col("__item").alias("item"),
        F.col("__row").alias("doc_row"),
        F.size(F.array_intersect("__shingles", "__set")).alias("n_shared"),
        F.size("__set").alias("n_item"),
    )
    found = shared.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return found.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_item"))


def drop_contaminated(docs: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns as they were."""
    apart, names, as_they_were = named_apart(docs)
    marked = stored_rows(apart)
    found = find_in(marked, "__row", names[text], items, item_key, item_text, **options)
    found = write_and_read(found.select("__row").distinct(), "contaminated")
    return marked.join(found, "__row", "left_anti").select(*as_they_were)
