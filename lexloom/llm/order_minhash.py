"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, each labelled with how often it has stood
before in the text.  Under each of ``SKETCHES`` hash functions the ``PICKED`` least
labelled k-mers are taken in the order of the text; their hash is a bucket.  Texts of
similarity 0.8 share one of the 16 buckets but for a chance of about 1e-5.  Unlike a
MinHash of sets, texts with the same k-mers in another order part.

Candidates are verified by a banded alignment of their labelled k-mers: the longest
chain of equal k-mers in the order of both texts, within a band around the diagonal
that no pair of the needed similarity leaves.  The similarity is the chain over all
k-mers of both texts, chained ones counted once: the resemblance of 5-word shingles,
with order.

No bucket is expanded into all pairs:

1. Equal texts are one representative from the start.
2. Each member of a bucket is compared with four members: the shortest, the longest, one
   by hash, and the most central one, whose buckets have the most members: among copies
   of one text that is the text itself.  Verified pairs give components.
3. A bucket whose members ended in one component is done.  In the others each member
   outside the bucket's largest component is compared with all members of other
   components, so no candidate pair between components is left out.  Large buckets are
   compared in chunks of about ``CHUNK_MEMBERS`` members.

A pair is compared in three steps, each for what the one before leaves over:

- Bitmaps of 1024 bits, a bit for whether an odd number of k-mers falls on it.  Two texts
  differ in at least as many k-mers as their bitmaps in bits, so this test is exact.
- The least k-mers of both, all of them for texts of up to 256: then this is exact too.
  Longer texts of similarity 0.8 fail it with a chance of 1.4e-5 at most.
- Alignment.

Defined cases: words are in lower case, split at ASCII white space.  Null texts and
texts without words are equal texts.  A text of one to four words has one k-mer, all of
it.  Repeated rows and rows of one key are separate rows of one class.  A class is named
by its least key, null where it has none.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import named_apart, stored_rows
from lexloom.llm.components import connected_components
from lexloom.llm.token_files import open_folder
from lexloom.session import new_stage_path, write_and_read

WORDS_PER_KMER = 5
THRESHOLD = 0.8
SKETCHES = 16
PICKED = 3
LEAST_KMERS = 256
LEAST_SLACK = 0.11
BITMAP_WORDS = 16
CHUNK_MEMBERS = 1000
KNOWN_WORDS = 100_000
ROWS_AT_ONCE = 500  # rows whose sketches a task holds
LIST_BITS, LISTS_BITS = 10, 12  # rows to a list of kmers_of at least; lists at most


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE = [np.uint64(f | 1) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def in_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, ``ROWS_AT_ONCE`` at a time: what is made of them is larger than its texts."""
    for frame in frames:
        for begin in range(0, len(frame), ROWS_AT_ONCE):
            yield frame.iloc[begin : begin + ROWS_AT_ONCE]


class Sketcher:
    """Labelled k-mers and sketches of texts; the hashes of words are kept, bounded in number."""

    def __init__(self):
        import xxhash

        self.hash, self.hash128, self.known = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest, {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").lower().encode("utf-8", "surrogatepass").split()

    def kmers(self, words: list[bytes]) -> np.ndarray:
        """64-bit labelled k-mers in the order of the text."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - WORDS_PER_KMER + 1
        if n < 1:
            return mix64(np.array([self.hash(b" ".join(words))], np.uint64)) if words else np.zeros(0, np.uint64)
        k = np.zeros(n, np.uint64)
        for j in range(WORDS_PER_KMER):
            k += h[j : j + n] * PLACE[j]
            k ^= k >> np.uint64(29)
        k = mix64(k)
        order = np.argsort(k, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = k[order][1:] == k[order][:-1]
        if same.any():
            at = np.arange(n)
            first = np.maximum.accumulate(np.where(same, 0, at))
            label = np.zeros(n, np.uint64)
            label[order] = (at - first).astype(np.uint64)
            k = np.where(label > 0, mix64(k + label * PLACE[0]), k)
        return k

    def buckets(self, k: np.ndarray) -> np.ndarray:
        """One bucket for each hash function; labelled k-mers in the order of the text make it."""
        if not len(k):
            return np.zeros(0, np.int64)
        picked = min(PICKED, len(k))
        values = mix64(k[None, :] ^ SEEDS[:, None])
        at = np.argpartition(values, picked - 1, axis=1)[:, :picked]
        at.sort(axis=1)
        key = SEEDS.copy()
        for j in range(picked):
            key = mix64(key * PLACE[1] + k[at[:, j]])
        return key.view(np.int64)


def bitmap(k: np.ndarray) -> np.ndarray:
    """1024 bits as 64-bit integers: the parity of the number of k-mers on each."""
    odd = np.bincount((k >> np.uint64(54)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Chained k-mers over all k-mers of both texts; 0 where the threshold is out of reach."""
    total = len(a) + len(b)
    needed = threshold / (1 + threshold) * total
    common, i, j = np.intersect1d(a, b, return_indices=True)
    if not total or len(common) < needed:
        return 0.0
    # Texts of the needed similarity leave total - 2 * needed k-mers unmatched at most.
    band = int(total - 2 * needed) + 1
    j = j[np.argsort(i)]
    i = np.sort(i)
    j = j[np.abs(i - j) <= band]
    if np.all(j[1:] > j[:-1]):
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        chain = len(tails)
    return chain / (total - chain)


def sketch(rows: DataFrame) -> DataFrame:
    """``__row``, ``__key``, ``content``, ``n``, ``buckets``, ``least``, ``bits`` from ``__row``, ``__key``, ``__text``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher()
        for frame in in_pieces(frames):
            out = []
            for text in frame["__text"].array:
                words = sketcher.words(text)
                k = sketcher.kmers(words)
                least = np.sort(np.partition(k, LEAST_KMERS)[:LEAST_KMERS] if len(k) > LEAST_KMERS else k)
                least = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                out.append((sketcher.hash128(b" ".join(words)), len(k), sketcher.buckets(k), least, bitmap(k)))
            yield pd.DataFrame(
                {"__row": frame["__row"], "__key": frame["__key"]}
                | dict(zip(("content", "n", "buckets", "least", "bits"), zip(*out)))
            )

    schema = "__row bigint, __key string, content binary, n bigint, buckets array<bigint>, least array<int>, bits array<bigint>"
    # A key passes as text, which pandas leaves as it is.
    made = rows.withColumn("__key", F.col("__key").cast("string")).mapInPandas(run, schema)
    return made.withColumn("__key", F.col("__key").cast(rows.schema["__key"].dataType))


def list_numbers(rows: DataFrame, numbers: DataFrame) -> tuple[str, int]:
    """A folder of the shared folder with ``numbers`` (``__row``) by ranges, and the bits of a range."""
    folder = new_stage_path(rows.sparkSession, "wanted")
    last = rows.agg(F.max("__row")).first()[0] or 0
    bits = max(LIST_BITS, last.bit_length() - LISTS_BITS)
    listed = numbers.withColumn("part", F.shiftright("__row", bits))
    listed.repartition("part").write.partitionBy("part").parquet(folder)
    return folder, bits


def listed_among(folder: str, bits: int):
    """A function from row numbers to which of them are listed, for one task: it reads the
    lists of the ranges it meets, whichever rows it was given, and keeps those of the last call."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = open_folder(folder)
    lists: dict[int, np.ndarray] = {}

    def listed(part: int) -> np.ndarray:
        own = fs.FileSelector(f"{path}/part={part}", allow_not_found=True)
        files = [f.path for f in store.get_file_info(own) if f.path.endswith(".parquet")]
        read = [pq.ParquetFile(store.open_input_file(f)).read(["__row"]).column(0).to_numpy() for f in files]
        return np.concatenate(read) if read else np.zeros(0, np.int64)

    def among(numbers: np.ndarray) -> np.ndarray:
        parts = np.unique(numbers >> bits).tolist()
        now = {p: lists[p] if p in lists else listed(p) for p in parts}
        lists.clear()
        lists.update(now)
        return np.isin(numbers, np.concatenate([*now.values(), np.zeros(0, np.int64)]))

    return among


def kmers_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``__row``, ``kmers`` of the rows in ``pairs``, found where they are: no text is moved.

    Wanted rows are listed in the shared folder by ranges of their numbers.
    """
    folder, bits = list_numbers(rows, pairs.select(F.explode(F.array("a", "b")).alias("__row")).distinct())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        among, sketcher = listed_among(folder, bits), Sketcher()
        for frame in in_pieces(frames):
            frame = frame[among(frame["__row"].to_numpy())]
            if len(frame):
                short = [(sketcher.kmers(sketcher.words(t)) >> np.uint64(32)).astype("<u4").tobytes() for t in frame["__text"].array]
                yield pd.DataFrame({"__row": frame["__row"], "kmers": short})

    found = write_and_read(rows.select("__row", "__text").mapInPandas(run, "__row bigint, kmers binary"), "kmers")
    n_found = found.count()
    n_wanted = rows.sparkSession.read.schema("__row bigint, part bigint").parquet(folder).count()
    if n_found != n_wanted:
        raise RuntimeError(f"{n_wanted} rows wanted, {n_found} found: the table changed between two jobs")
    return found


def aligned(pairs: DataFrame, kmers: DataFrame, threshold: float) -> DataFrame:
    """Those pairs ``a``, ``b`` whose texts reach the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [
                similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), threshold) >= threshold
                for x, y in zip(frame["x"], frame["y"])
            ]
            yield frame.loc[good, ["a", "b"]]

    left = kmers.select(F.col("__row").alias("a"), F.col("kmers").alias("x"))
    right = kmers.select(F.col("__row").alias("b"), F.col("kmers").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a bigint, b bigint")


def bitmaps_allow(threshold: float) -> Column:
    """Whether the numbers of k-mers and the bitmaps of both texts allow the threshold."""
    differing = sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("other_bits")[i])) for i in range(BITMAP_WORDS))
    allowed = F.lit((1 - threshold) / (1 + threshold)) * (F.col("n") + F.col("m")) + F.lit(1e-6)
    return (F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m")) & (differing <= allowed)


def least_allow(threshold: float) -> Column:
    """Whether the least k-mers of both texts allow the threshold."""
    shared = F.size(F.array_intersect("least", "other_least"))
    whole = (F.col("n") <= LEAST_KMERS) & (F.col("m") <= LEAST_KMERS)
    needed = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m"))
    # The shorter of two texts may lie in the longer: then the threshold itself is shared.
    usual = F.lit(threshold - LEAST_SLACK) * F.least(F.size("least"), F.size("other_least"))
    return shared >= F.when(whole, needed - F.lit(1e-6)).otherwise(usual)


def pass_least(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those pairs ``a``, ``b`` whose least k-mers allow the threshold."""
    left = texts.select(F.col("__row").alias("a"), "n", "least")
    right = texts.select(F.col("__row").alias("b"), F.col("n").alias("m"), F.col("least").alias("other_least"))
    return pairs.join(left, "a").join(right, "b").filter(least_allow(threshold)).select("a", "b")


def as_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("__row", "__other").alias("a"), F.greatest("__row", "__other").alias("b")).distinct()


def near_duplicate_classes(
    docs: DataFrame, key: str, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``__row``, ``key``, ``class_id``, ``n_links``, ``is_kept`` for every row of ``docs``.

    ``class_id`` is the least key of the row's class, ``n_links`` the verified pairs that
    the row's text stands in, ``is_kept`` true for one row of each class, the one of
    least key and place.  Rows are told apart by their place in the stored table.
    """
    return classes_of(stored_rows(docs), key, text, threshold)


def classes_of(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """``near_duplicate_classes`` of rows that have their number, ``__row``."""
    rows = docs.select("__row", F.col(key).alias("__key"), F.col(text).alias("__text"))
    sketches = write_and_read(sketch(rows), "sketches")
    texts = sketches.groupBy("content").agg(F.min(F.struct("__row", "n", "buckets", "least", "bits")).alias("t"))
    texts = write_and_read(texts.select("content", "t.*"), "texts")
    members = write_and_read(texts.select("__row", "n", F.explode("buckets").alias("bucket")), "members")

    # Members of buckets of two or more, with the number of members in all their buckets.
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = write_and_read(members.join(sizes, "bucket"), "shared")
    weight = members.groupBy("__row").agg(F.sum("size").alias("weight"))
    weighed = members.join(weight, "__row")
    centres = weighed.groupBy("bucket").agg(
        *[
            choose(F.struct(order.alias("by"), "n", "__row")).alias(name)
            for choose, order, name in (
                (F.min, F.col("n"), "shortest"),
                (F.max, F.col("n"), "longest"),
                (F.min, F.xxhash64("__row"), "any"),
                (F.max, F.col("weight"), "central"),
            )
        ]
    )
    names = ("shortest", "longest", "any", "central")
    named = F.array(*[F.struct(F.col(f"{c}.__row").alias("__other"), F.col(f"{c}.n").alias("m")) for c in names])
    spokes = members.join(centres.select("bucket", named.alias("centres")), "bucket")
    spokes = spokes.select("__row", "n", F.explode(F.array_distinct("centres")).alias("c")).select("__row", "n", "c.*")
    spokes = spokes.filter("__row <> __other").distinct()
    bits = texts.select("__row", "bits")
    other_bits = texts.select(F.col("__row").alias("__other"), F.col("bits").alias("other_bits"))
    spokes = spokes.join(bits, "__row").join(other_bits, "__other").filter(bitmaps_allow(threshold))
    first = write_and_read(pass_least(as_pairs(spokes), texts, threshold), "pairs")
    links = write_and_read(aligned(first, kmers_of(rows, first), threshold), "verified")

    # Buckets that more than one component shares.
    labels = connected_components(links).withColumnsRenamed({"node": "__row", "label": "part"})
    placed = members.join(labels, "__row", "left").withColumn("part", F.coalesce("part", "__row"))
    parts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"),
        F.max_by("part", F.struct("size", "part")).alias("main"),
        F.ceil(F.sum("size") / F.lit(CHUNK_MEMBERS)).alias("chunks"),
    )
    mixed = mixed.filter("parts > 1").select("bucket", "main", "chunks")
    rest = write_and_read(placed.join(mixed, "bucket").join(bits, "__row"), "mixed")
    others = rest.select(
        "bucket",
        F.pmod(F.xxhash64("__row"), "chunks").alias("chunk"),
        F.col("__row").alias("__other"),
        F.col("n").alias("m"),
        F.col("part").alias("other_part"),
        F.col("bits").alias("other_bits"),
    )
    apart = (F.col("part") != F.col("other_part")) & ((F.col("other_part") == F.col("main")) | (F.col("__row") < F.col("__other")))
    outside = rest.filter("part <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    crossing = outside.join(others, ["bucket", "chunk"]).filter(apart & bitmaps_allow(threshold))
    second = pass_least(as_pairs(crossing).join(first, ["a", "b"], "left_anti"), texts, threshold)
    second = write_and_read(second, "pairs")
    links = links.union(write_and_read(aligned(second, kmers_of(rows, second), threshold), "verified"))

    labels = connected_components(links).withColumnsRenamed({"node": "__row", "label": "part"})
    degree = links.select(F.explode(F.array("a", "b")).alias("__row")).groupBy("__row").agg(F.count(F.lit(1)).alias("n_links"))
    classes = texts.select("content", "__row").join(labels, "__row", "left").join(degree, "__row", "left")
    classes = classes.select("content", F.coalesce("part", "__row").alias("part"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    joined = write_and_read(sketches.select("__row", "__key", "content").join(classes, "content"), "classes")
    # Nulls last among the keys; the least place where all are null.
    least = F.min(F.struct(F.isnull("__key"), "__key", "__row")).alias("kept")
    heads = joined.groupBy("part").agg(least).select("part", "kept.__key", F.col("kept.__row").alias("__kept"))
    heads = heads.withColumnRenamed("__key", "class_id")
    return joined.join(heads, "part").select(
        "__row", F.col("__key").alias(key), "class_id", "n_links", (F.col("__row") == F.col("__kept")).alias("is_kept")
    )


def keep_one_of_each(docs: DataFrame, key: str, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with its columns as they were.

    The rows that go are listed by ranges of their numbers, and each task leaves out those it
    meets: the texts are not moved.
    """
    apart, names, as_they_were = named_apart(docs)
    marked = stored_rows(apart)
    dropped = classes_of(marked, names[key], names[text], threshold).filter("NOT is_kept").select("__row")
    folder, bits = list_numbers(marked, dropped)

    def left_over(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = listed_among(folder, bits)
        for part in parts:
            yield part.filter(pa.array(~among(part.column(part.num_columns - 1).to_numpy())))

    rows = marked.select(*apart.columns, "__row")
    return rows.mapInArrow(left_over, rows.schema).select(*as_they_were)
