"""Hard negatives by Kronecker-packed products: one multiplication scores a whole block of rows.

Components are whole numbers.  For a block of candidate rows, the values of one component are
made non-negative by a bias and laid side by side into the fields of one wide integer, wide
enough that no sum runs over into the next field.  Multiplying that integer once by the
(biased) component of an anchor multiplies all fields at once; the sum over the components
holds the biased scores of all candidates, exactly, and the biases are taken off again
after unpacking.

Anchors are taken in blocks of bounded size, counted beforehand: a block goes to the driver
and from there to all tasks.  Each task walks through its candidates where they lie, keeps
the few best of each anchor, and only those are shuffled.  Candidates are scored once: rows
of the anchor's label in the first pass, which gives its positives, the others in the second.
The results of each block of anchors are written before the next block starts.

Defined cases: a row with a null id, label or vector, or with a component that is null or
not finite, takes no part.  Vectors are compared only with those of their length; of two empty
vectors the score is 0.  A row with the anchor's id is the anchor itself, not another row; an
id that occurs in several rows makes several candidates, and an anchor that does makes one
anchor for each row.  Equal scores are ordered by the id.  Anchors without positives, and
positives without negatives in their band, give no rows.  An empty table gives no rows.  A
score that does not fit 63 bits is an error.  Columns other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexloom.llm.common import number_rows
from lexloom.session import new_stage_path, write_and_read

ANCHORS_AT_ONCE = 8192
CANDIDATES_AT_ONCE = 4096
N_POSITIVES, N_NEGATIVES = 5, 5
# A negative's score is at least this share, in hundredths, of the positive's and at most as high.
BAND = (80, 100)
SCALE = 256
NONE = np.iinfo(np.int64).min

RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
)


def whole_components(vectors: pa.Array, scale: int = SCALE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of floor(scale * x)) for each length of vector; vectors with a null or not
    finite component are left out."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    out = []
    for length in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == length)
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        values = np.floor(scale * pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), length))
        finite = np.isfinite(values).all(1)
        if (np.abs(values[finite]) >= 2.0**62).any():
            raise OverflowError("a component is too large for exact scores in 64 bits")
        out.append((rows[finite], values[finite].astype(np.int64)))
    return out


class PackedBlock:
    """Candidate vectors of one length as wide integers, one for each component."""

    def __init__(self, vectors: np.ndarray, least: int, most: int) -> None:
        """``least`` and ``most``: bounds of the anchors' components."""
        n, self.length = vectors.shape
        self.bias = int(vectors.min(initial=0))
        raised = int(vectors.max(initial=0)) - self.bias
        top = max(1, self.length) * max(raised, abs(self.bias)) * max(most - least, abs(least), abs(most), 1)
        if 4 * top >= 1 << 63:
            raise OverflowError("scores do not fit 63 bits")
        self.least, self.n = least, n
        self.field = "<u4" if top < 1 << 32 else "<u8"
        fields = (vectors - self.bias).T.astype(self.field)
        self.packed = [int.from_bytes(component.tobytes(), "little") for component in fields]
        self.sums = (vectors - self.bias).sum(1)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The inner products of ``anchor`` with all rows of the block."""
        factors = (anchor - self.least).tolist()
        total = 0
        for wide, factor in zip(self.packed, factors):
            total += wide * factor
        fields = np.frombuffer(total.to_bytes(self.n * int(self.field[2]), "little"), self.field).astype(np.int64)
        # sum of (a + least)(c + bias) over the components, with a and c the biased ones
        return fields + self.bias * sum(factors) + self.least * self.sums + self.length * self.least * self.bias


class Best:
    """The first ``k`` (score, id) of each of ``n`` lists, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), NONE)
        self.id = np.zeros((n, k), np.int64)

    def add(self, at: int, score: np.ndarray, ids: np.ndarray, low: int | None = None, high: int | None = None) -> None:
        last = self.score[at, -1]
        low = last if low is None else max(low, last)
        fits = score >= low if high is None else (score >= low) & (score <= high)
        where = np.flatnonzero(fits)
        if not len(where):
            return
        k = self.score.shape[1]
        if len(where) > 4 * k:
            where = where[score[where] >= np.partition(score[where], -k)[-k]]
        known = self.score[at] != NONE
        scores = np.concatenate([self.score[at][known], score[where]])
        all_ids = np.concatenate([self.id[at][known], ids[where]])
        first = np.lexsort((all_ids, -scores))[:k]
        self.score[at, : len(first)], self.id[at, : len(first)] = scores[first], all_ids[first]


def _blocks(parts: Iterator[pa.RecordBatch], scale: int, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of candidates of one length of vector: (length, ids, labels, vectors)."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def take(length: int):
        ids, labels, vectors = (np.concatenate(x) for x in zip(*held.pop(length)))
        for first in range(0, len(ids), rows):
            yield length, ids[first : first + rows], labels[first : first + rows], vectors[first : first + rows]

    for part in parts:
        ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at, vectors in whole_components(part.column(2), scale):
            length = vectors.shape[1]
            held.setdefault(length, []).append((ids[at], labels[at], vectors))
            if sum(len(h[0]) for h in held[length]) >= rows:
                yield from take(length)
    for length in list(held):
        yield from take(length)


def _table(schema: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in schema.values()], names=list(schema))


def _positive_finder(anchors, n_positives: int, scale: int, rows: int):
    ids, labels, groups = anchors

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), n_positives)
        for length, c_ids, c_labels, vectors in _blocks(parts, scale, rows):
            if length not in groups:
                continue
            members, matrix, least, most = groups[length]
            for label in np.unique(c_labels):
                chosen = np.flatnonzero(labels[members] == label)
                if not len(chosen):
                    continue
                same = c_labels == label
                block, same_ids = PackedBlock(vectors[same], least, most), c_ids[same]
                for m in chosen:
                    at = members[m]
                    others = same_ids != ids[at]
                    best.add(at, block.scores(matrix[m])[others], same_ids[others])
        at, place = np.nonzero(best.score != NONE)
        yield _table({"anchor": at, "score": best.score[at, place], "id": best.id[at, place]})

    return find


def _negative_finder(anchors, positives, n_negatives: int, band: tuple[int, int], scale: int, rows: int):
    ids, labels, groups = anchors
    first, p_score = positives

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(p_score), n_negatives)
        # Python's whole numbers: rounded towards the inside of the band, exactly.
        low = [-(-band[0] * int(p) // band[1]) for p in p_score]
        for length, c_ids, c_labels, vectors in _blocks(parts, scale, rows):
            if length not in groups:
                continue
            members, matrix, least, most = groups[length]
            block = PackedBlock(vectors, least, most)
            for m, at in enumerate(members):
                wanted = range(first[at], first[at + 1])
                if not wanted:
                    continue
                score = block.scores(matrix[m])
                floor, top = min(low[p] for p in wanted), max(int(p_score[p]) for p in wanted)
                near = (c_labels != labels[at]) & (c_ids != ids[at]) & (score >= floor) & (score <= top)
                score, near_ids = score[near], c_ids[near]
                for p in wanted:
                    best.add(p, score, near_ids, low[p], int(p_score[p]))
        at, place = np.nonzero(best.score != NONE)
        yield _table({"positive": at, "score": best.score[at, place], "id": best.id[at, place]})

    return find


def _first(found: DataFrame, group: str, k: int) -> DataFrame:
    """The first ``k`` of each group over all tasks; a group has ``k`` rows for each task."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: str,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    n_positives: int = N_POSITIVES,
    n_negatives: int = N_NEGATIVES,
    band: tuple[int, int] = BAND,
    scale: int = SCALE,
    anchors_at_once: int = ANCHORS_AT_ONCE,
    candidates_at_once: int = CANDIDATES_AT_ONCE,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores, for the rows that
    the condition ``is_anchor`` (SQL over ``key`` and ``label``) picks.

    An anchor's positives are the ``n_positives`` highest other rows of its label, a positive's
    negatives the ``n_negatives`` highest rows of other labels whose score is between
    ``band[0]`` of ``band[1]`` parts of the positive's score and that score.
    """
    spark = rows.sparkSession
    for name in (key, label):
        if not isinstance(rows.schema[name].dataType, T.IntegralType):
            raise ValueError(f"column {name} must hold whole numbers")

    def taking_part(df: DataFrame) -> DataFrame:
        columns = F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vector")
        return df.select(*columns).filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    given, picked = taking_part(rows), taking_part(rows.filter(is_anchor))
    picked = write_and_read(number_rows(picked, ["id"], "no", "anchors"), "anchors")
    n = picked.count()
    path = new_stage_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for start in range(0, n, anchors_at_once):
        # A block of at most ``anchors_at_once`` vectors.
        block = picked.filter((F.col("no") >= start) & (F.col("no") < start + anchors_at_once)).select("id", "label", "vector").toArrow().combine_chunks()
        ids, labels = (block.column(i).to_numpy() for i in (0, 1))
        groups = {}
        vectors = block.column(2)
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        for at, matrix in whole_components(vectors, scale):
            if len(at):
                groups[matrix.shape[1]] = (at, matrix, int(matrix.min(initial=0)), int(matrix.max(initial=0)))
        anchors = (ids, labels, groups)
        found = given.mapInArrow(_positive_finder(anchors, n_positives, scale, candidates_at_once), "anchor bigint, score bigint, id bigint")
        best = _first(found, "anchor", n_positives).select("anchor", "rank", "id", "score").toPandas()
        best = best.sort_values(["anchor", "rank"])
        first = np.searchsorted(best["anchor"].to_numpy(), np.arange(len(ids) + 1))
        positives = (first, best["score"].to_numpy(np.int64))
        found = given.mapInArrow(_negative_finder(anchors, positives, n_negatives, band, scale, candidates_at_once), "positive bigint, score bigint, id bigint")
        # The positives of one block of anchors: a table of bounded size.
        known = spark.createDataFrame(
            list(zip(range(len(best)), ids[best["anchor"].to_numpy(np.int64)].tolist(), best["id"].tolist(), best["score"].tolist())),
            "positive bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
        )
        chosen = _first(found, "positive", n_negatives).join(F.broadcast(known), "positive")
        chosen.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)
