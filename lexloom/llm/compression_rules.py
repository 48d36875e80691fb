"""Quality rules: repeated words and lines, and bands of the zstandard ratio.

A text's ratio is its UTF-8 bytes over its compressed bytes, without frame headers.
``LIMITS`` gives for each length the least and the greatest ratio that a text may
have: short texts compress little however plain they are, so the limits depend on
the length.  Fixed chunks of a text are held to the limits of their own length, and
a text goes when too much of it lies in chunks outside them.

Defined cases: null and empty texts have no words and fail the word rule; texts
shorter than the first limit are not judged by ratio; very long texts are measured
whole, chunk by chunk.  Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import named_apart

# (bytes at least, least ratio, greatest ratio)
LIMITS = ((64, 0.70, 3.0), (256, 1.05, 4.0), (1024, 1.25, 5.0), (4096, 1.40, 6.0), (16384, 1.50, 7.0))
CHUNK_BYTES = 4096
LEAST_CHUNK = 1024
CHUNK_SHARE = 0.5
LEVEL = 3

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "ratio double, bad_chunk_share double, base_failed boolean, kept boolean"
)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that stand twice or more in ``ids``."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # Exact: equal windows of half the length get equal numbers, then pairs of those.
    rank, width = ids.astype(np.int64), 1
    while width < window:
        rank = rank[:-width] * np.int64(len(ids) + 1) + rank[width:]
        rank, width = np.unique(rank, return_inverse=True)[1], width * 2
    often = np.bincount(rank)[rank] > 1
    marks, starts = np.zeros(len(ids) + 1, dtype=np.int64), np.flatnonzero(often)
    marks[starts] += 1
    marks[starts + window] -= 1
    return int((np.cumsum(marks[:-1]) > 0).sum())


def limits_for(size: int, limits: Sequence[tuple[int, float, float]]) -> tuple[float, float] | None:
    found = None
    for least, low, high in limits:
        if size >= least:
            found = (low, high)
    return found


def measure(text: str | None, compress, limits, chunk_bytes: int, chunk_share: float) -> tuple:
    """The fields of one text; ``compress`` gives the compressed size of bytes."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII white-space characters only
    n = len(words)
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = 0
    if n > WINDOW:
        local: dict[bytes, int] = {}
        repeats = repeated_words(np.array([local.setdefault(w, len(local)) for w in words], dtype=np.int64))
    band = limits_for(len(raw), limits)
    ratio, bad, outside = None, 0.0, False
    if band:
        ratio = len(raw) / compress(raw)
        outside = not band[0] <= ratio <= band[1]
        if len(raw) > chunk_bytes:
            for start in range(0, len(raw), chunk_bytes):
                piece = raw[start : start + chunk_bytes]
                if len(piece) >= LEAST_CHUNK:
                    low, high = limits_for(len(piece), limits) or (0.0, float("inf"))
                    bad += len(piece) * (not low <= len(piece) / compress(piece) <= high)
            bad /= len(raw)
    failed = n < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * n
    kept = not (failed or outside or bad >= chunk_share)
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeats, ratio, bad, failed, kept


def judge_quality(
    docs: DataFrame,
    text: str = "text",
    limits: Sequence[tuple[int, float, float]] = LIMITS,
    chunk_bytes: int = CHUNK_BYTES,
    chunk_share: float = CHUNK_SHARE,
    out: str = "quality",
) -> DataFrame:
    """The rows of ``docs`` with a struct ``out`` of the measures and ``kept``; no shuffle.

    ``chunk_share``: share of a text's bytes in chunks outside their limits from which it goes.
    """
    limits = tuple(sorted(limits))

    @F.pandas_udf(FIELDS)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        one = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

        def packed(raw: bytes) -> int:
            return len(one.compress(raw))

        names = [f.split()[0] for f in FIELDS.split(", ")]
        for batch in texts:
            rows = [measure(t, packed, limits, chunk_bytes, chunk_share) for t in batch]
            frame = pd.DataFrame(rows, columns=names)
            frame["ratio"] = frame["ratio"].astype("float64")
            yield frame

    return docs.withColumn(out, judge(F.col(text)))


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows that pass, with their columns as they were."""
    apart, names, as_they_were = named_apart(docs)
    return judge_quality(apart, names[text], out="__quality", **limits).filter(F.col("__quality.kept")).select(*as_they_were)
