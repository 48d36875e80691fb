"""Language-model scores by deleted interpolation of word bigrams.

The chance of a word after another mixes the maximum-likelihood estimates of bigram and
unigram with a uniform one.  The mixture depends on how often the context was seen: there
is one set of weights for each power of two of its count.  Weights are learned by
expectation-maximisation on the deleted part of the training documents, with counts from
the others; scores use the counts of all training documents.

Counting and looking up are both one exchange of packed arrays:

1. Documents are tokenised where they are, in chunks of about ``CHUNK_TOKENS`` tokens.
   A chunk asks for each of its distinct n-grams once, with its own counts, so that a
   frequent n-gram is one entry of each chunk however often it stands there.  Chunks of
   deleted documents are kept apart.
2. N-grams meet by ranges of their hash.  A range sums the counts of all chunks and answers
   each chunk in the order it asked.  The number of ranges grows with the corpus.
3. A chunk and its answers meet.  Deleted chunks give the held-out events; after EM all
   chunks give scores.  Only sums for each class of contexts come to the driver.

Nothing is pruned: every n-gram of every training document counts.

Defined cases: a null text is an empty one, which is its end token alone; a null key
counts as an empty string in the split; repeated rows are counted and scored each; long
texts are scored whole; without training documents or deleted events the weights are even
and estimates without counts are zero; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, drop_stage
from lexloom.session import new_stage_path, write_and_read

CHUNK_TOKENS = 2_000_000
RANGE_CHARACTERS = 10_000_000
SLICE_TOKENS = 200_000
EM_ROUNDS = 15
EM_TOLERANCE = 1e-4
CLASSES = 64
HELD_OUT, DELETED, TRAINING = 0, 1, 2
SHIFT = {1: 0, 2: 8}
ODD = [np.uint64(f | 1) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def part_of(key: Column) -> Column:
    """Held out where crc32 of the key's text leaves 1 by 5, deleted where 0, else training."""
    left = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5
    return F.when(left == 1, HELD_OUT).when(left == 0, DELETED).otherwise(TRAINING)


def pack(values: np.ndarray) -> bytes:
    """Fixed-width integers, byte planes one after the other, compressed."""
    import zstandard

    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pair_codes(tokens: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """(context, word) of every token as one number; the first context of a text is the end token 0."""
    context = np.zeros(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[starts] = 0
    return context * words + tokens


def pair_hashes(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    words = len(hashes)
    h = hashes[codes // words] * ODD[0] + (hashes[codes % words] ^ ODD[1])
    h = (h ^ (h >> np.uint64(31))) * ODD[2]
    # 56 bits are kept: they are sent, and few of very many pairs share one.
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(8)) << np.uint64(8)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges are in the order of the hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Tokens of some documents as numbers of the chunk's own words; 0 is the end token."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {b"": 0}
        self.keys, self.parts, self.tokens, self.size = [], [], [], 0

    def add(self, key: object, part: int, words: list[bytes]) -> None:
        numbers = self.numbers
        for w in set(words).difference(numbers):
            numbers[w] = len(numbers)
        ids = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
        self.keys.append(key)
        self.parts.append(part)
        self.tokens.append(np.append(ids, np.uint32(0)))
        self.size += len(words) + 1

    def rows(self, chunk: int, ranges: int) -> Iterator[dict]:
        """The chunk itself, and what it asks of each range."""
        import xxhash

        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        lengths = np.array([len(t) for t in self.tokens], np.uint32)
        parts = np.array(self.parts, np.uint8)
        tokens = np.concatenate(self.tokens)
        deleted = bool((parts == DELETED).any())
        yield {"kind": "deleted" if deleted else "other", "chunk": chunk, "keys": self.keys, "blobs": [pack(lengths), pack(parts), pack(tokens), pack(hashes)]}
        trained = np.repeat(parts != HELD_OUT, lengths)
        starts = np.cumsum(lengths) - lengths
        codes, which = np.unique(pair_codes(tokens, starts, len(hashes)), return_inverse=True)
        for order, grams, of_token in ((1, hashes, tokens), (2, pair_hashes(codes, hashes), which)):
            counts = np.bincount(of_token[trained], minlength=len(grams)).astype(np.uint32)
            sort = np.argsort(grams, kind="stable")
            grams, counts = grams[sort], counts[sort]
            cuts = np.searchsorted(range_of(grams, ranges), np.arange(ranges + 1))
            for r in range(ranges):
                a, b = cuts[r], cuts[r + 1]
                if b > a:
                    steps = np.diff(grams[a:b] >> np.uint64(SHIFT[order]), prepend=np.uint64(0))
                    yield {"kind": "asked", "chunk": chunk, "range": r, "order": order, "deleted": deleted, "blobs": [pack(steps), pack(counts[a:b])]}


FIELDS = "kind string, chunk bigint, range int, order int, deleted boolean, keys array<string>, blobs array<binary>"


def ask(rows: DataFrame, ranges: int, chunk_tokens: int) -> DataFrame:
    """Rows of ``Chunk`` from ``__key`` (as text, which pandas leaves as it is), ``__part`` and ``__text``."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lower, part = str.maketrans(UPPER, LOWER), TaskContext.get().partitionId()
        made, open_chunks = 0, {True: Chunk(), False: Chunk()}

        def close(deleted: bool) -> Iterator[pd.DataFrame]:
            nonlocal made
            chunk, open_chunks[deleted] = open_chunks[deleted], Chunk()
            for row in chunk.rows((part << 33) + made, ranges) if chunk.size else ():
                yield pd.DataFrame([[row.get(n) for n in names]], columns=names)
            made += 1

        for frame in frames:
            for key, kind_of, text in zip(frame["__key"].array, frame["__part"].array, frame["__text"].array):
                words = (text or "").translate(lower).encode("utf-8", "surrogatepass").split()
                open_chunks[kind_of == DELETED].add(key, kind_of, words)
                if open_chunks[kind_of == DELETED].size >= chunk_tokens:
                    yield from close(kind_of == DELETED)
        yield from close(True)
        yield from close(False)

    return rows.mapInPandas(run, FIELDS)


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    """One range: each chunk's n-grams get their counts in all training documents, and in the
    training documents that are not deleted.  A row without chunk holds the range's totals."""
    out, totals = [], [0, 0, 0]
    for order, group in frame.groupby("order"):
        asked = [
            (r.chunk, r.deleted, np.cumsum(unpack(r.blobs[0], "<u8"), dtype=np.uint64), unpack(r.blobs[1], "<u4"))
            for r in group.itertuples()
        ]
        grams, which = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
        counts = np.concatenate([a[3] for a in asked]).astype(np.float64)
        marks = np.concatenate([np.full(len(a[3]), a[1]) for a in asked])
        every = np.bincount(which, counts, len(grams))
        kept = np.bincount(which[~marks], counts[~marks], len(grams)) if not marks.all() else np.zeros(len(grams))
        if order == 1:
            totals = [int(every.sum()), int(kept.sum()), int((every > 0).sum())]
        at = 0
        for chunk, deleted, own, _ in asked:
            w = which[at : at + len(own)]
            at += len(own)
            # The counts without deleted documents are for those alone.
            blobs = [pack(c[w].astype("<u8")) for c in ([every, kept] if deleted else [every])]
            out.append((chunk, frame["range"].iloc[0], order, deleted, blobs, None))
    out.append((None, frame["range"].iloc[0], 0, False, [], totals))
    return pd.DataFrame(out, columns=["chunk", "range", "order", "deleted", "blobs", "totals"])


ANSWER = "chunk bigint, range int, order int, deleted boolean, blobs array<binary>, totals array<bigint>"


def looked_up(chunk: pd.DataFrame, answers: pd.DataFrame, column: int) -> Iterator[tuple]:
    """Some texts of a chunk at a time: their slice, the starts of each among the tokens of the
    slice, and of every token the counts of its word, its context and the pair."""
    row = chunk.iloc[0]
    lengths, tokens, hashes = unpack(row.blobs[0], "<u4").astype(np.int64), unpack(row.blobs[2], "<u4"), unpack(row.blobs[3], "<u8")
    ends = np.cumsum(lengths)
    codes, which = np.unique(pair_codes(tokens, ends - lengths, len(hashes)), return_inverse=True)
    which, found = which.astype(np.uint32), {}
    for order, grams in ((1, hashes), (2, pair_hashes(codes, hashes))):
        own = answers[answers["order"] == order].sort_values("range")
        found[order] = np.empty(len(grams))
        found[order][np.argsort(grams, kind="stable")] = np.concatenate([unpack(b[column], "<u8") for b in own["blobs"]])
    first = 0
    while first < len(ends):
        begin = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + SLICE_TOKENS)))
        part = slice(begin, int(ends[last - 1]))
        words, pairs = tokens[part], which[part]
        contexts = codes[pairs] // len(hashes)
        yield slice(first, last), ends[first:last] - lengths[first:last] - begin, found[1][words], found[1][contexts], found[2][pairs]
        first = last


def context_class(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole binary logarithm."""
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0)


def ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def learn_weights(events: DataFrame, uniform: float, rounds: int = EM_ROUNDS, tolerance: float = EM_TOLERANCE) -> np.ndarray:
    """Weights (classes x uniform, unigram, bigram) by EM; ``events``: ``class``, ``p1``, ``p2``, ``n``."""
    weights = np.full((CLASSES, 3), 1 / 3)
    for _ in range(rounds):
        given = [F.array(*[F.lit(float(x)) for x in weights[:, k]]) for k in range(3)]
        of = lambda k: F.element_at(given[k], F.col("class") + 1)
        parts = [of(0) * uniform, of(1) * F.col("p1"), of(2) * F.col("p2")]
        total = parts[0] + parts[1] + parts[2]
        sums = events.groupBy("class").agg(*[F.sum(F.col("n") * p / total).alias(f"s{k}") for k, p in enumerate(parts)])
        new = weights.copy()
        for r in sums.collect():  # CLASSES rows at most
            s = np.array([r["s0"], r["s1"], r["s2"]]) + 1e-9
            new[r["class"]] = s / s.sum()
        change, weights = np.abs(new - weights).max(), new
        if change < tolerance:
            break
    return weights


def score_documents(
    docs: DataFrame, key: str, text: str = "text", chunk_tokens: int = CHUNK_TOKENS, range_characters: int = RANGE_CHARACTERS
) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("__key"), part_of(F.col(key)).alias("__part"), F.col(text).alias("__text"))
    characters = rows.agg(F.sum(F.length("__text"))).first()[0] or 0
    ranges = -(-characters // range_characters) or 1
    path = new_stage_path(spark, "chunks")
    ask(rows, ranges, chunk_tokens).write.partitionBy("kind").parquet(path)
    stage = spark.read.schema(FIELDS).parquet(path)
    asked = stage.filter("kind = 'asked'").select("chunk", "range", "order", "deleted", "blobs")
    answers = write_and_read(asked.groupBy("range").applyInPandas(answer, ANSWER), "answers")
    drop_stage(spark, f"{path}/kind=asked")
    totals = [F.sum(F.col("totals")[i]) for i in range(3)]
    train_tokens, kept_tokens, words = (int(x or 0) for x in answers.filter("chunk IS NULL").agg(*totals).first())
    uniform = 1 / (words + 1)
    replies = answers.filter("chunk IS NOT NULL")

    def held_out_events(chunk: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame({"class": [], "p1": [], "p2": [], "n": []})
        made = [
            pd.DataFrame({"class": context_class(context), "p1": ratio(word, float(kept_tokens)), "p2": ratio(pair, context)})
            .groupby(["class", "p1", "p2"], as_index=False)
            .size()
            for _, _, word, context, pair in looked_up(chunk, own, 1)
        ]
        return pd.concat(made).groupby(["class", "p1", "p2"], as_index=False)["size"].sum().rename(columns={"size": "n"})

    deleted = stage.filter("kind = 'deleted'").groupBy("chunk")
    events = deleted.cogroup(replies.filter("deleted").groupBy("chunk")).applyInPandas(
        held_out_events, "class int, p1 double, p2 double, n bigint"
    )
    weights = learn_weights(write_and_read(events, "events"), uniform)

    def score(chunk: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(chunk):
            return pd.DataFrame({n: [] for n in names})
        row, made = chunk.iloc[0], []
        lengths, held_out = unpack(row.blobs[0], "<u4").astype(np.int64), unpack(row.blobs[1], "<u1") == HELD_OUT
        for texts, starts, word, context, pair in looked_up(chunk, own, 0):
            w = weights[context_class(context)]
            chance = w[:, 0] * uniform + w[:, 1] * ratio(word, float(train_tokens)) + w[:, 2] * ratio(pair, context)
            base = (word + 0.5) / (train_tokens + 0.5 * (words + 1))
            known = np.add.reduceat((word > 0).astype(np.int64), starts)
            sums = [np.add.reduceat(np.log10(p), starts) for p in (base, chance)]
            keys = list(row["keys"][texts])
            made.append([keys, held_out[texts], lengths[texts], known, np.full(len(known), train_tokens), *sums])
        return pd.concat([pd.DataFrame(dict(zip(names, m))) for m in made])

    schema = "key string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    chunks = stage.filter("kind <> 'asked'").groupBy("chunk")
    scored = chunks.cogroup(replies.groupBy("chunk")).applyInPandas(score, schema)
    return scored.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *scored.columns[1:])
