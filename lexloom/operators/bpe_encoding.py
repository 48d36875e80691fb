"""Text to ids and back.

Documents stay where they are: each Arrow batch of texts is cut at their spaces, and its distinct
chunks are encoded once, many at a time.  Only the model goes to the tasks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators.tokenizer import PUNCTUATION, UNK, WORD_START, Tokenizer, chunks_of, in_slices, spaced

COMMON_WORDS = 200_000
# Words encoded together.
WORDS_AT_ONCE = 65_536
# Up to so many tokens the ranks of all pairs stand in one table.
SMALL_VOCAB = 1_000
NO_MERGE = np.iinfo(np.int32).max


def word_encoder(tok: Tokenizer):
    """A function from one word to its ids: lowest merge rank first, then leftmost."""
    ids = {t: i for i, t in enumerate(tok.tokens)}
    unk = ids[UNK]
    ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(tok.merges)))}

    def encode(word: str) -> list[int]:
        symbols: list[int | None] = [ids.get(ch, unk) for ch in word]
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        queue = [
            (ranks[pair][0], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks
        ]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if symbols[i] is None or j >= len(symbols) or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = ranks[pair][1], None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(symbols):
                    made = (symbols[k], symbols[after[k]])
                    if made in ranks:
                        heapq.heappush(queue, (ranks[made][0], k, made))
        return [s for s in symbols if s is not None]

    return encode


def starts(ordered: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    differs = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=differs[1:])
    return differs


def flat_encoder(tok: Tokenizer):
    """A function from words to the number of ids of each and all ids in a row, the same as ``word_encoder``
    gives: the symbols of all words lie in one array, and each step makes one merge wherever it is due."""
    ids = {t: i for i, t in enumerate(tok.tokens)}
    end, gone = len(tok), len(tok) + 1  # stands around a word; was merged into the symbol before it
    single = {ord(t): i for t, i in ids.items() if len(t) == 1}
    table = np.full(max(single, default=0) + 2, ids[UNK], np.int32)
    table[list(single)] = list(single.values())
    ranks = {(ids[a], ids[b]): rank for rank, (a, b) in reversed(list(enumerate(tok.merges)))}
    keys = {left * gone + right: rank for (left, right), rank in ranks.items()}
    pairs = np.array([*sorted(keys), np.iinfo(np.int64).max])
    rank_at = np.array([*(keys[k] for k in sorted(keys)), NO_MERGE], np.int32)
    every_pair = np.full(gone**2 if gone <= SMALL_VOCAB else 0, NO_MERGE, np.int32)
    every_pair[pairs[:-1] if len(every_pair) else []] = rank_at[:-1] if len(every_pair) else []
    pair_of = {rank: pair for pair, rank in ranks.items()}
    made = [ids[a + b] for a, b in tok.merges]
    lowest: dict[int, int] = {}
    for pair, rank in ranks.items():
        lowest |= {part: min(rank, lowest.get(part, rank)) for part in pair}
    # What these merges make can be merged before the next place of the same merge is due.
    one_a_word = {rank for rank, token in enumerate(made) if lowest.get(token, NO_MERGE) <= rank}

    def ranks_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) * gone + right
        if len(every_pair):
            return every_pair[pair]
        at = np.searchsorted(pairs, pair)
        return np.where(pairs[at] == pair, rank_at[at], NO_MERGE)

    def encode(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        if not sizes.any():
            return sizes, np.zeros(0, np.int32)
        bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        codes = np.frombuffer(words.buffers()[2][bounds[0] : bounds[-1]].to_pybytes().decode().encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        symbols = np.full(len(codes) + len(words) + 1, end, np.int32)
        symbols[np.arange(len(codes)) + owner + 1] = table[np.minimum(codes, len(table) - 1)]
        ends = np.cumsum(sizes + 1)
        before = np.arange(-1, len(symbols) - 1, dtype=np.int32)
        after = np.arange(1, len(symbols) + 1, dtype=np.int32)
        due: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(places: np.ndarray) -> None:
            rank = ranks_of(symbols[places], symbols[after[places]])
            some = np.flatnonzero(rank < NO_MERGE)
            order = some[np.argsort(rank[some], kind="stable")]
            places, rank = places[order], rank[order]
            cuts = [*np.flatnonzero(starts(rank)).tolist(), len(rank)]
            for begin, stop, number in zip(cuts, cuts[1:], rank[cuts[:-1]].tolist()):
                if number not in due:
                    heapq.heappush(queue, number)
                due.setdefault(number, []).append(places[begin:stop])

        note(np.arange(len(symbols) - 1, dtype=np.int32))
        while queue:
            rank = heapq.heappop(queue)
            left, right = pair_of[rank]
            at = np.concatenate(due.pop(rank))
            at = at[symbols[at] == left]
            at = np.sort(at[symbols[after[at]] == right])
            at = at[starts(at)]
            if rank in one_a_word:
                first = np.unique(np.searchsorted(ends, at), return_index=True)[1]
                later, at = np.delete(at, first), at[first]
            elif left == right and len(at):
                # In a run of equal symbols every second place, from the left.
                begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
                place = np.arange(len(at))
                at = at[(place - place[begins][np.cumsum(begins) - 1]) % 2 == 0]
            beyond = after[after[at]]
            symbols[after[at]] = gone
            symbols[at], after[at], before[beyond] = made[rank], beyond, at
            note(np.concatenate([before[at], at, *([later] if rank in one_a_word else [])]))
        stays = symbols < end
        return np.diff(np.cumsum(stays)[ends], prepend=0), symbols[stays]

    return encode


def words_encoder(tok: Tokenizer):
    """A function from words to the ids of each, many words at a time."""
    encode_flat = flat_encoder(tok)

    def encode(words: Sequence[str]) -> list[list[int]]:
        found: list[list[int]] = []
        for begin in range(0, len(words), WORDS_AT_ONCE):
            sizes, ids = encode_flat(pa.array(words[begin : begin + WORDS_AT_ONCE], pa.string()))
            flat, ends = ids.tolist(), np.cumsum(sizes).tolist()
            found += [flat[a:b] for a, b in zip([0, *ends], ends)]
        return found

    return encode


def for_chunks(spark: SparkSession, tok: Tokenizer) -> Tokenizer:
    """``tok`` without merges of punctuation, which stands alone: it gives a chunk the ids of its words."""
    known = "".join(sorted({ch for pair in tok.merges for ch in "".join(pair)}))
    apart = F.regexp_extract_all(F.lit(known), F.lit(f"[{PUNCTUATION}]"), F.lit(0))
    alone = set(spark.range(1).select(apart).first()[0])
    return replace(tok, merges=tuple(pair for pair in tok.merges if alone.isdisjoint("".join(pair))))


def join_ids(codes: np.ndarray, n_chunks: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> pa.ListArray:
    """The ids of all chunks of each row in a row: ``codes`` tell which distinct chunk each is, ``sizes``
    how many ids of the ``pool`` are those of each distinct one."""
    taken = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(taken)])
    starts = (np.cumsum(sizes) - sizes)[codes]
    ids = pool[np.repeat(starts - ends[:-1], taken) + np.arange(ends[-1])]
    offsets = ends[np.concatenate([[0], np.cumsum(n_chunks)])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def side_columns(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """``length``, a mask of ones and type ids of zeros."""
    n = F.size(ids)
    return df.withColumns(
        {
            "length": n,
            "attention_mask": F.array_repeat(F.lit(1), n),
            "token_type_ids": F.array_repeat(F.lit(0), n),
        }
    )


def encode(
    df: DataFrame,
    key: str,
    text: str,
    tok: Tokenizer,
    ascii_only: bool = False,
    common_words: int = COMMON_WORDS,
) -> DataFrame:
    """``key``, ``input_ids`` and side columns; nothing is truncated, padded or added.

    No row is moved, so keys may be null or repeated.  A null text has no ids.  A task makes
    the ids of a bounded number of characters at a time, however many rows a batch holds, and
    keeps nothing from one time to the next: ``common_words`` has no effect any more.
    """
    encode_words = flat_encoder(for_chunks(df.sparkSession, tok))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(in_slices(p, 1) for p in parts):
            chunks, counts, n_chunks = chunks_of(part.column(1))
            words = pc.binary_join_element_wise(WORD_START, chunks.dictionary, "")
            made = [encode_words(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
            sizes, pool = (np.concatenate(arrays) for arrays in zip(*made)) if made else (np.zeros(0, int),) * 2
            ids = join_ids(chunks.indices.to_numpy()[counts], n_chunks, sizes, pool)
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "input_ids"])

    docs = df.select(key, spaced(F.col(text), ascii_only).alias("__text"))
    ids = T.StructField("input_ids", T.ArrayType(T.IntegerType()))
    return side_columns(docs.mapInArrow(batches, T.StructType([docs.schema[key], ids])))


def token_list(tok: Tokenizer) -> Column:
    """The vocabulary as one literal array, looked up by index: no join, no shuffle."""
    return F.from_json(F.lit(json.dumps(tok.tokens)), "array<string>")


def decode(ids: Column, tok: Tokenizer, skip_specials: bool = True) -> Column:
    """Ids to text: special tokens skipped, word-start marks to spaces, none in front."""
    specials = [i for i, t in enumerate(tok.tokens) if t in tok.specials]
    kept = F.filter(ids, lambda i: ~i.isin(specials)) if skip_specials and specials else ids
    pieces = F.transform(kept, lambda i: F.get(token_list(tok), i))
    # The tokens are named once, so that they are walked once.
    bare = F.regexp_replace(F.array_join(pieces, ""), f"^{WORD_START}", "")
    return F.replace(bare, F.lit(WORD_START), F.lit(" "))
