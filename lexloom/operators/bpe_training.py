"""Byte-pair training as Spark jobs over the table of distinct words, many merges to a job.

The code of a character is its code point and merged tokens are numbered above all code
points, so codes compare exactly as vocabulary ids do.

The words stay where they are, as arrays of codes.  The driver knows the exact counts of the
most frequent pairs only.  It guesses the next merges, and one job applies them in turn to all
words and reports, step by step, by how much each pair's count changes: a log of small deltas
instead of a new table of counts.  The driver then replays the log and accepts the guessed
merges as long as each is the most frequent pair at its turn; the rest is forgotten.  A guess
that is wrong costs time only, never a wrong merge.  Guesses come from a bounded number of the
most frequent words, on which the driver tries the merges first.

Every ``MERGES_PER_BASE`` merges the words are written anew with the merges applied, and
the older stage is deleted.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.tokenizer import TRAINED_SPECIALS, Tokenizer, characters
from lexloom.session import drop_stage, write_stage

FIRST_MERGED = 0x110000
MAX_ALPHABET = 0x110000
# Bounds of what the driver holds: pairs with exact counts, words to guess from, merges a job.
KNOWN_PAIRS = 50_000
GUESS_WORDS = 1_000_000
GUESSED_MERGES = 512
MERGES_PER_BASE = 24
# For so many merges of one block its pairs are indexed first.
INDEXED_MERGES = 48
WORDS_PER_BLOCK = 65_536
BETWEEN = -1  # stands between two words
GONE = -2  # was merged into the code before it

CHANGES = "step int, left int, right int, change bigint"


def as_symbols(word: Column) -> Column:
    """`` 97  98 `` for ``ab``: one code per character."""
    codes = F.transform(
        F.filter(F.split(word, ""), lambda c: c != ""),
        lambda c: F.concat(F.lit(" "), F.ascii(c).cast("string"), F.lit(" ")),
    )
    return F.array_join(codes, "")


def merge_symbols(symbols: Column, left: int, right: int, merged: int) -> Column:
    """The pair replaced left to right without overlap: one plain replacement."""
    return F.replace(symbols, F.lit(f" {left}  {right} "), F.lit(f" {merged} "))


def symbol_array(symbols: Column) -> Column:
    return F.split(F.trim(symbols), "  ").cast("array<int>")


def count_pairs(state: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: adjacent codes of ``symbols`` weighted by ``cnt``; overlapping pairs count."""
    # No test of the words beforehand, and an outer explode: an inner test would be
    # pushed down to the single occurrences that a word table is counted from.
    array = state.select(symbol_array(F.col("symbols")).alias("s"), F.col("cnt").alias("n"))
    places = F.size("s") - 1
    zipped = F.arrays_zip(F.slice("s", 1, places).alias("a"), F.slice("s", 2, places).alias("b"))
    pairs = array.select(F.inline_outer(zipped).alias("a", "b"), "n").filter(F.col("a").isNotNull())
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Block:
    """Some words as one array of codes with ``BETWEEN`` around each word; ``word`` tells
    whose code it is, ``counts`` how often each word occurs.  A merge leaves ``GONE`` at its
    second place; ``before`` and ``after`` lead past such places."""

    codes: np.ndarray
    word: np.ndarray
    counts: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @staticmethod
    def of(symbols: pa.ListArray, counts: np.ndarray) -> Block:
        sizes = np.diff(symbols.offsets.to_numpy())
        values = symbols.flatten().to_numpy()
        word = np.repeat(np.arange(len(sizes)), sizes)
        codes = np.full(len(values) + len(sizes) + 1, BETWEEN, np.int32)
        owner = np.zeros(len(codes), np.int32)
        at = np.arange(len(values)) + word + 1
        codes[at], owner[at] = values, word
        places = np.arange(len(codes), dtype=np.int32)
        return Block(codes, owner, counts, np.maximum(places - 1, 0), np.minimum(places + 1, len(codes) - 1))

    def pairs_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and weight of the pairs that begin at ``places`` and lie inside a word."""
        left, right = self.codes[places].astype(np.int64), self.codes[self.after[places]].astype(np.int64)
        inside = (left >= 0) & (right >= 0)
        return (left << 32 | right)[inside], self.counts[self.word[places[inside]]]

    def places_of(self, left: int, right: int) -> np.ndarray:
        """Where the pair is merged."""
        at = np.flatnonzero(self.codes == left)
        at = at[self.codes[self.after[at]] == right]
        return self.alternate(at, left, right)

    def alternate(self, at: np.ndarray, left: int, right: int) -> np.ndarray:
        """Of the places where the pair stands, in order, those where it is merged."""
        if left == right and len(at):
            # In a run of equal codes every second place, from the left.
            begins = np.concatenate([[True], self.after[at[:-1]] != at[1:]])
            place = np.arange(len(at))
            at = at[(place - place[begins][np.cumsum(begins) - 1]) % 2 == 0]
        return at

    def write(self, at: np.ndarray, code: int) -> None:
        second = self.after[at]
        beyond = self.after[second]
        self.codes[second] = GONE
        self.codes[at], self.after[at], self.before[beyond] = code, beyond, at

    def merge(self, left: int, right: int, code: int) -> None:
        """Merge the pair in place."""
        self.write(self.places_of(left, right), code)

    def merge_and_count(self, left: int, right: int, code: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pair in place; the pairs whose counts change, and by how much."""
        at = self.places_of(left, right)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.zeros(len(self.codes), bool)
        near[at] = near[self.before[at]] = near[self.after[at]] = True
        near = np.flatnonzero(near)
        keys, weights = self.pairs_at(near)
        self.write(at, code)
        # Places that are gone begin no pair.
        new_keys, new_weights = self.pairs_at(near)
        return summed(np.concatenate([keys, new_keys]), np.concatenate([-weights, new_weights]))

    def symbols(self) -> pa.ListArray:
        inside = self.codes >= 0
        sizes = np.bincount(self.word[inside], minlength=len(self.counts))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.codes[inside]))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the total weight of each, without those of weight 0."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    totals = np.add.reduceat(weights, first) if len(keys) else weights
    return keys[first][totals != 0], totals[totals != 0]


class Indexed:
    """A block that knows where each pair begins, for many merges: one touches its own places only, and
    with ``undoable`` the last ones can be taken back.  Places listed under a pair may have
    changed since, and are looked at again when it is merged."""

    def __init__(self, block: Block, undoable: bool = False) -> None:
        self.block, self.undoable = block, undoable
        self.at: dict[int, list[np.ndarray]] = {}
        self.past: list[tuple] = []
        self.note(np.flatnonzero(block.codes >= 0).astype(np.int32))

    def note(self, places: np.ndarray) -> None:
        left, right = self.block.codes[places].astype(np.int64), self.block.codes[self.block.after[places]]
        inside = (left >= 0) & (right >= 0)
        keys, places = (left << 32 | right)[inside], places[inside]
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for begin, end in zip(cuts, cuts[1:]):
            self.at.setdefault(int(keys[begin]), []).append(places[begin:end])

    def merge_and_count(self, left: int, right: int, code: int) -> tuple[np.ndarray, np.ndarray]:
        """That of ``Block``."""
        block = self.block
        listed = self.at.pop(left << 32 | right, None)
        if listed is None:
            if self.undoable:
                self.past.append((left, right, None))
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        listed = np.unique(np.concatenate(listed))
        at = listed[block.codes[listed] == left]
        at = block.alternate(at[block.codes[block.after[at]] == right], left, right)
        second = block.after[at]
        beyond = block.after[second]
        near = np.unique(np.concatenate([block.before[at], at, second]))
        keys, weights = block.pairs_at(near)
        block.write(at, code)
        new_keys, new_weights = block.pairs_at(near)
        self.note(np.unique(np.concatenate([block.before[at], at])))
        if self.undoable:
            self.past.append((left, right, listed, at, second, beyond))
        return summed(np.concatenate([keys, new_keys]), np.concatenate([-weights, new_weights]))

    def undo(self, merges: int) -> None:
        """Take the last ``merges`` back."""
        block = self.block
        for left, right, listed, *places in [self.past.pop() for _ in range(merges)]:
            if listed is not None:
                at, second, beyond = places
                block.codes[at], block.codes[second] = left, right
                block.after[at], block.before[beyond] = second, second
                self.at[left << 32 | right] = [listed]


def blocks(parts: Iterable[pa.RecordBatch], merges: Sequence[tuple[int, int, int]] = (), at_least: int = WORDS_PER_BLOCK) -> Iterator[Block]:
    """Batches of ``symbols``, ``cnt`` as blocks of ``at_least`` words, but for the last, with ``merges`` applied."""

    def block(held: list[pa.RecordBatch]) -> Block:
        rows = pa.Table.from_batches(held).combine_chunks()
        made = Block.of(rows.column(0).combine_chunks(), rows.column(1).to_numpy())
        merge_in = Indexed(made).merge_and_count if len(merges) >= INDEXED_MERGES else made.merge
        for merge in merges:
            merge_in(*merge)
        return made

    held: list[pa.RecordBatch] = []
    for part in parts:
        if part.num_rows:
            held.append(part)
        if sum(p.num_rows for p in held) >= at_least:
            yield block(held)
            held = []
    if held:
        yield block(held)


def as_rows(step: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    columns = [step.astype(np.int32), (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), weights]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["step", "left", "right", "change"])


def change_log(done: list[tuple[int, int, int]], tried: list[tuple[int, int, int]]):
    """A task function: ``done`` is applied, then ``tried`` step by step with a log of the changes."""

    def log(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(parts, done):
            steps, keys, weights = [], [], []
            merged = Indexed(block) if len(tried) >= INDEXED_MERGES else block
            for step, merge in enumerate(tried):
                changed, by = merged.merge_and_count(*merge)
                steps.append(np.full(len(changed), step))
                keys.append(changed)
                weights.append(by)
            yield as_rows(*(np.concatenate(c) for c in (steps, keys, weights)))

    return log


def pair_log(done: list[tuple[int, int, int]]):
    """A task function: the counts of all pairs once ``done`` is applied."""

    def log(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(parts, done):
            keys, weights = summed(*block.pairs_at(np.arange(len(block.codes))))
            yield as_rows(np.zeros(len(keys)), keys, weights)

    return log


def rewriter(done: list[tuple[int, int, int]]):
    """A task function: the words with ``done`` applied."""

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(parts, done):
            yield pa.RecordBatch.from_arrays([block.symbols(), pa.array(block.counts)], names=["symbols", "cnt"])

    return rewrite


class KnownPairs:
    """Exact counts of the most frequent pairs, ordered by count, then by the lower ids.

    ``last`` is the place in that order behind which pairs are not known; None where all are.
    Counts of pairs not known only fall, so they stay behind it.
    """

    def __init__(self, rows: Iterable[tuple[int, int, int]], limit: int, least: int) -> None:
        self.count = {(left, right): n for left, right, n in rows}
        self.heap = sorted((-n, left, right) for (left, right), n in self.count.items())
        self.last = self.heap[-1] if len(self.heap) >= limit else None
        self.least = least

    def best(self) -> tuple[int, int, int] | None:
        """The first pair as (-count, left, right), if it is certain to be the first of all."""
        while self.heap and self.count.get(self.heap[0][1:]) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        if not self.heap or (self.last is not None and self.heap[0] > self.last):
            return None
        return self.heap[0]

    def leading(self, n: int) -> list[tuple[int, int, int]]:
        """The first ``n`` entries of the order, none twice."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        taken = []
        while self.heap and len(found) < n:
            entry = heapq.heappop(self.heap)
            if self.count.get(entry[1:]) == -entry[0] and entry[1:] not in found:
                found[entry[1:]] = entry
                taken.append(entry)
        # What was taken is sorted and before all others: put in front, the list is a heap again.
        self.heap = taken + self.heap
        heapq.heapify(self.heap)
        return taken

    def change(self, changes: Iterable[tuple[int, int, int]], new: int, may_merge: Callable[[int, int], bool]) -> None:
        """Bring the counts up to date after a merge into ``new``."""
        for left, right, by in changes:
            pair = (left, right)
            if pair in self.count:
                n = self.count[pair] + by
            elif new in pair and may_merge(left, right):
                n = by
            else:
                continue
            if n < self.least or (self.last is not None and (-n, left, right) > self.last):
                self.count.pop(pair, None)
            else:
                self.count[pair] = n
                heapq.heappush(self.heap, (-n, left, right))


def guess_merges(
    known: KnownPairs, sample: Indexed, steps: int, first_code: int, is_token: Callable[[int, int], bool], may_merge: Callable[[int, int], bool], join: Callable[[int, int], None]
) -> list[tuple[int, int, int]]:
    """Merges that are likely to come next, each of them made in the sample.

    Counts of pairs that the guessed merges change are estimated from the sample, scaled
    by how much of the merged pair the sample holds.  The first merge is certain.
    """
    queue = [(float(n), left, right) for n, left, right in known.leading(4 * steps + 64)]
    estimate = {(left, right): n for n, left, right in queue}
    tried: list[tuple[int, int, int]] = []
    while queue and len(tried) < steps:
        n, left, right = heapq.heappop(queue)
        if estimate.get((left, right)) != n:
            continue
        again = is_token(left, right)
        if again and tried:
            break  # tried first in the next round
        code = first_code + len(tried)
        keys, changes = sample.merge_and_count(left, right, code)
        join(left, right)
        tried.append((left, right, code))
        if again:
            break
        pairs = list(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), changes.tolist()))
        held = sum(-by for a, b, by in pairs if (a, b) == (left, right))
        estimate.pop((left, right))
        for a, b, by in pairs:
            pair = (a, b)
            if pair != (left, right) and (pair in estimate or (code in pair and may_merge(a, b))):
                estimate[pair] = estimate.get(pair, 0.0) - by * (-n / held)
                heapq.heappush(queue, (estimate[pair], a, b))
    return tried


def train_bpe(
    words: DataFrame,
    vocab_size: int = 12_000,
    min_frequency: int = 10,
    specials: tuple[str, ...] = TRAINED_SPECIALS,
    max_token_length: int = 20,
    batched: bool = True,
    known_pairs: int = KNOWN_PAIRS,
    guess_words: int = GUESS_WORDS,
    merges_per_base: int = MERGES_PER_BASE,
) -> Tokenizer:
    """Learn a vocabulary from ``word``, ``cnt``.

    Each merge takes the most frequent admissible pair, ties by lowest ids, until
    the vocabulary is full or no pair reaches ``min_frequency``.  A pair is
    admissible when both parts are single characters or the merged token is
    shorter than ``max_token_length``.  The result does not depend on the last four
    settings; ``batched=False`` tries one merge a job.
    """
    spark = words.sparkSession
    paths: list[str] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        stage, path = write_stage(df, name)
        paths.append(path)
        return stage

    stored = written(words.select("word", "cnt"), "bpe-words")
    alphabet = [r.ch for r in characters(stored).orderBy("ch").limit(MAX_ALPHABET).collect()]
    known_specials = list(dict.fromkeys(specials))
    tokens = known_specials + [ch for ch in alphabet if ch not in set(known_specials)]
    code_of: dict[str, int] = {ch: ord(ch) for ch in alphabet}
    merged_tokens: list[str] = []
    merges: list[tuple[str, str]] = []
    guessed_tokens: list[str] = []

    def text_of(code: int) -> str:
        if code < FIRST_MERGED:
            return chr(code)
        at = code - FIRST_MERGED
        return merged_tokens[at] if at < len(merged_tokens) else guessed_tokens[at - len(merged_tokens)]

    def may_merge(left: int, right: int) -> bool:
        if left < FIRST_MERGED and right < FIRST_MERGED:
            return True
        return len(text_of(left)) + len(text_of(right)) < max_token_length

    def is_token(left: int, right: int) -> bool:
        token = text_of(left) + text_of(right)
        return token in code_of or token in guessed_tokens

    def length_of(code: Column) -> Column:
        # One literal list, folded once: the lengths of the tokens made so far.
        lengths = F.split(F.lit(",".join(str(len(t)) for t in merged_tokens) or "0"), ",")
        made = F.get(lengths, code - FIRST_MERGED).cast("int")
        return F.when(code < FIRST_MERGED, F.lit(1)).otherwise(made)

    def count_known(base: DataFrame, done: list[tuple[int, int, int]]) -> KnownPairs:
        left, right, n = F.col("left"), F.col("right"), F.col("n")
        counted = base.mapInArrow(pair_log(done), CHANGES).groupBy("left", "right").agg(F.sum("change").alias("n"))
        single = (left < FIRST_MERGED) & (right < FIRST_MERGED)
        admissible = single | (length_of(left) + length_of(right) < max_token_length)
        top = counted.filter((n >= max(min_frequency, 1)) & admissible).orderBy(F.desc("n"), "left", "right").limit(known_pairs)
        rows = top.toArrow().to_pydict()
        return KnownPairs(zip(rows["left"], rows["right"], rows["n"]), known_pairs, max(min_frequency, 1))

    # A word of one symbol has no pair left and can leave the training state.
    several = F.size("symbols") > 1
    codes = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.ascii(c))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = written(stored.select(codes.alias("symbols"), "cnt").filter(several).repartition(slots), "bpe-base")
    drop_stage(spark, paths.pop(0))

    frequent = base.orderBy(F.desc("cnt")).limit(guess_words).toArrow().combine_chunks()
    sample = next(blocks(frequent.to_batches(max_chunksize=guess_words), at_least=guess_words), None)
    sample = sample and Indexed(sample, undoable=True)
    done: list[tuple[int, int, int]] = []
    known = count_known(base, done)
    steps = 16
    while sample is not None and len(tokens) < vocab_size:
        if known.best() is None:
            # The pairs known are used up, or not known to be first: count all pairs again.
            known = count_known(base, done)
            if known.best() is None:
                break
        guessed_tokens.clear()
        room = min(steps if batched else 1, vocab_size - len(tokens))
        tried = guess_merges(
            known, sample, room, FIRST_MERGED + len(merged_tokens), is_token, may_merge,
            lambda left, right: guessed_tokens.append(text_of(left) + text_of(right)),
        )
        guesses = list(guessed_tokens)
        again = guesses[0] in code_of  # a merge that makes a token once more: tried alone
        if again:
            tried = [(*tried[0][:2], code_of[guesses[0]])]
            sample.undo(1)
            sample.merge_and_count(*tried[0])
        log = base.mapInArrow(change_log(done, tried), CHANGES).groupBy("step", "left", "right").agg(F.sum("change").alias("change"))
        rows = log.filter("change <> 0").toArrow().to_pydict()
        changes: list[list[tuple[int, int, int]]] = [[] for _ in tried]
        for step, left, right, by in zip(*(rows[c] for c in ("step", "left", "right", "change"))):
            changes[step].append((left, right, by))
        accepted = 0
        for (left, right, code), token in zip(tried, guesses):
            first = known.best()
            if first is None or first[1:] != (left, right):
                break
            merges.append((text_of(left), text_of(right)))
            if not again:
                code_of[token] = code
                merged_tokens.append(token)
                guessed_tokens.pop(0)
                tokens.append(token)
            done.append((left, right, code))
            known.change(changes[accepted], code, may_merge)
            accepted += 1
        guessed_tokens.clear()
        sample.undo(len(tried) - accepted)
        sample.past.clear()
        steps = max(8, min(2 * accepted + 2, GUESSED_MERGES))
        if again:
            # Pairs with the old token may have become more frequent than they were known to be.
            known = count_known(base, done)
        if len(done) >= merges_per_base:
            base = written(base.mapInArrow(rewriter(done), base.schema).filter(several), "bpe-base")
            drop_stage(spark, paths.pop(0))
            done = []
    for path in paths:
        drop_stage(spark, path)
    return Tokenizer(tuple(tokens), frozenset(specials), tuple(merges))
