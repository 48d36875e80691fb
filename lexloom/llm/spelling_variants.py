"""Spelling variants: words at edit distance one, found in a trie of letter-group counts.

A word is described by how many of its letters fall into each group of ``GROUPS``.  One
inserted letter raises one count by one (a surplus); one replaced letter raises one count
and lowers another (a surplus and a deficit), or changes none.  The words are arranged in
a trie by these counts, group after group, and a depth-first search goes down it with a
budget of one surplus and one deficit; the words at its leaves are verified letter by letter.

Each pair is looked for from one side only: the shorter word looks for the longer one, and
of two words of one length the one whose counts are lower at the first group that differs
looks for the other.  So the deficit may be spent only after the surplus.

The trie is cut into cells, dealt over the cluster.  A node that holds more words than a
cell may is split by the next group; counts of nodes come from one aggregate over all words.
A cell holds ``CELL_WORDS`` words at most, or a ten-thousandth of all words where that is
more, so at each level fewer than ten thousand nodes are split, whatever the words are:
only these nodes go to the driver and the tasks.  A node still too large after the last group (many
words of the same counts) is not searched in one task: its words meet by their patterns with
one letter left out, an ordinary join in which no pattern has more words than there are letters.

Defined cases: a null text and an empty text hold no words; a null key counts as an empty
one where the key decides (see ``count_runs``); repeated rows are counted as often as they
stand.  An empty table gives no words.  Columns other than the key and the text are not read.
A word of any length is one word; work grows with its length, for a word in a node too large
to search with the square of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ascii_lower
from lexloom.session import write_and_read

# Letter groups, frequent letters alone and first; every other character is in one last group.
GROUPS = ("e", "a", "i", "n", "r", "s", "t", "o", "l", "u", "d", "hw", "cg", "mp", "bvf", "kjqxyz")
LEVELS = len(GROUPS) + 1
CELL_WORDS = 4000
CELL_SHARE = 10_000
# Verify all words of a node against all that reached it where these are so few pairs.
FEW_PAIRS = 600
PAIRS_AT_ONCE = 1 << 18

RUNS = r"[^A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, TIMES, EVERY = 5, 3, 2, 97


def count_runs(docs: DataFrame, key: str, text: str, every: int = EVERY) -> DataFrame:
    """``word``, ``n``: maximal runs of Latin letters of all texts, A-Z lower-cased, and how often
    each occurs.  Where ``every`` divides the crc32 of ``<key>:<run>``, one letter of the run is
    left out, chosen by the same number."""
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"),
        F.explode(F.split(F.col(text), RUNS)).alias("__run"),
    ).filter("__run <> ''")
    # ``lower`` changes A-Z alone in a run of ASCII letters, and is much faster than ``translate``.
    run = F.col("__run")
    low = F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(ascii_lower(run))
    runs = runs.select("__key", low.alias("__run"))
    h = F.crc32(F.concat("__key", F.lit(":"), "__run").cast("binary"))
    at = (h % F.length("__run")).cast("int")
    cut = F.concat(F.substring(F.col("__run"), F.lit(1), at), F.substring(F.col("__run"), at + 2, F.length("__run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("__run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def group_counts() -> Column:
    """The path of ``word`` in the trie: one count for each group."""
    listed = [F.length("word") - F.length(F.translate("word", g, "")) for g in GROUPS]
    other = F.length("word") - sum(listed[1:], listed[0])
    return F.array(*[c.cast("int") for c in listed], other.cast("int"))


def split_nodes(words: DataFrame, cell_words: int, cell_share: int = CELL_SHARE) -> set[tuple[int, ...]]:
    """Nodes of the trie with more words than a cell may hold, as tuples of counts."""
    n = words.count()
    most = max(cell_words, -(-n // cell_share))
    if n <= most:
        return set()
    paths = words.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    nodes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda d: F.slice("path", 1, d))).alias("node"), "n")
    large = nodes.groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    # Fewer than ``cell_share`` nodes of a level hold more than that share of the words.
    return {()} | {tuple(r["node"]) for r in large.select("node").collect()}


def steps(state: np.ndarray, counts: np.ndarray, value: int | None = None):
    """The ways on for words that come to a level: (which, next count, next state).

    State 0: nothing spent; 1: the surplus; 2: the surplus and the deficit.
    """
    for change, before, after in ((0, None, None), (1, 0, 1), (-1, 1, 2)):
        may = np.ones(len(state), bool) if before is None else state == before
        if value is not None:
            may &= counts + change == value
        which = np.flatnonzero(may)
        yield which, counts[which] + change, state[which] if after is None else np.full(len(which), after, np.int8)


def find_cells(paths: np.ndarray, split: set[tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """Depth-first through the split nodes: (cell, words that reach it, their states).

    A word with state 0 in a cell belongs to it; the others only look there.
    """
    stack = [((), np.arange(len(paths)), np.zeros(len(paths), np.int8))]
    while stack:
        node, rows, state = stack.pop()
        if node not in split or len(node) == LEVELS:
            yield node, rows, state
            continue
        ways = list(steps(state, paths[rows, len(node)]))
        at = np.concatenate([rows[w] for w, _, _ in ways])
        counts = np.concatenate([c for _, c, _ in ways])
        states = np.concatenate([s for _, _, s in ways])
        for value in np.unique(counts[counts >= 0]):
            here = counts == value
            stack.append(((*node, int(value)), at[here], states[here]))


class Letters:
    """Words as one array of code points."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.start = np.cumsum(self.size) - self.size

    def pairs_at_distance_one(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which pairs differ by one letter; ``two`` is never the shorter word."""
        more = self.size[two] - self.size[one]
        good = np.zeros(len(one), bool)
        for longer in (0, 1):
            at = np.flatnonzero(more == longer)
            size = self.size[one[at]]
            begin = np.cumsum(size) - size
            inner = np.arange(size.sum()) - np.repeat(begin, size)
            a = self.flat[np.repeat(self.start[one[at]], size) + inner]
            b = np.repeat(self.start[two[at]], size) + inner
            differs = a != self.flat[b]
            if not longer:
                total = np.concatenate([[0], np.cumsum(differs)])
                good[at] = total[begin + size] - total[begin] == 1
            else:
                # The longer word without one letter: equal before some place, shifted by one after it.
                shifted = a != self.flat[b + 1]
                whole = np.repeat(size, size)
                prefix = np.minimum.reduceat(np.where(differs, inner, whole), begin) if len(at) else size
                suffix = np.maximum.reduceat(np.where(shifted, inner + 1, 0), begin) if len(at) else size
                good[at] = suffix <= prefix
        return good


def search_cell(words: list[str], paths: np.ndarray, state: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at distance one between the words of a cell (state 0) and all that reached it."""
    letters = Letters(words)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0

    def verify(one: np.ndarray, two: np.ndarray) -> None:
        good = letters.pairs_at_distance_one(one, two)
        found.append((one[good], two[good]))

    def settle() -> None:
        if waiting:
            verify(*(np.concatenate(side) for side in zip(*waiting)))
            waiting.clear()

    own = np.flatnonzero(state == 0)
    stack = [(level, own, np.arange(len(words)), state)] if len(own) else []
    while stack:
        depth, own, seekers, spent = stack.pop()
        if depth < LEVELS and len(own) * len(seekers) > FEW_PAIRS:
            for value in np.unique(paths[own, depth]):
                ways = list(steps(spent, paths[seekers, depth], value))
                rows = np.concatenate([seekers[w] for w, _, _ in ways])
                if len(rows):
                    stack.append((depth + 1, own[paths[own, depth] == value], rows, np.concatenate([s for _, _, s in ways])))
            continue
        for first in range(0, len(seekers), max(1, PAIRS_AT_ONCE // len(own))):
            seek = seekers[first : first + max(1, PAIRS_AT_ONCE // len(own))]
            now = spent[first : first + len(seek)]
            # What is left of both paths, against what is left of the budget.
            rest = paths[own][:, None, depth:] - paths[seek][None, :, depth:]
            up, down = np.maximum(rest, 0).sum(2), np.maximum(-rest, 0).sum(2)
            fits = (up <= (now == 0)) & (down <= (now < 2))
            if depth < LEVELS:  # a deficit in front of the surplus: the other word looks for this one
                fits &= (down == 0) | (now == 1) | ((up == 1) & ((rest > 0).argmax(2) < (rest < 0).argmax(2)))
            # Of two words of one length and one path, the lesser one looks for the other.
            i, j = np.nonzero(fits)
            one, two = seek[j], own[i]
            ahead = letters.size[two] - letters.size[one]
            used = (now[j] > 0) | (up[i, j] > 0)
            keep = (ahead == 1) | ((ahead == 0) & (used | (one < two)))
            one, two = one[keep], two[keep]
            many += len(one)
            waiting.append((one, two))
            if many >= PAIRS_AT_ONCE:
                settle()
                many = 0
    settle()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found))


def paths_of(words: list[str]) -> np.ndarray:
    """The counts of ``group_counts`` for a list of words."""
    letters = Letters(words)
    group = np.full(int(letters.flat.max(initial=0)) + 1, LEVELS - 1)
    for g, members in enumerate(GROUPS):
        for ch in members:
            if ord(ch) < len(group):
                group[ord(ch)] = g
    at = np.repeat(np.arange(len(words)), letters.size) * LEVELS + group[letters.flat]
    return np.bincount(at, minlength=len(words) * LEVELS).reshape(-1, LEVELS)


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: every ordered pair of words at edit distance one.

    ``words`` has distinct ``word`` and ``n``, and should be a written stage.
    """
    split = split_nodes(words.withColumn("path", group_counts()), cell_words)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            listed = part["word"].tolist()
            for cell, rows, state in find_cells(paths_of(listed), split):
                taken = part.iloc[rows]
                yield pd.DataFrame(
                    {"cell": ".".join(map(str, cell)), "word": taken["word"].to_numpy(), "n": taken["n"].to_numpy(), "state": state}
                )

    # Words over all cores, however few files they lie in; then one copy for each cell reached.
    dealt = words.select("word", "n").repartition("word").mapInPandas(deal, "cell string, word string, n bigint, state byte")
    full = [".".join(map(str, node)) for node in split if len(node) == LEVELS]
    search = _cell_searcher()
    hot = F.col("cell").isin(full) if full else F.lit(False)
    pairs = dealt.filter(~hot).groupBy("cell").applyInPandas(search, "word string, n bigint, near string, near_n bigint")
    if full:
        pairs = pairs.unionByName(pairs_by_pattern(dealt.filter(hot)))
    both = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.inline(both))


def _cell_searcher():
    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word", ignore_index=True)
        listed, n = group["word"].tolist(), group["n"].to_numpy()
        names = np.array(listed, dtype=object)
        one, two = search_cell(listed, paths_of(listed), group["state"].to_numpy(np.int8), len(key[0].split(".")) if key[0] else 0)
        return pd.DataFrame({"word": names[one], "n": n[one], "near": names[two], "near_n": n[two]})

    return search


def pairs_by_pattern(rows: DataFrame) -> DataFrame:
    """The same pairs for nodes too large to search: words that are equal without one letter."""
    places = F.sequence(F.lit(1), F.length("word"))
    without = lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word")))
    own = rows.filter("state = 0").select(
        "cell", F.col("word").alias("near"), F.col("n").alias("near_n"),
        F.explode(F.transform(places, lambda i: F.struct(i.alias("at"), without(i).alias("rest")))).alias("p"),
    ).select("cell", "near", "near_n", "p.*")
    seek = rows.select("cell", "word", "n", "state")
    longer = seek.filter("state = 1").join(
        own.select("cell", F.col("rest").alias("word"), "near", "near_n").distinct(), ["cell", "word"]
    )
    patterns = seek.filter("state <> 1").select(
        "cell", "word", "n", "state", F.explode(F.transform(places, lambda i: F.struct(i.alias("at"), without(i).alias("rest")))).alias("p")
    ).select("cell", "word", "n", "state", "p.*")
    replaced = patterns.join(own, ["cell", "at", "rest"]).filter("state = 2 OR word < near")
    columns = ["word", "n", "near", "near_n"]
    return longer.select(*columns).unionByName(replaced.select(*columns))


def follow_forms(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last word reached from ``word`` by its forms.

    Each step at least doubles the count of a word, so a chain is as long as the logarithm
    of the greatest count, and each round halves what is left of it.
    """
    ways = write_and_read(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = ways.select(F.col("word").alias("__at"), F.col("root").alias("__on"))
        jumped = ways.join(on, F.col("root") == F.col("__at"), "left").select(
            "word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("__moved")
        )
        stored = write_and_read(jumped, "variant-roots")
        ways = stored.select("word", "root")
        if stored.filter("__moved").isEmpty():
            return ways


def spelling_variants(
    docs: DataFrame,
    key: str,
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    times: int = TIMES,
    every: int = EVERY,
    cell_words: int = CELL_WORDS,
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of ``min_length``
    letters or more that occurs ``min_count`` times or more.

    ``form`` is the most frequent near word (ties: the least in code-point order) if it is
    ``times`` as frequent as the word.
    """
    words = count_runs(docs, key, text, every).filter((F.length("word") >= min_length) & (F.col("n") >= min_count))
    words = write_and_read(words, "variant-words")
    # The greatest count, and for equal counts the least word: strings compare by code points.
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_pairs(words, cell_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"), best.alias("b"))
    formed = -F.col("b.minus") >= times * F.col("n")
    near = near.select("word", "n_near", F.when(formed, F.col("b.near")).alias("form"), F.when(formed, -F.col("b.minus")).alias("form_n"))
    near = write_and_read(near, "variant-near")
    roots = follow_forms(near.filter("form IS NOT NULL"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        "form_n",
    )
