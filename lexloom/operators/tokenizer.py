"""The tokenizer as two small tables, and text split into words.

``vocab(id, token, is_special)`` and ``merges(rank, left, right)`` have at most
``vocab_size`` rows each.  They are the model, not data: their size is a
parameter of the training, so they may be held on the driver and broadcast.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The word-start mark, the special tokens and their order.
WORD_START = "▁"
UNK, CLS, SEP, PAD, MASK, EOS = "[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "[EOS]"
TRAINED_SPECIALS = (UNK, CLS, SEP, PAD, MASK)
ENSURED_SPECIALS = (UNK, PAD, EOS, MASK)

# Fixed value: a punctuation character is Unicode punctuation or an ASCII symbol.
PUNCTUATION = r"\p{P}$+<=>^`|~"
WORD_PATTERN = f"{WORD_START}[^{WORD_START}{PUNCTUATION}]*|[^{WORD_START}{PUNCTUATION}]+|[{PUNCTUATION}]"

VOCAB_SCHEMA = "id int, token string, is_special boolean"
MERGES_SCHEMA = "rank int, left string, right string"

# Characters of text that a task cuts into chunks at a time; a row is not divided.
CHARACTERS_AT_ONCE = 2_000_000

# A tokenizer larger than this is refused, so that what is broadcast stays bounded.
MAX_VOCAB = 1_000_000


@dataclass(frozen=True)
class Tokenizer:
    """Tokens by id, how many leading ids are special, and the merges in rank order."""

    tokens: tuple[str, ...]
    specials: frozenset[str]
    merges: tuple[tuple[str, str], ...]

    def __post_init__(self) -> None:
        if len(self.tokens) > MAX_VOCAB or len(self.merges) > MAX_VOCAB:
            raise ValueError(f"a tokenizer of more than {MAX_VOCAB} tokens or merges is not supported")

    def __len__(self) -> int:
        return len(self.tokens)

    def id_of(self, token: str) -> int:
        return self.tokens.index(token)

    def with_specials(self, wanted: Sequence[str] = ENSURED_SPECIALS) -> Tokenizer:
        """Missing special tokens are added at the end; known ones become special."""
        known = set(self.tokens)
        added = tuple(t for t in wanted if t not in known)
        return Tokenizer(self.tokens + added, self.specials | set(wanted), self.merges)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, t in self.specials) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, VOCAB_SCHEMA)

    def merges_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, left, right) for rank, (left, right) in enumerate(self.merges)]
        return spark.createDataFrame(rows, MERGES_SCHEMA)


def tokenizer_from_tables(vocab: DataFrame, merges: DataFrame) -> Tokenizer:
    """Read the model back; more rows than a tokenizer may have are never fetched."""

    def fetch(table: DataFrame, order: str) -> list:
        return table.orderBy(order).limit(MAX_VOCAB + 1).collect()

    tokens = fetch(vocab.select("id", "token", "is_special"), "id")
    pairs = fetch(merges.select("rank", "left", "right"), "rank")
    return Tokenizer(
        tuple(r.token for r in tokens),
        frozenset(r.token for r in tokens if r.is_special),
        tuple((r.left, r.right) for r in pairs),
    )


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def _nfkc() -> Callable[[Column], Column]:
    # Nested, so that it travels to the workers by value.
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(compose, T.StringType())


def normalize(col: Column, ascii_only: bool = False) -> Column:
    """NFKC, then lowercase.  On cleaned text NFKC changes nothing and is skipped."""
    return F.lower(col if ascii_only else _nfkc()(col))


def mark_words(col: Column) -> Column:
    """Spaces become the word-start mark, and one is put in front where absent.

    The text is named once only: an expression that names it twice would make
    the optimizer evaluate the cleaning in front of it twice.
    """
    marked = F.replace(col, F.lit(" "), F.lit(WORD_START))
    return F.regexp_replace(marked, F.lit(f"^(?=[^{WORD_START}])"), F.lit(WORD_START))


def split_words(col: Column) -> Column:
    """Words of a text: split before each word-start mark, punctuation on its own."""
    return F.regexp_extract_all(mark_words(col), F.lit(WORD_PATTERN), F.lit(0))


def spaced(col: Column, ascii_only: bool = False) -> Column:
    """The normalized text with spaces for word-start marks: what lies between two spaces, a chunk,
    holds one word or several, and no word lies in two.  Tasks cut it with ``chunks_of``, far cheaper than
    ``split_words`` and than lists of chunks are to move; that on all chunks with a mark in front
    gives the words of the text.
    """
    return F.replace(normalize(col, ascii_only), F.lit(WORD_START), F.lit(" "))


def chunks_of(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The chunks between the spaces of all texts, which of them count, and how many count in each text: a
    space in front of a text begins its first chunk, and an empty or null text has none."""
    lists = pc.split_pattern(texts, " ")
    n_chunks = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    first = (np.cumsum(n_chunks) - n_chunks)[n_chunks > 0]
    empty = pc.equal(pc.binary_length(flat.take(pa.array(first))), 0).to_numpy(zero_copy_only=False)
    counts = np.ones(len(flat), bool)
    counts[first[empty]] = False
    n_chunks[n_chunks > 0] -= empty
    return flat.dictionary_encode(), counts, n_chunks


def in_slices(part: pa.RecordBatch, words: int, at_once: int = CHARACTERS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch as runs of rows whose ``words``, texts or lists of them, begin within ``at_once``
    characters, a mark counted for each; no row is copied."""
    column = part.column(words)
    listed = column.flatten() if pa.types.is_list(column.type) else column
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(listed), 0).to_numpy(zero_copy_only=False) + 1)])
    n_words = np.ones(len(column), np.int64)
    if listed is not column:
        n_words = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = before[np.cumsum(n_words)]
    cuts = np.flatnonzero(np.diff(ends // at_once)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows]):
        if begin < end:
            yield part.slice(begin, end - begin)


def count_words(df: DataFrame, text: str, ascii_only: bool = False) -> DataFrame:
    """``word``, ``cnt``: counted on the map side first, so a very common word is no hot key.

    Chunks are counted before they are split, so that a chunk is split once however often it occurs.
    """

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(in_slices(p, 0) for p in parts):
            chunks, counts, _ = chunks_of(part.column(0))
            n = np.bincount(chunks.indices.to_numpy()[counts], minlength=len(chunks.dictionary))
            found = pa.RecordBatch.from_arrays([chunks.dictionary, pa.array(n)], names=["chunk", "cnt"])
            yield found.filter(pa.array(n > 0))

    texts = df.select(spaced(F.col(text), ascii_only).alias("__text"))
    chunks = texts.mapInArrow(counted, "chunk string, cnt bigint").groupBy("chunk").agg(F.sum("cnt").alias("cnt"))
    words = chunks.select(split_words(F.concat(F.lit(WORD_START), "chunk")).alias("words"), "cnt")
    # An inner explode would push a test of the list below the projection that
    # makes it, and make it twice; the outer one does not.
    single = words.select(F.explode_outer("words").alias("word"), "cnt")
    return single.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def characters(words: DataFrame) -> DataFrame:
    return words.select(F.explode_outer(F.split("word", "")).alias("ch")).filter(F.col("ch") != "").distinct()


def initial_alphabet(words: DataFrame, n_specials: int = len(TRAINED_SPECIALS)) -> DataFrame:
    """Every character seen, ids by code point after the special tokens.

    A character set has at most 1.1 million members, so one small window does.
    Strings compare by their UTF-8 bytes, which is the order of code points.
    """
    rank = F.row_number().over(Window.orderBy("ch"))
    return characters(words).select((rank - 1 + n_specials).cast("int").alias("id"), F.col("ch").alias("token"))
