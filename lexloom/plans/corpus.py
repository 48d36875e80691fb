"""From raw documents to batches for a training run, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import clean_text
from lexloom.operators import packing, relational, sampling
from lexloom.operators.bpe_encoding import encode
from lexloom.operators.position import with_source_position
from lexloom.operators.tokenizer import EOS, PAD, Tokenizer
from lexloom.session import drop_stage, write_and_read, write_bucketed, write_stage


@dataclass(frozen=True)
class CorpusSettings:
    seq_length: int = 512
    shards: int = 16
    batch_size: int = 2024
    max_documents: int = -1
    pack: bool = True
    mask_first: bool = False
    drop_partial_batches: bool = False
    mask_compat: bool = False
    buckets: int = 0


def clean_documents(docs: DataFrame, key: str, text: str = "text", settings: CorpusSettings = CorpusSettings()) -> DataFrame:
    """``key``, ``text``: limited by key order before cleaning, so no text is cleaned in vain."""
    rows = relational.head(relational.keep_text(docs, text, key), settings.max_documents, key)
    if settings.drop_partial_batches:
        rows = relational.assign_batches(rows, key, settings.shards, settings.batch_size)
        rows = relational.drop_partial_batches(rows, settings.batch_size).select(key, text)
    return rows.withColumn(text, clean_text(F.col(text), settings.mask_first))


# Ids of a tokenizer of so many tokens are moved as two bytes each.
SMALL_IDS = 1 << 15
# Rows of one batch that ``row_id`` can number; a larger batch is an error.
ROW_BITS = 24


def number_rows(packed: DataFrame) -> DataFrame:
    """``row_id``: unique and in (batch, row) order, from the two numbers alone."""
    full = F.raise_error(F.lit(f"a batch has over 2**{ROW_BITS} rows")).cast("bigint")
    row_no = F.when(F.col("row_no") < 1 << ROW_BITS, F.col("row_no")).otherwise(full)
    return packed.withColumn("row_id", F.shiftleft("batch_id", ROW_BITS) + row_no)


def prepare_corpus(
    docs: DataFrame, key: str, tok: Tokenizer, text: str = "text", settings: CorpusSettings = CorpusSettings()
) -> DataFrame:
    """``row_id``, ``input_ids``, ``attention_mask`` of at least ``seq_length`` tokens per row.

    The encoded and the packed stage are written to the shared folder: packing scans its
    sizes and its arrays separately, and sampling reads keys and lengths before it reads rows.
    The encoded stage is deleted once the packed one is written.
    With ``buckets`` the packed rows lie in that many buckets by ``row_id``, so that collating
    them into batches, once or for many runs, moves each row once only.
    """
    cleaned = clean_documents(docs, key, text, settings)
    encoded = encode(cleaned, key, text, tok, ascii_only=True)
    if not settings.pack:
        encoded = relational.drop_columns(encoded, ["length", "token_type_ids"])
        return relational.min_length(encoded, "input_ids", settings.seq_length).withColumnRenamed(key, "row_id")
    # The length stays in the stage: bins and places are worked out from it alone, and rows are told
    # apart by their place in the stage, so that the arrays are moved to their rows and nowhere else before.
    columns = ["input_ids", "attention_mask"]
    kind = "smallint" if len(tok) <= SMALL_IDS else "int"
    narrow = encoded.select(key, *[F.col(c).cast(f"array<{kind}>").alias(c) for c in columns], "length")
    encoded, path = write_stage(narrow, "encoded")
    numbered = with_source_position(encoded, "__at")
    sizes = relational.assign_batches(numbered.select(key, "length", "__at"), key, settings.shards, settings.batch_size)
    batched, batched_path = write_stage(sizes, "batched")
    fill = packing.fill_values(columns, tok.id_of(EOS), tok.id_of(PAD), mask_compat=settings.mask_compat)
    packed = packing.balanced_pack(batched, key, fill, settings.seq_length, size="length", arrays=(numbered, "__at"))
    long_enough = relational.min_length(packed, "input_ids", settings.seq_length)
    rows = number_rows(long_enough).select("row_id", *[F.col(c).cast("array<int>").alias(c) for c in columns])
    rows = write_bucketed(rows, "row_id", settings.buckets, "packed") if settings.buckets else write_and_read(rows, "packed")
    for read in (path, batched_path):
        drop_stage(docs.sparkSession, read)
    return rows


def plain_chunks(docs: DataFrame, key: str, tok: Tokenizer, text: str = "text", length: int = 512) -> DataFrame:
    """The plain variant: tokenize as is, concatenate, cut, drop the remainder."""
    encoded = encode(docs.select(key, text), key, text, tok).select(key, "input_ids", "length")
    return packing.chunk(write_and_read(encoded, "encoded"), key, ["input_ids"], length, size="length")


def training_batches(
    rows: DataFrame,
    ranks: int,
    batch_size: int,
    epochs: int = 1,
    seed: int = 0,
    key: str = "row_id",
    max_examples: int = -1,
    mega_size: int | None = None,
    label_pad: int | None = None,
    reseed: bool = True,
) -> DataFrame:
    """``epoch``, ``rank``, ``batch`` and lists of rows: what every worker reads, in order.

    Each epoch has its own permutation, or with ``reseed=False`` repeats the first.  All epochs
    are one plan.  ``rows`` should be a written stage: keys and lengths are read before the rows.
    """
    if max_examples > 0:
        rows = relational.head(rows, max_examples, key)
    columns = [c for c in rows.columns if c not in (key, "labels")]
    sized = relational.with_length(rows, "input_ids")
    moved = sampling.narrowed(rows, columns)

    def collated(assigned: DataFrame, by: list[str]) -> DataFrame:
        batches = sampling.collate(sampling.assign_rank_batches(assigned, batch_size), moved, key, columns, by)
        whole = {c: F.col(c).cast("array<array<int>>") for c in columns if moved.schema[c] != rows.schema[c]}
        # The labels are made in the batches, so that no second copy of the ids is moved.
        return packing.causal_labels(batches.withColumns(whole), "input_ids", label_pad)

    options = {"mega_size": mega_size, "seed": seed, "drop_last": True}
    if not reseed:
        assigned = sampling.grouped_sampler(sized, key, "length", ranks, **options)
        return sampling.repeat_epochs(collated(assigned, ["rank", "batch"]), epochs)
    assigned = sampling.grouped_sampler_of_epochs(sized, key, "length", ranks, epochs, **options)
    return collated(assigned, ["epoch", "rank", "batch"])
