"""Permutation, grouping, distribution, splits and batches, as checkable queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import permutation as keyed
from lexloom.operators import sampling as sp
from lexloom.operators.position import with_row_position, with_source_position
from lexloom.plans import sql
from lexloom.plans.packing_queries import joined, word_ids
from lexloom.plans.registry import query, table
from lexloom.session import write_bucketed

SEED, EPOCH, MEGA, RANKS, BATCH, FULL_BATCH = 7, 3, 50, 7, 16, 64
PERMUTED = sql.permuted("documents", "doc_id", SEED)
GROUPED = f"""{PERMUTED},
flat as (
  select doc_id, n_chars, (perm_pos // {MEGA}) * {MEGA}
      + row_number() over (partition by perm_pos // {MEGA} order by n_chars desc, perm_pos) - 1 as flat_pos
  from permuted),
counts as (select count(*) as n from documents)"""
WRAPPED = f"""{GROUPED},
total as (select n, ((n + {RANKS} - 1) // {RANKS}) * {RANKS} as total from counts),
evened as (
  select f.doc_id, p as flat_pos from total, range(0, (select total from total)) as r(p), flat f
  where f.flat_pos = p % n)"""
DROPPED = f"""{GROUPED},
total as (select case when n % {RANKS} = 0 then n else ((n - 1) // {RANKS}) * {RANKS} end as total from counts),
evened as (select doc_id, flat_pos from flat, total where flat_pos < total)"""


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "n_chars")


def permuted(spark: SparkSession, folder: str) -> DataFrame:
    return sp.permute(lengths(spark, folder), "doc_id", SEED)


def flat(spark: SparkSession, folder: str) -> DataFrame:
    return sp.sort_in_mega_batches(permuted(spark, folder), "n_chars", MEGA)


def sampled(spark: SparkSession, folder: str, **options) -> DataFrame:
    options = {"mega_size": MEGA, "seed": SEED, **options}
    return sp.grouped_sampler(lengths(spark, folder), "doc_id", "n_chars", RANKS, **options)


def as_bigint(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in df.columns])


@query("permutation", f"with {PERMUTED} select doc_id, perm_pos from permuted")
def permutation(spark: SparkSession, folder: str) -> DataFrame:
    return permuted(spark, folder).select("doc_id", "perm_pos")


@query(
    "permutation_of_epoch",
    f"with {sql.permuted('documents', 'doc_id', SEED + EPOCH)} select doc_id, perm_pos from permuted",
)
def permutation_of_epoch(spark: SparkSession, folder: str) -> DataFrame:
    return sp.permute(lengths(spark, folder), "doc_id", SEED, EPOCH).select("doc_id", "perm_pos")


@query(
    "mega_batches",
    f"""with {PERMUTED} select doc_id,
      perm_pos // greatest((select count(*) from documents) // 1000, 1) as mega from permuted""",
)
def mega_batches(spark: SparkSession, folder: str) -> DataFrame:
    return sp.mega_batches(permuted(spark, folder)).select("doc_id", "mega")


@query("sort_in_mega_batches", f"with {GROUPED} select doc_id, flat_pos from flat")
def sort_in_mega_batches(spark: SparkSession, folder: str) -> DataFrame:
    return flat(spark, folder).select("doc_id", "flat_pos")


@query(
    "sort_in_large_mega_batches",
    f"""with {PERMUTED} select doc_id, (perm_pos // 200000) * 200000
      + row_number() over (partition by perm_pos // 200000 order by n_chars desc, perm_pos) - 1 as flat_pos
    from permuted""",
)
def sort_in_large_mega_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A mega-batch too large for one window group: ranked by buckets."""
    return sp.sort_in_mega_batches(permuted(spark, folder), "n_chars", 200_000).select("doc_id", "flat_pos")


@query("even_out_wrap", f"with {WRAPPED} select doc_id, flat_pos from evened")
def even_out_wrap(spark: SparkSession, folder: str) -> DataFrame:
    return sp.even_out(flat(spark, folder).select("doc_id", "flat_pos"), RANKS, False)


@query("even_out_drop", f"with {DROPPED} select doc_id, flat_pos from evened")
def even_out_drop(spark: SparkSession, folder: str) -> DataFrame:
    return sp.even_out(flat(spark, folder).select("doc_id", "flat_pos"), RANKS, True)


@query(
    "rank_stride",
    f"""select doc_id, (row_number() over (order by doc_id) - 1) % {RANKS} as rank,
      (row_number() over (order by doc_id) - 1) // {RANKS} as idx from documents""",
)
def rank_stride(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_row_position(table(spark, folder, "documents").select("doc_id"), "doc_id", "flat_pos")
    return as_bigint(sp.stride(rows, RANKS).select("doc_id", "rank", "idx"))


@query(
    "grouped_sampler",
    f"with {WRAPPED} select doc_id, flat_pos % {RANKS} as rank, flat_pos // {RANKS} as idx from evened",
)
def grouped_sampler(spark: SparkSession, folder: str) -> DataFrame:
    return as_bigint(sampled(spark, folder).select("doc_id", "rank", "idx"))


@query(
    "grouped_sampler_drop_last",
    f"with {DROPPED} select doc_id, flat_pos % {RANKS} as rank, flat_pos // {RANKS} as idx from evened",
)
def grouped_sampler_drop_last(spark: SparkSession, folder: str) -> DataFrame:
    return as_bigint(sampled(spark, folder, drop_last=True).select("doc_id", "rank", "idx"))


@query(
    "grouped_sampler_one_rank",
    f"""with {DROPPED} select doc_id, flat_pos % {RANKS} as rank, flat_pos // {RANKS} as idx from evened
        where flat_pos % {RANKS} = 2""",
)
def grouped_sampler_one_rank(spark: SparkSession, folder: str) -> DataFrame:
    return as_bigint(sampled(spark, folder, drop_last=True, rank=2).select("doc_id", "rank", "idx"))


@query(
    "plain_sampler",
    f"""with p as (select doc_id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents)
    select doc_id, pos % {RANKS} as rank, pos // {RANKS} as idx from p
    where pos < case when n % {RANKS} = 0 then n else ((n - 1) // {RANKS}) * {RANKS} end""",
)
def plain_sampler(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return as_bigint(sp.plain_sampler(docs, "doc_id", RANKS).select("doc_id", "rank", "idx"))


@query(
    "train_eval_split",
    f"""with {PERMUTED}, counts as (select count(*) as n from documents)
    select doc_id, case when perm_pos < floor(0.95::double * n / {FULL_BATCH}) * {FULL_BATCH}
                        then 'train' else 'eval' end as split from permuted, counts""",
)
def train_eval_split(spark: SparkSession, folder: str) -> DataFrame:
    return sp.split_train_eval(table(spark, folder, "documents").select("doc_id"), "doc_id", 0.05, FULL_BATCH, SEED)


BATCHED = f"""{DROPPED},
ranked as (select doc_id, flat_pos % {RANKS} as rank, flat_pos // {RANKS} as idx from evened),
batched as (
  select *, idx // {BATCH} as batch from ranked
  qualify count(*) over (partition by rank, idx // {BATCH}) = {BATCH})"""


def rank_batches(spark: SparkSession, folder: str) -> DataFrame:
    return sp.assign_rank_batches(sampled(spark, folder, drop_last=True), BATCH)


@query("rank_batches", f"with {BATCHED} select doc_id, rank, idx, batch from batched")
def rank_batches_query(spark: SparkSession, folder: str) -> DataFrame:
    return as_bigint(rank_batches(spark, folder).select("doc_id", "rank", "idx", "batch"))


COLLATED_SQL = f"""with {BATCHED}, {sql.IDS}
    select rank, batch, string_agg(array_to_string(ids, ','), '|' order by idx) as rows,
      string_agg(doc_id, ',' order by idx) as doc_ids
    from batched join ids using (doc_id) group by rank, batch"""


def collated(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    rows = sp.collate(rank_batches(spark, folder), docs, "doc_id", ["ids", "doc"])
    text = F.transform("ids", lambda r: F.array_join(F.transform(r, lambda i: i.cast("string")), ","))
    return rows.select(
        F.col("rank").cast("bigint").alias("rank"),
        "batch",
        F.array_join(text, "|").alias("rows"),
        F.array_join(F.transform("doc", lambda i: i.cast("string")), ",").alias("doc_ids"),
    )


@query("collate_batches", COLLATED_SQL)
def collate_batches(spark: SparkSession, folder: str) -> DataFrame:
    return collated(spark, folder, word_ids(spark, folder).withColumn("doc", F.col("doc_id")))


@query("collate_bucketed", COLLATED_SQL)
def collate_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """Out of rows that lie in buckets by their key."""
    docs = word_ids(spark, folder).withColumn("doc", F.col("doc_id"))
    return collated(spark, folder, write_bucketed(docs, "doc_id", 8, "bucketed"))


EPOCHS = 20
ALL_EPOCHS = f"""every as (select epoch, doc_id, n_chars from documents, range({EPOCHS}) as e(epoch)),
shuffled as (
  select *, row_number() over (partition by epoch order by md5(({SEED} + epoch) || '|' || doc_id), doc_id) - 1 as perm_pos
  from every),
flat as (
  select epoch, doc_id, (perm_pos // {MEGA}) * {MEGA}
      + row_number() over (partition by epoch, perm_pos // {MEGA} order by n_chars desc, perm_pos) - 1 as flat_pos
  from shuffled),
counts as (select count(*) as n from documents),
evened as (
  select epoch, doc_id, flat_pos from flat, counts
  where flat_pos < case when n % {RANKS} = 0 then n else ((n - 1) // {RANKS}) * {RANKS} end)"""


def of_epochs(spark: SparkSession, folder: str, first: int = 0, epochs: int = EPOCHS) -> DataFrame:
    rows = lengths(spark, folder)
    return sp.grouped_sampler_of_epochs(rows, "doc_id", "n_chars", RANKS, epochs, MEGA, SEED, drop_last=True, first=first)


@query(
    "grouped_sampler_of_epochs",
    f"with {ALL_EPOCHS} select epoch, doc_id, flat_pos % {RANKS} as rank, flat_pos // {RANKS} as idx from evened",
)
def grouped_sampler_of_epochs(spark: SparkSession, folder: str) -> DataFrame:
    return as_bigint(of_epochs(spark, folder).select("epoch", "doc_id", "rank", "idx"))


@query(
    "collate_batches_of_epochs",
    f"""with {ALL_EPOCHS}, {sql.IDS},
    ranked as (select epoch, doc_id, flat_pos % {RANKS} as rank, flat_pos // {RANKS} as idx from evened),
    batched as (
      select *, idx // {BATCH} as batch from ranked
      qualify count(*) over (partition by epoch, rank, idx // {BATCH}) = {BATCH})
    select epoch, rank, batch, md5(string_agg(array_to_string(ids, ','), '|' order by idx)) as rows,
      string_agg(doc_id, ',' order by idx) as doc_ids
    from batched join ids using (doc_id) group by epoch, rank, batch""",
)
def collate_batches_of_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """The batches of all epochs, each in its own order, a few epochs at a time."""
    docs = word_ids(spark, folder).select("doc_id", joined("ids").alias("text"), F.col("doc_id").alias("doc"))

    def assigned(first: int, epochs: int) -> DataFrame:
        return sp.assign_rank_batches(of_epochs(spark, folder, first, epochs), BATCH)

    def listed(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("epoch").cast("bigint").alias("epoch"),
            F.col("rank").cast("bigint").alias("rank"),
            "batch",
            F.md5(F.array_join("text", "|")).alias("rows"),
            F.array_join(F.transform("doc", lambda i: i.cast("string")), ",").alias("doc_ids"),
        )

    return sp.collate_epochs(assigned, docs, "doc_id", ["text", "doc"], EPOCHS, listed, packed=["text"])


DONE = 3


def permuted_sql(source: str, seed: int) -> str:
    """One pass of the keyed permutation over column ``v`` of ``source``; ``side`` and ``n`` are its columns."""
    p = keyed.PRIME
    text = f"select row_no, n, side, v // side as l, v % side as r from {source}"
    for factor, addend in keyed.round_keys(seed):
        line = f"((r * {factor} + {addend}) % {p})"
        text = f"select row_no, n, side, r as l, (l + {line} * {line} % {p} + r * {addend} % {p}) % side as r from ({text})"
    return f"select row_no, n, side, l * side + r as v from ({text})"


@query(
    "resume_by_inverse",
    f"""with recursive counted as (
      select row_number() over () - 1 as row_no, doc_id, text, count(*) over () as n from documents),
    start as (select row_no, n, ceil(sqrt(n))::bigint as side, row_no as v from counted),
    walk as (
      {permuted_sql('start', SEED + EPOCH)}
      union all
      {permuted_sql('(select * from walk where v >= n)', SEED + EPOCH)})
    select v % {RANKS} as rank, v // {RANKS * BATCH} as batch, v // {RANKS} as idx, doc_id, text
    from walk join counted using (row_no)
    where v < walk.n and v >= {DONE * RANKS * BATCH} and v < (walk.n // {RANKS} // {BATCH}) * {RANKS * BATCH}""",
)
def resume_by_inverse(spark: SparkSession, folder: str) -> DataFrame:
    """The batches still to come of a stopped epoch, from their numbers alone."""
    docs = with_source_position(table(spark, folder, "documents").select("doc_id", "text"), "pos")
    rows = keyed.batch_rows(spark, docs.count(), RANKS, BATCH, SEED, EPOCH, first_batch=DONE)
    return rows.join(docs, "pos").select(*[F.col(c).cast("bigint").alias(c) for c in ("rank", "batch", "idx")], "doc_id", "text")


BATCH_LIST = f"{BATCHED}, batches as (select distinct rank, batch from batched)"


def batch_list(spark: SparkSession, folder: str) -> DataFrame:
    return rank_batches(spark, folder).select("rank", "batch", "batches_per_rank").distinct()


@query("repeat_epochs", f"with {BATCH_LIST} select rank, batch, epoch from batches, range(3) as e(epoch)")
def repeat_epochs(spark: SparkSession, folder: str) -> DataFrame:
    return as_bigint(sp.repeat_epochs(batch_list(spark, folder), 3).drop("batches_per_rank"))


@query(
    "resume_batches",
    f"""with {BATCH_LIST} select rank, batch, epoch from batches, range(3) as e(epoch)
        where epoch > 1 or (epoch = 1 and batch >= 10 % 8)""",
)
def resume_batches(spark: SparkSession, folder: str) -> DataFrame:
    epochs = sp.repeat_epochs(batch_list(spark, folder), 3).drop("batches_per_rank")
    return as_bigint(sp.resume(epochs, 1, 10, 8))


@query(
    "epoch_plan",
    f"""with {BATCH_LIST}, per_epoch as (select max(batch) + 1 as b from batches),
    steps as (
      select rank, batch, epoch, row_number() over (partition by rank order by epoch, batch) as step
      from batches, range(3) as e(epoch))
    select epoch, rank, batch, step, step % 3 = 0 as is_sync, step // 3 as update_id from steps, per_epoch
    where (step - 1) // 3 < least(greatest(b // 3, 1), 2) * 3""",
)
def epoch_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan = sp.epoch_plan(batch_list(spark, folder), 3, 3, max_training_steps=2)
    return plan.select(
        F.col("epoch").cast("bigint").alias("epoch"),
        F.col("rank").cast("bigint").alias("rank"),
        "batch",
        "step",
        "is_sync",
        F.col("update_id").cast("bigint").alias("update_id"),
    )
