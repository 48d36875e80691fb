"""Cutting, packing and padding, as checkable queries.

Arrays are compared as joined text.  Both engines make the same integer ids from
the words of the cleaned text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.arrays import pad_structure
from lexloom.functions.text import clean_text
from lexloom.operators import packing
from lexloom.operators.relational import assign_batches
from lexloom.plans import sql
from lexloom.plans.registry import query, spread, table
from lexloom.session import write_and_read

LENGTH, THRESHOLD, EOS, PAD = 512, 10, 2, 3
SHARDS, BATCH = 4, 60


def word_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``ids``: a number for each word of the cleaned text."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    words = F.filter(F.split(clean_text(F.col("text")), " "), lambda w: w != "")
    ids = F.transform(words, lambda w: ((F.ascii(w) * 131 + F.length(w) * 17) % 997 + 5).cast("int"))
    return docs.select("doc_id", ids.alias("ids"))


def stored_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids as a stage, with their number: totals are then read without the ids."""
    return write_and_read(word_ids(spark, folder).withColumn("n", F.size("ids")), "ids")


def batched_ids(spark: SparkSession, folder: str) -> DataFrame:
    return assign_batches(word_ids(spark, folder), "doc_id", SHARDS, BATCH)


def joined(ids: str | Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def listed(ids: str) -> Column:
    """``joined`` for whole numbers without nulls, several times as fast: as JSON, without its brackets."""
    return F.btrim(F.to_json(ids), F.lit("[]"))


def sizes(ids: str) -> Column:
    return F.size(ids).cast("bigint")


@query(
    "chunk_corpus",
    f"""with {sql.TOKENS},
    placed as (select id, row_number() over (order by doc_id, i) - 1 as pos from tokens)
    select pos // {LENGTH} as row_no, string_agg(id, ',' order by pos) as ids
    from placed group by pos // {LENGTH} having count(*) = {LENGTH}""",
)
def chunk_corpus(spark: SparkSession, folder: str) -> DataFrame:
    docs = stored_ids(spark, folder)
    rows = packing.chunk(docs, "doc_id", ["ids"], LENGTH, size="n")
    return rows.select("row_no", joined("ids").alias("ids"))


@query(
    "chunk_several_columns",
    f"""with {sql.TOKENS},
    placed as (select id, i, row_number() over (order by doc_id, i) - 1 as pos from tokens)
    select pos // {LENGTH} as row_no, string_agg(id, ',' order by pos) as ids,
           string_agg(i, ',' order by pos) as places
    from placed group by pos // {LENGTH} having count(*) = {LENGTH}""",
)
def chunk_several_columns(spark: SparkSession, folder: str) -> DataFrame:
    docs = stored_ids(spark, folder).withColumn("places", F.transform("ids", lambda _, i: i))
    rows = packing.chunk(docs, "doc_id", ["ids", "places"], LENGTH, size="n")
    return rows.select("row_no", joined("ids").alias("ids"), joined("places").alias("places"))


def constant_ctes(source: str, key: str, length: int = LENGTH, eos: str = str(EOS), pad: str = str(PAD)) -> str:
    """``packed``: the rows of each batch of ``source``, which has ``key`` and ``ids``, in ``key`` order."""
    return f"""{sql.batches(source, key, SHARDS, BATCH)},
flagged as (
  select *, abs(len(ids) - {length}) <= {THRESHOLD} as alone,
         count(*) filter (where abs(len(ids) - {length}) <= {THRESHOLD}) over (partition by batch_id) as n_alone
  from batched),
alone_rows as (
  select batch_id, row_number() over (partition by batch_id order by {key}) - 1 as row_no,
         list_concat(ids, list_transform(range(greatest({length} - len(ids), 0)), lambda x: {pad})) as ids,
         list_concat(list_transform(ids, lambda x: 1),
                     list_transform(range(greatest({length} - len(ids), 0)), lambda x: 0)) as mask
  from flagged where alone),
stream as (
  select batch_id, n_alone, {key}, unnest(list_append(ids, {eos})) as id,
         unnest(range(len(ids) + 1)) as i from flagged where not alone),
placed as (
  select *, row_number() over (partition by batch_id order by {key}, i) - 1 as pos from stream),
cut as (
  select batch_id, n_alone + pos // {length} as row_no, list(id order by pos) as ids
  from placed group by batch_id, n_alone, pos // {length}),
cut_rows as (
  select batch_id, row_no,
         list_concat(ids, list_transform(range({length} - len(ids)), lambda x: {pad})) as ids,
         list_concat(list_transform(ids, lambda x: 1), list_transform(range({length} - len(ids)), lambda x: 0)) as mask
  from cut),
packed as (select * from alone_rows union all select * from cut_rows)
"""


CONSTANT_SQL = f"with {sql.IDS},\n{constant_ctes('ids', 'doc_id')}"


def constant_rows(spark: SparkSession, folder: str, **options) -> DataFrame:
    docs = batched_ids(spark, folder).withColumn("attention_mask", F.transform("ids", lambda _: F.lit(1)))
    fill = packing.fill_values(["ids", "attention_mask"], EOS, PAD, mask_compat=options.pop("mask_compat", False))
    return packing.constant_length_pack(docs, "doc_id", fill, LENGTH, THRESHOLD, **options)


@query(
    "constant_length_pack",
    CONSTANT_SQL + "select batch_id, row_no, array_to_string(ids, ',') as ids, array_to_string(mask, ',') as mask from packed",
)
def constant_length_pack(spark: SparkSession, folder: str) -> DataFrame:
    rows = constant_rows(spark, folder)
    return rows.select("batch_id", "row_no", joined("ids").alias("ids"), joined("attention_mask").alias("mask"))


@query(
    "constant_length_pack_truncated",
    CONSTANT_SQL + f"select batch_id, row_no, array_to_string(ids[1:{LENGTH}], ',') as ids from packed",
)
def constant_length_pack_truncated(spark: SparkSession, folder: str) -> DataFrame:
    rows = constant_rows(spark, folder, truncate_overlong=True)
    return rows.select("batch_id", "row_no", joined("ids").alias("ids"))


def synthetic_bins(df: DataFrame) -> DataFrame:
    """Bins by a simple rule that SQL can follow too."""
    return df.select(
        "batch_id",
        "doc_id",
        (F.col("pos_in_batch") % 7).alias("bin"),
        F.floor(F.col("pos_in_batch") / 7).cast("int").alias("pos_in_bin"),
    )


@query(
    "pack_given_bins",
    f"""with {sql.IDS},
{sql.batches('ids', 'doc_id', SHARDS, BATCH)},
stream as (
  select batch_id, pos_in_batch % 7 as bin, pos_in_batch // 7 as pos_in_bin,
         unnest(list_append(ids, {EOS})) as id, unnest(range(len(ids) + 1)) as i from batched),
placed as (
  select *, row_number() over (partition by batch_id, bin order by pos_in_bin, i) - 1 as pos from stream),
cut as (
  select batch_id, bin, pos // {LENGTH} as r, list(id order by pos) as ids from placed group by batch_id, bin, r)
select batch_id, row_number() over (partition by batch_id order by bin, r) - 1 as row_no,
       array_to_string(list_concat(ids, list_transform(range({LENGTH} - len(ids)), lambda x: {PAD})), ',') as ids
from cut""",
)
def pack_given_bins(spark: SparkSession, folder: str) -> DataFrame:
    docs = batched_ids(spark, folder)
    rows = packing.pack_bins(docs, synthetic_bins(docs), "doc_id", {"ids": (EOS, PAD)}, LENGTH)
    return rows.select("batch_id", "row_no", joined("ids").alias("ids"))


@query(
    "pack_given_bins_masks",
    f"""with {sql.IDS},
{sql.batches('ids', 'doc_id', SHARDS, BATCH)},
stream as (
  select batch_id, pos_in_batch % 7 as bin, pos_in_batch // 7 as pos_in_bin, unnest(list_append(ids, {EOS})) as id,
         unnest(list_append(list_transform(ids, lambda x: 1), {EOS})) as compat, unnest(range(len(ids) + 1)) as i from batched),
placed as (
  select *, row_number() over (partition by batch_id, bin order by pos_in_bin, i) - 1 as pos from stream),
cut as (
  select batch_id, bin, pos // {LENGTH} as r, list(id order by pos) as ids, list(compat order by pos) as compat
  from placed group by batch_id, bin, r),
padded as (select *, list_transform(range({LENGTH} - len(ids)), lambda x: {PAD}) as pad from cut)
select batch_id, row_number() over (partition by batch_id order by bin, r) - 1 as row_no,
  array_to_string(list_concat(ids, pad), ',') as ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(pad, lambda x: 0)), ',') as mask,
  array_to_string(list_concat(compat, pad), ',') as compat
from padded""",
)
def pack_given_bins_masks(spark: SparkSession, folder: str) -> DataFrame:
    """The mask beside the ids, and the mask that is packed with the values of the ids."""
    docs = batched_ids(spark, folder).withColumn("attention_mask", F.transform("ids", lambda _: F.lit(1)))
    docs = docs.withColumn("compat", F.col("attention_mask"))
    fill = packing.fill_values(["ids", "attention_mask"], EOS, PAD) | packing.fill_values(["compat"], EOS, PAD, "compat", mask_compat=True)
    rows = packing.pack_bins(docs, synthetic_bins(docs), "doc_id", fill, LENGTH)
    return rows.select(
        "batch_id", "row_no", joined("ids").alias("ids"), joined("attention_mask").alias("mask"), joined("compat").alias("compat")
    )


# The greedy step as a recursion over the sorted documents of each batch.  Bins of
# equal total are left out of the order, which there follows the heap.
BINS_CTES = f"""with recursive {sql.IDS},
{sql.batches('ids', 'doc_id', SHARDS, BATCH)},
loads as (select batch_id, doc_id, pos_in_batch as idx, len(ids) as n, len(ids) % {LENGTH} as load from batched),
ranked as (
  select *, row_number() over (partition by batch_id order by load desc, idx) as step,
         count(*) over (partition by batch_id) as steps from loads),
greedy as (
  select batch_id, steps, 0::bigint as step, []::struct(s bigint, m bigint[])[] as bins
  from (select distinct batch_id, steps from ranked)
  union all
  select g.batch_id, g.steps, g.step + 1,
         list_sort(case when len(g.bins) > 0 and g.bins[1].s + r.load <= {LENGTH}
           then list_append(g.bins[2:], struct_pack(s := g.bins[1].s + r.load, m := list_append(g.bins[1].m, r.idx)))
           else list_append(g.bins, struct_pack(s := r.load, m := [r.idx])) end)
  from greedy g join ranked r on r.batch_id = g.batch_id and r.step = g.step + 1),
bins as (select batch_id, unnest(bins) as b from greedy where step = steps)"""
BINS_SQL = f"""{BINS_CTES},
members as (select batch_id, b.m as members, unnest(b.m) as idx from bins)
select m.batch_id, array_to_string(m.members, ',') as members, sum(l.n)::bigint as total
from members m join loads l on l.batch_id = m.batch_id and l.idx = m.idx group by m.batch_id, m.members"""


def balanced(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = write_and_read(batched_ids(spark, folder), "ids").withColumn("n", F.size("ids"))
    return docs, packing.assign_bins(docs, "doc_id", "n", LENGTH)


@query("length_balanced_bins", BINS_SQL)
def length_balanced_bins(spark: SparkSession, folder: str) -> DataFrame:
    docs, bins = balanced(spark, folder)
    placed = bins.join(docs.select("batch_id", "doc_id", "pos_in_batch", "n"), ["batch_id", "doc_id"])
    listed = F.sort_array(F.collect_list(F.struct("pos_in_bin", "pos_in_batch")))
    members = placed.groupBy("batch_id", "bin").agg(listed.alias("l"), F.sum("n").alias("total"))
    return members.select("batch_id", joined("l.pos_in_batch").alias("members"), "total")


@query(
    "length_balanced_pack_totals",
    f"""with {sql.IDS},
{sql.batches('ids', 'doc_id', SHARDS, BATCH)}
select batch_id, sum(len(ids) + 1)::bigint as n_tokens, sum(list_sum(ids) + {EOS})::bigint as id_sum
from batched group by batch_id""",
)
def length_balanced_pack_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Every token once, and one end mark per document, whatever the bins."""
    docs, bins = balanced(spark, folder)
    rows = packing.pack_bins(docs, bins, "doc_id", {"ids": (EOS, -1)}, LENGTH)
    kept = F.filter("ids", lambda i: i != -1)
    total = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, i: a + i)
    return rows.groupBy("batch_id").agg(F.sum(sizes(kept)).alias("n_tokens"), F.sum(total).alias("id_sum"))


@query("length_balanced_pack")
def length_balanced_pack(spark: SparkSession, folder: str) -> DataFrame:
    docs = write_and_read(batched_ids(spark, folder), "ids")
    rows = packing.balanced_pack(docs, "doc_id", {"ids": (EOS, PAD)}, LENGTH)
    return rows.select("batch_id", "row_no", joined("ids").alias("ids"))


@query(
    "length_balanced_pack_rows",
    f"""{BINS_CTES},
numbered as (select batch_id, row_number() over () as bin, b.m as m from bins),
placed_docs as (select batch_id, bin, unnest(m) as idx, unnest(range(len(m))) as pos_in_bin from numbered),
stream as (
  select p.batch_id, bin, pos_in_bin, unnest(list_append(ids, {EOS})) as id, unnest(range(len(ids) + 1)) as i
  from placed_docs p join batched b on b.batch_id = p.batch_id and b.pos_in_batch = p.idx),
placed as (
  select *, row_number() over (partition by batch_id, bin order by pos_in_bin, i) - 1 as pos from stream),
cut as (
  select batch_id, bin, pos // {LENGTH} as r, list(id order by pos) as ids from placed group by batch_id, bin, r),
padded as (select *, list_transform(range({LENGTH} - len(ids)), lambda x: {PAD}) as pad from cut)
select batch_id, array_to_string(list_concat(ids, pad), ',') as ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(pad, lambda x: 0)), ',') as mask
from padded""",
)
def length_balanced_pack_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The packed rows with their mask, whatever the order of bins with equal totals."""
    docs = batched_ids(spark, folder).withColumn("attention_mask", F.transform("ids", lambda _: F.lit(1)))
    fill = packing.fill_values(["ids", "attention_mask"], EOS, PAD)
    rows = packing.balanced_pack(write_and_read(docs, "ids"), "doc_id", fill, LENGTH)
    return rows.select("batch_id", joined("ids").alias("ids"), joined("attention_mask").alias("mask"))


@query(
    "pad_to_length",
    f"""with {sql.IDS}
    select doc_id, array_to_string(list_concat(ids, list_transform(range(greatest(300 - len(ids), 0)), lambda x: 0)), ',')
      as ids from ids""",
)
def pad_to_length(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.pad_batches(word_ids(spark, folder), "ids", 300)
    return rows.select("doc_id", joined("ids").alias("ids"))


@query(
    "pad_to_batch_longest",
    f"""with {sql.IDS},
{sql.batches('ids', 'doc_id', SHARDS, BATCH)},
longest as (select *, max(len(ids)) over (partition by batch_id) as m from batched)
select doc_id, len(ids)::bigint as n, m::bigint as padded, md5(array_to_string(
    list_concat(ids, list_transform(range(m - len(ids)), lambda x: {PAD})), ',')) as ids from longest""",
)
def pad_to_batch_longest(spark: SparkSession, folder: str) -> DataFrame:
    docs = batched_ids(spark, folder).withColumn("n", sizes("ids"))
    rows = packing.pad_batches(docs, "ids", None, PAD)
    return rows.select("doc_id", "n", sizes("ids").alias("padded"), F.md5(joined("ids")).alias("ids"))


@query(
    "pad_nested",
    """with cut as (
      select doc_id, list_transform(string_split(text, chr(10)), lambda x: list_transform(
        string_split(x, ' '), lambda w: length(w)::integer)) as l from documents),
    m as (select doc_id, l, list_max(list_transform(l, lambda r: len(r))) as m from cut)
    select doc_id,
      array_to_string(list_transform(l, lambda r: array_to_string(
        list_concat(r, list_transform(range(m - len(r)), lambda x: -1)), ',')), '|') as rows from m""",
)
def pad_nested(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lengths = F.transform(
        F.split("text", "\n"), lambda x: F.transform(F.split(x, " "), lambda w: F.length(w))
    )
    nested = docs.select("doc_id", F.struct(F.struct(lengths.alias("rows")).alias("inner")).alias("value"))
    padded = nested.withColumn("value", pad_structure(nested, "value", None, -1))
    rows = F.transform("value.inner.rows", lambda r: joined(r))
    return padded.select("doc_id", F.array_join(rows, "|").alias("rows"))


@query(
    "causal_labels",
    f"""with {sql.IDS}, padded as (
      select doc_id, list_concat(ids, list_transform(range(greatest(100 - len(ids), 0)), lambda x: {PAD})) as ids from ids)
    select doc_id, array_to_string(ids, ',') as labels,
      array_to_string(list_transform(ids, lambda x: case when x = {PAD} then -100 else x end), ',') as masked_labels
    from padded""",
)
def causal_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.pad_batches(word_ids(spark, folder), "ids", 100, PAD)
    plain = packing.causal_labels(rows, "ids").withColumnRenamed("labels", "plain")
    masked = packing.causal_labels(plain, "ids", pad=PAD)
    return masked.select("doc_id", joined("plain").alias("labels"), joined("labels").alias("masked_labels"))
