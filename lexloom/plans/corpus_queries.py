"""The composed plans, as checkable queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import clean_text
from lexloom.operators import packing
from lexloom.operators.bpe_encoding import encode
from lexloom.operators.position import with_source_position
from lexloom.operators.relational import assign_batches
from lexloom.operators.sampling import split_train_eval
from lexloom.operators.tokenizer import EOS, PAD, TRAINED_SPECIALS
from lexloom.plans import corpus
from lexloom.plans.packing_queries import BATCH, SHARDS, THRESHOLD, constant_ctes, joined, listed
from lexloom.plans import sql
from lexloom.plans.registry import query, spread, table
from lexloom.plans.tokenizer_queries import ENCODED_SQL, TRAINED_SQL, WORD_RE, marked, trained, trained_sql
from lexloom.session import drop_read, write_and_read

SETTINGS = corpus.CorpusSettings(seq_length=512, shards=4, batch_size=60)


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return corpus.prepare_corpus(docs, "doc_id", trained(spark, folder), settings=SETTINGS)


@query(
    "prepared_corpus_totals",
    TRAINED_SQL.rstrip() + ",\n" + ENCODED_SQL
    + f"""select (select sum(len(ids)) from encoded)::bigint + (select count(*) from documents) as n_tokens,
      (select sum(list_sum(ids)) from encoded)::bigint
        + (select count(*) from documents) * (select id from vocab where token = '{EOS}') as id_sum""",
)
def prepared_corpus_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Clean, encode, balance, pack: every token once and an end mark per document."""
    # Places and ids stream by: a function on the whole arrays would make an object of each pair.
    placed = prepared(spark, folder).select("attention_mask", F.posexplode("input_ids").alias("at", "id"))
    kept = placed.filter(F.get("attention_mask", "at") == 1)
    return kept.agg(F.sum(F.lit(1)).alias("n_tokens"), F.sum("id").alias("id_sum"))


@query("prepared_training_batches")
def prepared_training_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Two epochs for four ranks out of the training part of the prepared corpus."""
    rows = prepared(spark, folder)
    split = split_train_eval(rows, "row_id", 0.05, 32, seed=7)
    train = write_and_read(split.filter(F.col("split") == "train").drop("split"), "train")
    drop_read(rows)
    batches = corpus.training_batches(train, ranks=4, batch_size=8, epochs=2, seed=7, mega_size=50)
    return batches.select(
        "epoch", "rank", "batch", F.array_join(F.transform("input_ids", lambda r: joined(r)), "|").alias("rows")
    )


TURN_LENGTH = 512
# Words of the turns take part in the replay of the merges with a count of 0.
TURN_WORDS = f"""turns as materialized (
  select row_no, regexp_extract_all({marked('t')}, {WORD_RE}) as ws
  from (select row_number() over () - 1 as row_no, {sql.clean('text')} as t from conversations)),"""


@query(
    "conversation_pack",
    trained_sql(TURN_WORDS, "select unnest(ws) as word from turns").rstrip()
    + f""",
places as (select row_no, unnest(ws) as word, unnest(range(len(ws))) as i from turns),
turn_ids as (
  select t.row_no, coalesce(e.ids, []) as ids from turns t left join (
    select p.row_no, flatten(list(w.ids order by p.i)) as ids from places p join word_ids w using (word) group by p.row_no) e
  using (row_no)),
{constant_ctes('turn_ids', 'row_no', TURN_LENGTH, f"(select id from vocab where token = '{EOS}')", str(TRAINED_SPECIALS.index(PAD)))}
select batch_id, row_no, array_to_string(ids, ',') as ids, array_to_string(mask, ',') as mask from packed""",
)
def conversation_pack(spark: SparkSession, folder: str) -> DataFrame:
    """A table without a unique key: cleaned, encoded and packed in the order of its files."""
    tok = trained(spark, folder)
    turns = with_source_position(table(spark, folder, "conversations").select("text"))
    turns = spread(turns).withColumn("text", clean_text(F.col("text")))
    encoded = encode(turns, "row_no", "text", tok, ascii_only=True).select("row_no", "input_ids", "attention_mask")
    batched = assign_batches(write_and_read(encoded, "encoded"), None, SHARDS, BATCH, pos="row_no")
    fill = packing.fill_values(["input_ids", "attention_mask"], tok.id_of(EOS), tok.id_of(PAD))
    rows = packing.constant_length_pack(batched.withColumnRenamed("row_no", "turn"), "turn", fill, TURN_LENGTH, THRESHOLD)
    return rows.select("batch_id", "row_no", listed("input_ids").alias("ids"), listed("attention_mask").alias("mask"))


RAW_WORDS = f"""raw as materialized (
  select doc_id, regexp_extract_all({marked('t')}, {WORD_RE}) as ws from (select doc_id, lower(text) as t from documents)),"""


@query(
    "plain_chunks",
    trained_sql(RAW_WORDS, "select unnest(ws) as word from raw").rstrip()
    + f""",
places as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from raw),
tokens as (
  select unnest(w.ids) as id, p.doc_id, p.i, unnest(range(len(w.ids))) as j from places p join word_ids w using (word)),
placed as (select id, row_number() over (order by doc_id, i, j) - 1 as pos from tokens)
select pos // {TURN_LENGTH} as row_no, string_agg(id, ',' order by pos) as ids
from placed group by pos // {TURN_LENGTH} having count(*) = {TURN_LENGTH}""",
)
def plain_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The plain variant: texts as they are, encoded, concatenated and cut."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    rows = corpus.plain_chunks(docs, "doc_id", trained(spark, folder), length=TURN_LENGTH)
    return rows.select("row_no", listed("input_ids").alias("ids"))
