from pyspark.sql import functions as F

from lexloom.functions.text import clean_text
from lexloom.operators.bpe_encoding import encode
from lexloom.operators.position import with_source_position
from lexloom.operators.relational import assign_batches
from lexloom.operators.tokenizer import TRAINED_SPECIALS, Tokenizer
from lexloom.operators import packing, sampling
from lexloom.plans import corpus
from lexloom.plans.packing_queries import joined, listed
from lexloom import session
from lexloom.session import write_and_read, write_bucketed


def char_tokenizer():
    letters = [chr(c) for c in range(33, 127) if not chr(c).isupper()]
    return Tokenizer((*TRAINED_SPECIALS, "▁", *letters), frozenset(TRAINED_SPECIALS), ()).with_specials()


def test_corpus_and_batches(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    settings = corpus.CorpusSettings(seq_length=256, shards=2, batch_size=30, max_documents=100)
    rows = corpus.prepare_corpus(docs, "doc_id", char_tokenizer(), settings=settings)
    n = rows.count()
    assert rows.filter(F.size("input_ids") != 256).count() == 0
    assert rows.agg(F.min("row_id"), F.countDistinct("row_id")).first() == (0, n)
    batches = corpus.training_batches(rows, ranks=3, batch_size=4, epochs=2, mega_size=20).collect()
    per_rank = n // 3 if n % 3 == 0 else -(-(n - 3) // 3)
    assert len(batches) == 2 * 3 * (per_rank // 4)
    assert all(len(b.input_ids) == len(b.labels) == 4 for b in batches)
    first = {(b.rank, b.batch): b.input_ids for b in batches if b.epoch == 0}
    second = {(b.rank, b.batch): b.input_ids for b in batches if b.epoch == 1}
    assert first.keys() == second.keys() and first != second
    same = corpus.training_batches(rows, ranks=3, batch_size=4, epochs=2, mega_size=20, reseed=False)
    assert same.count() == len(batches)


def test_plain_chunks_and_unpacked(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 40")
    chunks = corpus.plain_chunks(docs, "doc_id", char_tokenizer(), length=100)
    assert chunks.filter(F.size("input_ids") != 100).count() == 0
    settings = corpus.CorpusSettings(seq_length=300, pack=False)
    unpacked = corpus.prepare_corpus(docs, "doc_id", char_tokenizer(), settings=settings)
    assert unpacked.filter(F.size("input_ids") < 300).count() == 0


def test_partial_batches_can_be_dropped(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    settings = corpus.CorpusSettings(shards=3, batch_size=30, drop_partial_batches=True)
    assert corpus.clean_documents(docs, "doc_id", settings=settings).count() == 3 * 60


def test_rows_without_a_key_are_encoded_where_they_stand(spark, small):
    turns = with_source_position(spark.read.parquet(f"{small}/conversations.parquet").select("text"))
    cleaned = turns.withColumn("text", clean_text(F.col("text")))
    plan = encode(cleaned, "row_no", "text", char_tokenizer(), ascii_only=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") and "Sort" not in plan
    batched = assign_batches(turns, None, 4, 60, pos="row_no")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in batched.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert not any("text" in line or "hashpartitioning" in line for line in moved)


def test_bucketed_rows_are_moved_once(spark):
    rows = spark.range(4000).select("id", F.array_repeat(F.col("id"), 300).alias("ids"))
    bucketed = write_bucketed(rows, "id", 8, "bucketed")
    assigned = sampling.assign_rank_batches(sampling.plain_sampler(bucketed.select("id"), "id", 3), 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = sampling.collate(assigned, bucketed, "id", ["ids"])
        plan = made._jdf.queryExecution().sparkPlan().toString()
        physical = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan
    # The rows' side of the join is the bare scan; the one exchange of rows is that by batch.
    assert "SelectedBucketsCount: 8 out of 8" in physical
    lines = physical.splitlines()
    scan = max(i for i, line in enumerate(lines) if "FileScan" in line and "ids" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    path, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            path.append(line)
            level = depth(line)
    assert sum("Exchange" in line for line in path) == 1
    assert made.count() == 4000 // 3 // 16 * 3


def test_ids_are_listed_as_they_are_joined(spark):
    df = spark.createDataFrame([([0, -5, 123456],), ([],), (None,), ([7],)], "a array<int>")
    rows = df.select(listed("a").alias("listed"), joined("a").alias("joined")).collect()
    assert [r.listed for r in rows] == [r.joined for r in rows] == ["0,-5,123456", "", None, "7"]


def test_ids_move_as_two_bytes_and_without_their_labels(spark):
    rows = spark.range(60).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("int"), F.lit(3)).alias("input_ids"))
    made = corpus.training_batches(rows, ranks=2, batch_size=4, epochs=2, mega_size=10, label_pad=3)
    assert made.schema["input_ids"].dataType.simpleString() == "array<array<int>>"
    batches = made.collect()
    assert len(batches) == 2 * 2 * 7
    assert all(b.labels == [[i, -100] if i != 3 else [-100, -100] for i, _ in b.input_ids] for b in batches)
    gathered = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list(" in line]
    assert gathered and not any("labels" in line.split("collect_list(")[1].split("AS __rows")[0] for line in gathered)
    assert sampling.narrowed(rows, ["input_ids"]).schema["input_ids"].dataType.simpleString() == "array<smallint>"
    large = rows.withColumn("input_ids", F.transform("input_ids", lambda i: i + 40_000))
    assert sampling.narrowed(large, ["input_ids"]).schema == large.schema
    again = corpus.training_batches(large, ranks=2, batch_size=4, epochs=2, mega_size=10)
    assert sorted(i for b in again.collect() for i, _ in b.input_ids) == sorted(i + 40_000 for b in batches for i, _ in b.input_ids)


def test_written_stages_leave_no_shuffle_and_no_encoded_stage(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    shuffles = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before = set(str(shuffles.keySet().mkString(",")).split(","))
    rows = corpus.prepare_corpus(docs, "doc_id", char_tokenizer(), settings=corpus.CorpusSettings(shards=2, batch_size=30))
    assert rows.count()
    moved = set(str(shuffles.keySet().mkString(",")).split(",")) - before
    assert len(moved) <= 6  # of the counts; the writes had more than ten
    kept = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert "packed" in kept and not kept & {"encoded", "batched"}
    session.drop_read(rows)
    assert "packed" not in {p.name.split("-")[0] for p in tmp_path.iterdir()}


def test_packing_by_place_equals_packing_by_key(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.col("id") % 23), lambda i: i.cast("int")).alias("ids"))
    batched = write_and_read(assign_batches(rows.withColumn("n", F.size("ids")), "k", 2, 30), "rows")
    fill = {"ids": (-1, -2)}
    plain = packing.balanced_pack(batched, "k", fill, 16, size="n")
    narrow = batched.drop("ids").withColumn("at", F.col("k") * 7)
    by_place = packing.balanced_pack(narrow, "k", fill, 16, size="n", arrays=(rows.select((F.col("k") * 7).alias("at"), "ids"), "at"))
    columns = ["batch_id", "row_no", "ids"]
    assert sorted(plain.select(columns).collect()) == sorted(by_place.select(columns).collect())
