"""Token files against the library, and the pipeline's stages on a small table."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import token_files
from lexloom.session import new_stage_path, write_and_read

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " ", "a  b", " lead and trail ", "line\nnext \n x\ty", "don't stop... (well), 'tis", "x" * 5000, "naïve 😀 text\u00a0here\u2003there", "<|endoftext|> a<|endoftext|> b", "word, word; word"]


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a  b"), (None, "no key")]
    frame = write_and_read(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), "test-texts")
    manifest = token_files.write_token_files(frame, "doc_id", "text", new_stage_path(spark, "test-tokens"), path)
    digests = {(r["start"]): r for r in token_files.document_digests(manifest).collect()}
    model, start = tokenizers.Tokenizer.from_file(path), 0
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        r = digests[start]
        assert (r["doc_id"], r["n_tokens"], r["ids_crc32"]) == (key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = sum((r["ids"] for r in sorted(token_files.read_documents(manifest).collect(), key=lambda r: r["start"])), [])
    assert len(whole) == start
    empty = token_files.write_token_files(frame.limit(0), "doc_id", "text", new_stage_path(spark, "test-tokens"), path)
    assert token_files.document_digests(empty).count() == 0


def test_stages_keep_columns_and_clean_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = write_and_read(stage(spark, docs, small), "test-stage")
        sizes.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0.5 * sizes[0] and sizes[4] == sizes[5]


def test_stages_on_nulls_ties_repeated_rows_and_nothing(spark, small):
    prose = [" ".join(f"w{(i * 37 + j * j) % 911}" for j in range(80 + i)) for i in range(4)]
    rows = [(1, prose[0], "a", 5), (1, prose[0], "a", 5), (None, prose[1], None, None), (2, None, "b", 1), (3, "", None, 1), (None, prose[2], "b", 2), (4, prose[3], None, 3)]
    schema = "doc_id bigint, text string, source string, copies int"
    docs = write_and_read(spark.createDataFrame(rows, schema).withColumn("__row", F.lit("x")).withColumn("quality", F.lit(0)), "test-edge")
    for frame, counts in ((docs, (5, 4, 4)), (write_and_read(docs.limit(0), "test-edge"), (0, 0, 0))):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            columns = frame.columns
            frame = write_and_read(stage(spark, frame, small), "test-edge")
            if i < 3:
                assert frame.count() == counts[i], name
            if i < 4:
                assert frame.columns == columns and frame.filter("__row <> 'x' OR quality <> 0").isEmpty()
        assert frame.filter("shard NOT BETWEEN 0 AND 15").isEmpty() and frame.isEmpty() == (counts[0] == 0)
