import random
import time
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lexloom.functions.text import clean_text
from lexloom.operators import bpe_encoding as enc
from lexloom.operators import bpe_training as bpe
from lexloom.operators import tokenizer as tk
from lexloom.plans import all_queries
from lexloom.plans.registry import ORACLES, QUERIES
from lexloom.session import new_stage_path
from lexloom.sources import stages

all_queries()


def words_of(spark, texts):
    return tk.count_words(spark.createDataFrame([(t,) for t in texts], "text string"), "text", True)


def test_split_words(spark):
    df = spark.createDataFrame([("hello, [number] wor'ld!! x-1  a",), ("",)], "t string")
    first, empty = [r[0] for r in df.select(tk.split_words(F.col("t"))).collect()]
    assert first == "▁hello , ▁ [ number ] ▁wor ' ld ! ! ▁x - 1 ▁ ▁a".split(" ")
    assert empty == []


@pytest.mark.parametrize(
    "texts, merges",
    [
        (
            ["ba dc ca"] * 3,
            [("b", "a"), ("c", "a"), ("d", "c"), ("▁", "ba"), ("▁", "ca"), ("▁", "dc")],
        ),
        (["aaaa aaaa aaaaa"] * 2, [("a", "a"), ("▁", "aa"), ("▁aa", "aa"), ("▁aaaa", "a")]),
    ],
)
@pytest.mark.parametrize("batched", [True, False])
def test_small_trainings(spark, texts, merges, batched):
    tok = bpe.train_bpe(words_of(spark, texts), 100, 2, specials=("[UNK]",), batched=batched)
    assert list(tok.merges) == merges


def brute_force_log(words, merges):
    """Change of every pair count by each merge, over plain lists of codes."""

    def count(words):
        pairs = Counter()
        for codes, n in words:
            for pair in zip(codes, codes[1:]):
                pairs[pair] += n
        return pairs

    log = []
    for left, right, code in merges:
        after = []
        for codes, n in words:
            out = []
            for c in codes:
                if out and (out[-1], c) == (left, right):
                    out[-1] = code
                else:
                    out.append(c)
            after.append((out, n))
        one, two = count(words), count(after)
        log.append({p: two[p] - one[p] for p in one | two if two[p] != one[p]})
        words = after
    return log, words


def test_merging_reports_every_changed_count():
    rng = random.Random(4)
    words = [([rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(1, 12))], rng.randint(1, 9)) for _ in range(300)]
    merges = [(1, 1, 10), (10, 2, 11), (10, 10, 12), (3, 1, 13), (2, 3, 14), (7, 7, 15)]
    expected, after = brute_force_log(words, merges)
    batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.list_(pa.int32())), pa.array([n for _, n in words])], names=["symbols", "cnt"])
    log = [{} for _ in merges]
    for part in bpe.change_log([], merges)(iter([batch])):
        for row in part.to_pylist():
            log[row["step"]][row["left"], row["right"]] = row["change"]
    assert log == expected
    rewritten = [r for part in bpe.rewriter(merges)(iter([batch])) for r in part.to_pylist()]
    assert [(r["symbols"], r["cnt"]) for r in rewritten] == after


def test_known_pairs_are_sure_of_the_first_only():
    known = bpe.KnownPairs([(1, 2, 9), (3, 4, 7), (5, 6, 7)], limit=3, least=2)
    assert known.best() == (-9, 1, 2)
    assert known.leading(2) == [(-9, 1, 2), (-7, 3, 4)] and known.best() == (-9, 1, 2)
    known.change([(1, 2, -9), (3, 4, -1), (8, 20, 7), (20, 1, 8), (20, 2, 1), (4, 1, 50)], 20, lambda a, b: True)
    # (3, 4) fell behind the last known pair, (8, 20) comes behind it, (4, 1) was not known before.
    assert known.count == {(5, 6): 7, (20, 1): 8} and known.best() == (-8, 20, 1)
    known.change([(20, 1, -8), (5, 6, -1)], 21, lambda a, b: True)
    assert known.best() is None


def test_result_does_not_depend_on_what_the_driver_holds(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").select(clean_text(F.col("text")).alias("text"))
    words = tk.count_words(texts, "text", True).persist()
    one = bpe.train_bpe(words, 180, 4)
    assert one == bpe.train_bpe(words, 180, 4, known_pairs=25, guess_words=40, merges_per_base=11)
    assert len(one) == 180


@pytest.fixture(scope="module")
def cleaned(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return docs.select("doc_id", clean_text(F.col("text")).alias("text")).persist()


@pytest.fixture(scope="module")
def trained(spark, cleaned):
    before = jobs_so_far(spark)
    tok = bpe.train_bpe(tk.count_words(cleaned, "text", True), 1000, 2, max_token_length=8)
    assert jobs_so_far(spark) - before < 0.5 * len(tok.merges)
    return tok


def jobs_so_far(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


@pytest.fixture(scope="module")
def public(cleaned):
    """The same training by the public library, on every text of the small table."""
    lib = pytest.importorskip("tokenizers")
    tok = lib.Tokenizer(lib.models.BPE(unk_token=tk.UNK))
    tok.pre_tokenizer = lib.pre_tokenizers.Sequence(
        [lib.pre_tokenizers.Metaspace(), lib.pre_tokenizers.Punctuation()]
    )
    tok.decoder = lib.decoders.Metaspace()
    trainer = lib.trainers.BpeTrainer(
        vocab_size=1000,
        min_frequency=2,
        special_tokens=list(tk.TRAINED_SPECIALS),
        max_token_length=8,
        show_progress=False,
    )
    tok.train_from_iterator([r.text for r in cleaned.collect()], trainer)
    return tok


def test_vocabulary_equals_the_public_library(trained, public):
    assert {t: i for i, t in enumerate(trained.tokens)} == public.get_vocab()
    assert len(trained) == 1000 and max(len(t) for t in trained.tokens if t not in trained.specials) < 8


def test_ids_and_text_equal_the_public_library(spark, cleaned, trained, public):
    encoded = enc.encode(cleaned, "doc_id", "text", trained, ascii_only=True, common_words=50)
    rows = encoded.withColumn("decoded", enc.decode(F.col("input_ids"), trained)).collect()
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.input_ids == public.encode(texts[r.doc_id]).ids
        assert r.decoded == texts[r.doc_id]
        assert r.length == len(r.attention_mask) == len(r.token_type_ids) == len(r.input_ids)


def test_unknown_characters_and_raw_text(spark):
    tok = tk.Tokenizer((*tk.TRAINED_SPECIALS, "▁", "a", "▁a"), frozenset(tk.TRAINED_SPECIALS), (("▁", "a"),))
    df = spark.createDataFrame([(1, "A éé"), (2, ""), (3, "ﬁ a")], "k bigint, t string")
    got = {r.k: r.input_ids for r in enc.encode(df, "k", "t", tok).collect()}
    assert got == {1: [7, 5, 0, 0], 2: [], 3: [5, 0, 0, 7]}


def test_null_and_repeated_keys_and_null_texts_keep_their_rows(spark):
    tok = tk.Tokenizer((*tk.TRAINED_SPECIALS, "▁", "a", "▁a"), frozenset(tk.TRAINED_SPECIALS), (("▁", "a"),))
    df = spark.createDataFrame([(None, "a"), ("k", "a a"), ("k", None), ("k", "a")], "k string, t string")
    encoded = enc.encode(df, "k", "t", tok)
    assert sorted((str(r.k), r.input_ids) for r in encoded.collect()) == [("None", [7]), ("k", []), ("k", [7]), ("k", [7, 7])]
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()


def test_special_tokens_are_ensured():
    tok = tk.Tokenizer((*tk.TRAINED_SPECIALS, "a"), frozenset(tk.TRAINED_SPECIALS), ()).with_specials()
    assert tok.tokens[-1] == tk.EOS and len(tok) == 7
    assert tok.with_specials() == tok


def test_store_refuses_an_existing_target(spark):
    path = new_stage_path(spark, "tok")
    tok = tk.Tokenizer((*tk.TRAINED_SPECIALS, "a", "b", "ab"), frozenset(tk.TRAINED_SPECIALS), (("a", "b"),))
    stages.save_tokenizer(spark, tok, path)
    assert stages.load_tokenizer(spark, path, ensure_specials=False) == tok
    assert stages.load_tokenizer(spark, path).tokens[-1] == tk.EOS
    with pytest.raises(AnalysisException):
        stages.save_tokenizer(spark, tok, path)


def test_ids_are_made_in_bounded_slices(spark):
    rows = [["ab", "c"], None, [], ["abcdef"], ["a", None], ["bc"], ["a" * 50], []]
    part = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(rows, pa.list_(pa.string()))], names=["k", "w"])
    for batch in (part, part.slice(1, 6)):
        for at_once in (1, 4, 7, 1000):
            slices = list(enc.in_slices(batch, 1, at_once))
            assert pa.Table.from_batches(slices).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
            for s in slices:
                sizes = [sum(len(w or "") for w in r or []) for r in s.column(1).to_pylist()]
                assert sum(sizes) <= at_once + max(sizes)
    assert len(list(enc.in_slices(part, 1, 4))) > 2 and not list(enc.in_slices(part.slice(0, 0), 1))
    tok = tk.Tokenizer((*tk.TRAINED_SPECIALS, "a", "b", tk.WORD_START), frozenset(tk.TRAINED_SPECIALS), ())
    df = spark.createDataFrame([(i, "ab " * i) for i in range(20)], "k int, t string")
    assert [len(r.input_ids) for r in enc.encode(df, "k", "t", tok).orderBy("k").collect()] == [0] + [3 * i + 1 for i in range(1, 20)]


def test_a_job_applies_few_old_merges(spark, monkeypatch):
    replayed = []
    log = bpe.change_log
    monkeypatch.setattr(bpe, "change_log", lambda done, tried: replayed.append(len(done)) or log(done, tried))
    random.seed(3)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9))) for _ in range(400)]
    df = spark.createDataFrame([(w, 20) for w in set(words)], "word string, cnt long")
    assert len(bpe.train_bpe(df, 150).merges) > 100
    assert max(replayed) < 24


def random_words(rng, n, letters="abcd▁x", longest=12):
    return ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n)]


def random_tokenizer(rng, n_merges=60, letters="abcd▁."):
    tokens, merges = [*tk.TRAINED_SPECIALS, *letters], []
    while len(merges) < n_merges:
        pair = tuple(rng.choices(tokens[len(tk.TRAINED_SPECIALS):], k=2))
        if pair not in merges and len("".join(pair)) < 7:
            merges.append(pair)
            tokens += [t for t in ["".join(pair)] if t not in tokens]
    return tk.Tokenizer(tuple(tokens), frozenset(tk.TRAINED_SPECIALS), tuple(merges))


def test_words_are_encoded_together_as_one_by_one(monkeypatch):
    rng = random.Random(5)
    for size in (7, enc.WORDS_AT_ONCE):
        monkeypatch.setattr(enc, "WORDS_AT_ONCE", size)
        for n_merges in (0, 1, 60):
            tok = random_tokenizer(rng, n_merges)
            words = [*random_words(rng, 400), "", "a" * 47, "ab" * 24, "ab" * 40, "é😀a"]
            assert enc.words_encoder(tok)(words) == [enc.word_encoder(tok)(w) for w in words]
    assert enc.words_encoder(tok)([]) == []


def test_words_are_encoded_faster_together():
    rng = random.Random(6)
    tok = random_tokenizer(rng, 200, "abcdefghij")
    words = random_words(rng, 20_000, "abcdefghij", 14)

    def seconds(encode):
        begin = time.perf_counter()
        encode()
        return time.perf_counter() - begin

    one_by_one = enc.word_encoder(tok)
    slow, fast = seconds(lambda: [one_by_one(w) for w in words]), seconds(lambda: enc.words_encoder(tok)(words))
    assert fast < 0.6 * slow


def test_chunks_have_the_ids_and_counts_of_their_words(spark):
    rng = random.Random(7)
    texts = ["", " ", "▁", "  ", " a", "▁a", "a ▁b", "a.b", ". .", "\n a\n", "ab,cd ¿ab?؟ é", "a" * 60 + ".b" * 40, None]
    texts += ["".join(rng.choices("abcd. ▁,\n¿x", k=rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    words = {r.k: r.w or [] for r in df.select("k", tk.split_words(F.lower("t")).alias("w")).collect()}
    tok = random_tokenizer(rng)
    one_by_one = enc.word_encoder(tok)
    ids = {r.k: r.input_ids for r in enc.encode(df, "k", "t", tok, ascii_only=True).collect()}
    assert ids == {k: [i for w in ws for i in one_by_one(w)] for k, ws in words.items()}
    counts = {r.word: r.cnt for r in tk.count_words(df, "t", True).collect()}
    assert counts == Counter(w for ws in words.values() for w in ws)


def test_merges_out_of_order_are_made_in_the_order_of_one_word():
    rng = random.Random(8)
    # "ab" is made by the last merge too, after merges that take it; runs of one letter overlap.
    merges = [("ab", "a"), ("a", "a"), ("aa", "aa"), ("b", "a"), ("a", "b"), ("aa", "b")]
    out_of_order = tk.Tokenizer((*tk.TRAINED_SPECIALS, "a", "b", "aa", "aaaa", "ab", "ba", "aba", "aab"), frozenset(), tuple(merges))
    toks = [out_of_order, *(random_tokenizer(rng, 60, "abc") for _ in range(20)), random_tokenizer(rng, 1500, "abcdefgh")]
    assert len(toks[-1]) > enc.SMALL_VOCAB
    for tok in toks:
        words = pa.array([*random_words(rng, 300, "aab", 14), *random_words(rng, 300, "abcdefgh", 9), "a" * 4000])
        one_by_one = enc.word_encoder(tok)
        for some in (words, words.slice(5, 90), words.slice(0, 0)):
            ids = [one_by_one(w) for w in some.to_pylist()]
            sizes, flat = enc.flat_encoder(tok)(some)
            assert (sizes.tolist(), flat.tolist()) == ([len(i) for i in ids], [i for made in ids for i in made])


def test_whole_texts_go_to_the_tasks_that_encode_them(spark):
    tok = tk.Tokenizer((*tk.TRAINED_SPECIALS, "a", "b", tk.WORD_START), frozenset(tk.TRAINED_SPECIALS), ())
    df = spark.createDataFrame([(1, "ab a")], "k int, t string")
    plan = enc.encode(df, "k", "t", tok)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "lambda" not in plan


def test_a_task_encodes_distinct_chunks_several_times_as_fast():
    rng = random.Random(9)
    tok = random_tokenizer(rng, 250, "abcdefghijklmnop")
    words = random_words(rng, 60_000, "abcdefghijklmnop", 14)
    one_by_one, together, some = enc.word_encoder(tok), enc.flat_encoder(tok), pa.array(words)
    begin = time.perf_counter()
    for w in words:
        one_by_one(w)
    middle = time.perf_counter()
    together(some)
    assert time.perf_counter() - middle < 0.5 * (middle - begin)


def test_merges_made_before_are_replayed_without_counting(monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs were counted")

    monkeypatch.setattr(bpe, "summed", refuse)
    words = pa.array([[97, 98, 97, 98], [97, 97, 97], [98]], pa.list_(pa.int32()))
    part = pa.RecordBatch.from_arrays([words, pa.array([3, 2, 1])], names=["symbols", "cnt"])
    ab, aa = bpe.FIRST_MERGED, bpe.FIRST_MERGED + 1
    (rows,) = bpe.rewriter([(97, 98, ab), (97, 97, aa), (ab, ab, aa + 1)])(iter([part]))
    assert rows.to_pydict() == {"symbols": [[aa + 1], [aa, 97], [98]], "cnt": [3, 2, 1]}


def test_chunks_are_counted_where_they_are_cut(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("",), (" a",)], "text string")
    counts = tk.count_words(df, "text", True)
    assert {r.word: r.cnt for r in counts.collect()} == {"▁a": 3, "▁b": 1}
    assert "split(" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_indexed_merges_equal_plain_ones_and_can_be_taken_back():
    rng = random.Random(8)
    words = random_words(rng, 300, "ab", 14)
    rows = pa.RecordBatch.from_pydict({"symbols": [[ord(c) for c in w] for w in words], "cnt": [rng.randint(1, 9) for _ in words]})
    (plain,), (block,) = list(bpe.blocks([rows])), list(bpe.blocks([rows]))
    indexed, n = bpe.Indexed(block, undoable=True), bpe.FIRST_MERGED
    merges = [(97, 97, n), (97, 98, n + 1), (n, n, n + 2), (98, 98, n + 3), (n + 3, 98, n + 4), (n + 1, n + 1, n + 5), (n, n + 2, n + 6)]
    changes = [plain.merge_and_count(*m) for m in merges]
    for taken_back in (7, 4, 0):
        done = 7 - taken_back if taken_back < 7 else 0
        for merge, (keys, by) in list(zip(merges, changes))[len(indexed.past) :]:
            got = indexed.merge_and_count(*merge)
            assert got[0].tolist() == keys.tolist() and got[1].tolist() == by.tolist()
        if taken_back:
            indexed.undo(taken_back)
            assert len(indexed.past) == done
    assert block.symbols().to_pylist() == plain.symbols().to_pylist()


def test_many_merges_take_few_jobs(spark, monkeypatch):
    tried = []
    log = bpe.change_log
    monkeypatch.setattr(bpe, "change_log", lambda done, merges: tried.append(len(merges)) or log(done, merges))
    rng = random.Random(5)
    words = random_words(rng, 3000, "abcdefghijkl", 9)
    df = spark.createDataFrame([(w, rng.randint(1, 50)) for w in set(words)], "word string, cnt long")
    tok = bpe.train_bpe(df, 900, 2)
    assert len(tok) == 900 and len(tried) <= 12


def test_vocab_size_is_that_of_the_full_training(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(250)] + ["ab" * 15, "abc" * 9, "aaa"]
    texts = [(i, " ".join(words)) for i in range(12)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = QUERIES["vocab_size"](spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == con.execute(ORACLES["vocab_size"]).fetchone()[0] > 400
