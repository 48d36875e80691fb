"""Brute force and defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.llm import compression_rules as cr
from lexloom.llm import decontamination as dc
from lexloom.llm import interpolation_lm as lm
from lexloom.llm import mixing, order_minhash, secret_scan, sharding, tool_calls, url_filter
from lexloom.llm.components import connected_components
from lexloom.session import write_and_read

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard int, label string"
PROSE = [" ".join(f"w{(i * 37 + j * j) % 911}" for j in range(60 + i)) for i in range(6)]
LONG = " ".join(f"v{(i * i) % 7919}" for i in range(40_000))
TEXTS = [None, "", "one two", PROSE[0], PROSE[0], PROSE[0].replace("w37", "x"), *PROSE[1:], LONG, "same line here\n" * 40, "ÄÖ \u00a0 x\tÀ"]


def rows_of(texts):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, 2, 3, "c") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, PROSE[1], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return write_and_read(spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return write_and_read(spark.createDataFrame([], SCHEMA), "test-none")


def test_urls_by_brute_force(spark):
    urls = [None, "", "no-scheme", "http://A.Example.ORG/es/x?xxx", "https://x.org", "https://ex.com/fr/a#casino", "s://h/xxx", "s://h/a-xxxb",
            "s://h/casino/poker", "s://casino.h/casino", "s://h/CASINO.Dating", "a://b://c/xxx", "s://notexample.org/es/"]
    rows = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id int, url string, host string"), "page_id", "url").collect()}
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(rows.items())]
    assert got[:4] == [("", "", None, "allow")] * 3 + [("a.example.org", "/es/x", "example.org/es/", "block")]
    assert got[4] == ("x.org", "", None, "allow") and got[5][2:] == ("com/fr/", "allow")
    assert [g[3] for g in got[6:]] == ["block", "allow", "block", "allow", "block", "block", "allow"]
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id int, url string"), "page_id", "url").count() == 0


def test_vocabulary_of_thousands_of_terms(spark):
    """Verdicts come from the vocabulary: one strict term, two distinct soft ones, at boundaries only."""
    words = [f"t{i * 7919 % 100003}x" for i in range(4000)]
    rows = [(w if i % 3 else w.upper(), 1.5 if i % 4 == 0 else 0.4) for i, w in enumerate(words)]
    rows += [(words[1], 2.0), (words[2], 0.1), ("", 1.0), (None, 1.0), ("nothing", 0.0), ("unweighed", None)]
    table = spark.createDataFrame(rows, "term string, weight double")
    strict, soft = url_filter.terms_from_table(table)
    assert set(strict) == {words[1], *words[::4]} and len(strict) + len(soft) == 4000 and words[2] in soft
    urls = []
    for i in range(0, 3990, 5):
        a, b = words[i : i + 2]
        urls += [f"s://h/{a}", f"s://h/{a}/{b}", f"s://h/{a}-{a}", f"s://h/z{a}/{b}9", f"s://{b.upper()}.h/?q={a}", f"s://h/{a}{b}"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(frame, "page_id", "url", rules=(), strict=strict, soft=soft).collect()}
    verdicts = Counter()
    for i, url in enumerate(urls):
        found = set(re.split("[^a-z0-9]+", url.lower()))
        hard, mild = sorted(found & set(strict)), sorted(found & set(soft))
        assert (got[i]["strict_terms"], got[i]["soft_terms"]) == (hard, mild)
        assert got[i]["verdict"] == ("block" if hard or len(mild) > 1 else "allow")
        verdicts[bool(hard), min(len(mild), 2)] += 1
    assert min(verdicts.values()) > 50 and len(verdicts) >= 5
    with pytest.raises(ValueError):
        url_filter.terms_from_table(table, most=100)
    allowed = url_filter.judge_urls(frame, "page_id", "url", rules=(), strict=(), soft=())
    assert allowed.filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_quality_by_brute_force(docs, none):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        seen = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(seen)

    judged = cr.judge_quality(docs)
    assert judged.columns == [*docs.columns, "quality"]
    for r in judged.collect():
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute(r["text"])
        assert q["base_failed"] == (q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"])
    kept = cr.keep_good(docs)
    assert kept.columns == docs.columns and kept.filter("text LIKE 'same line%'").count() == 0
    assert kept.filter("doc_id = 3").count() == 2 and cr.keep_good(none).count() == 0


def test_compression_bands_by_brute_force(spark):
    """Ratios of whole texts and of chunks against zstandard itself, over texts of every length class."""
    import base64
    import hashlib

    import zstandard

    packer = zstandard.ZstdCompressor(level=cr.LEVEL, write_content_size=False, write_checksum=False)
    noise = lambda n, seed: base64.b64encode(b"".join(hashlib.sha256(f"{seed}{i}".encode()).digest() for i in range(n // 32 + 1)))[:n].decode()
    spaced = lambda t: " ".join(t[i : i + 7] for i in range(0, len(t), 7))
    plain = [" ".join(f"{w}{(i * j) % 613}" for j, w in enumerate("the of and one two some more".split() * k)) for i, k in enumerate((1, 3, 9, 40, 170, 700), 1)]
    texts = [None, "", "short", *plain, *[spaced(noise(n, n)) for n in (50, 100, 500, 3000, 30_000)]]
    texts += ["word " * n for n in (5, 30, 100, 800, 9000)] + [f"line {i} of one and the same long list\n" * 60 for i in range(2)]
    texts += [plain[5] + spaced(noise(n, 1)) for n in (4000, 20_000, 60_000)] + [plain[5] + "same again " * n for n in (300, 3000)]

    def expected(text):
        raw = (text or "").encode()
        band = [(low, high) for least, low, high in cr.LIMITS if len(raw) >= least][-1:]
        if not band:
            return None, 0.0, False
        ratio = len(raw) / len(packer.compress(raw))
        outside, bad = not band[0][0] <= ratio <= band[0][1], 0
        if len(raw) > cr.CHUNK_BYTES:
            for at in range(0, len(raw), cr.CHUNK_BYTES):
                piece = raw[at : at + cr.CHUNK_BYTES]
                low, high = [(low, high) for least, low, high in cr.LIMITS if len(piece) >= least][-1:][0] if len(piece) >= 64 else (0, 1e9)
                if len(piece) >= cr.LEAST_CHUNK and not low <= len(piece) / len(packer.compress(piece)) <= high:
                    bad += len(piece)
        return ratio, bad / len(raw), outside or bad / len(raw) >= cr.CHUNK_SHARE

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    seen = Counter()
    for r in cr.judge_quality(frame).collect():
        q, (ratio, bad, goes) = r["quality"], expected(r["text"])
        assert q["ratio"] == (None if ratio is None else pytest.approx(ratio)) or (ratio is None and math.isnan(q["ratio"]))
        assert q["bad_chunk_share"] == pytest.approx(bad) and q["kept"] == (not goes and not q["base_failed"])
        seen[goes, q["base_failed"], bad > 0] += 1
    # Texts that go by their band alone, by their chunks, and texts that stay.
    assert seen[True, False, True] and seen[False, False, False] and sum(n for (goes, _, _), n in seen.items() if goes) >= 4


def test_places_by_brute_force(spark):
    """Every place of the permutation against the same network over plain numbers."""

    def place(x, n, seed):
        a, b = sharding.rectangle(n)
        while True:
            left, right = x % a, x // a
            for i, key in enumerate(sharding.round_keys(seed)):
                v = ((right if i % 2 == 0 else left) + key) & sharding.MASK
                for factor, shift in ((739982445, 15), (695872825, 12)):
                    v = v * factor & sharding.MASK
                    v ^= v >> shift
                left, right = ((left + v) % a, right) if i % 2 == 0 else (left, (right + v) % b)
            x = left + right * a
            if x < n:
                return x

    for n, seed in ((1, 0), (5, 1), (777, 2), (4099, 3)):
        got = spark.range(n).select("id", sharding.permute(F.col("id"), n, seed).alias("p")).collect()
        assert all(r["p"] == place(r["id"], n, seed) for r in got)


def test_shards_are_a_permutation(docs, none):
    rows = sharding.assign_shards(docs, "doc_id", "text", 4).collect()
    assert len(rows) == docs.count()
    assert sorted(r["slot"] * 4 + r["shard"] for r in rows) == list(range(len(rows)))
    for r in rows:
        t = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else PROSE[1]) or ""
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert sharding.assign_shards(none, "doc_id", "text", 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_feistel_covers_every_size(spark, n):
    places = spark.range(n).select(sharding.permute(F.col("id"), n, 5).alias("p")).collect()
    assert sorted(r["p"] for r in places) == list(range(n))


def test_minhash_classes_by_brute_force(docs, none):
    def labelled(t):
        w, seen = (t or "").lower().split(), Counter()
        grams = [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []
        return {(g, seen.update([g]) or seen[g]) for g in grams}

    rows = order_minhash.near_duplicate_classes(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    classes = {}
    for r in rows:
        classes.setdefault(r["doc_id"], set()).add(r["class_id"])
    text = lambda i: TEXTS[i] if i is not None else PROSE[1]
    assert all(len(c) == 1 for c in classes.values())
    for a in classes:
        for b in classes:
            x, y = labelled(text(a)), labelled(text(b))
            near = len(x & y) >= 0.8 * len(x | y)
            assert (classes[a] == classes[b]) == near, (a, b)
    kept = order_minhash.keep_one_of_each(docs, "doc_id")
    assert kept.columns == docs.columns and kept.count() == len({r["class_id"] for r in rows})
    assert order_minhash.near_duplicate_classes(none, "doc_id").count() == 0


def test_sketches_are_made_of_few_rows_at_a_time():
    import pandas as pd

    frames = [pd.DataFrame({"n": range(begin, begin + size)}) for begin, size in ((0, 1200), (1200, 0), (1200, 3))]
    pieces = list(order_minhash.in_pieces(iter(frames)))
    assert [n for p in pieces for n in p["n"]] == list(range(1203))
    assert max(map(len, pieces)) <= 500 and order_minhash.KNOWN_WORDS <= 100_000


def test_alignment_keeps_order():
    import numpy as np

    a = np.arange(100, dtype=np.uint32)
    assert order_minhash.similarity(a, a) == 1
    assert order_minhash.similarity(a, np.roll(a, 50)) < 0.8
    assert order_minhash.similarity(a, np.delete(a, [3, 50])) == pytest.approx(0.98)


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 100L, 101L"))
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_contained_items(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[20000:20040])), (2, PROSE[2].upper()), (2, PROSE[2]), (3, "one two"), (4, None), (5, "a b c d e f")], "item_id int, text string")
    items = write_and_read(items, "test-items")
    found = dc.find_items(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted((r["doc_id"], r["item"]) for r in found) == [(TEXTS.index(PROSE[2]), 2)] * 2 + [(TEXTS.index(LONG), 1)]
    clean = dc.drop_contaminated(docs, "text", items, "item_id", "text")
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert dc.find_items(none, "doc_id", "text", items, "item_id", "text").count() == 0
    assert dc.find_items(docs, "doc_id", "text", items.filter("item_id > 9"), "item_id", "text").count() == 0


def test_mix_reaches_targets(docs, none):
    rows = mixing.mix(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert sum({r["source_size"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert sorted(map(tuple, mixing.mix(docs, "doc_id").collect()), key=str) == sorted(map(tuple, rows), key=str)
    taken = mixing.repeat_rows(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none, "doc_id").count() == 0
    assert mixing.source_targets([10, 100, 1000], [1.0, 2.0, 3.0]) == [30.0, 300.0, 780.0]


def test_secret_spans(spark, none):
    texts = [None, "", "😀 password: abcdefgh1 Token=short secret=token=abcdefgh", "AKIA" + "A1" * 8 + " " + "0f" * 20, "api_key='" + "x9" * 9 + "' identifier_of_ordinary_words", "secret:token:abcdefghij"]
    docs = write_and_read(spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id int, text string, kind string"), "test-secrets")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "markov"] for r in secret_scan.scan_secrets(docs, "doc_id").collect()}
    assert found[0] == found[1] == found[5] == []
    assert found[2] == [("assign", 2, 21), ("assign", 34, 55)]
    assert found[3] == [("access", 0, 20), ("hex", 21, 61)] and found[4] == [("assign", 0, 27)]
    assert secret_scan.scan_secrets(none, "doc_id").count() == 0


def test_models_part_random_from_ordinary(spark):
    import random

    rng = random.Random(3)
    words = ["configuration_manager", "user_account_handler", "document_identifier", "the_ordinary_language", "reading_the_tables"]
    noise = lambda: "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(24))
    ordinary = lambda: "_".join(rng.choice(rng.choice(words).split("_")) for _ in range(4))
    samples = spark.createDataFrame([(noise(), 1) for _ in range(300)] + [(ordinary(), 0) for _ in range(300)], "v string, y int")
    ratios = secret_scan.train_ratios(samples, "v", "y")
    held = spark.createDataFrame([(noise(), 1) for _ in range(100)] + [(ordinary(), 0) for _ in range(100)], "v string, y int")
    right = held.filter((secret_scan.log_ratio(F.col("v"), ratios) > 0) == (F.col("y") == 1)).count()
    assert right >= 195


def test_language_model_by_brute_force(docs, none):
    rows = docs.select("doc_id", "text").collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])), None] for i, r in enumerate(rows)}
    held = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 1 for r in rows]
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    expected = sorted((rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, held[i], len(ws), sum(w in counts for w in ws),
                       round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 6)) for i, ws in words.items())
    for size in (300, 10_000_000):  # many small chunks, or one
        got = lm.score_documents(docs, "doc_id", chunk_tokens=size, range_characters=50_000).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expected
        assert all(r["train_tokens"] == total and r["score"] < 0 for r in got)
    assert lm.score_documents(none, "doc_id").count() == 0


def test_log_ratios_by_brute_force(spark):
    letters = len(secret_scan.ALPHABET) + 1
    ratios = [math.sin(i) for i in range(letters**2)]
    values = ["", "a", "ab", "AKIA99==", "x y\u00e9", "a" * 500, *secret_scan.made_keys(20)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.log_ratio(F.col("v"), ratios).alias("r"))
    place = lambda c: secret_scan.ALPHABET.find(c) + 1
    for r in got.collect():
        assert r["r"] == pytest.approx(sum(ratios[place(a) * letters + place(b)] for a, b in zip(r["v"], r["v"][1:])))


def test_secrets_in_one_very_long_run(spark):
    """The work grows with the length of a run, not with its square."""
    run = "".join(secret_scan.made_keys(6000))
    assert len(run) > 200_000
    docs = spark.createDataFrame([(1, f"image {run} password = hunter2hunter2"), (2, None)], "doc_id bigint, text string")
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan_secrets(docs, "doc_id").collect()}
    assert ("assign", len(run) + 7, len(run) + 7 + 25) in spans[1] and spans[2] == []


def test_items_too_short_to_search_are_listed(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "one two three four five"), (3, None)], "item_id int, text string")
    assert sorted(r["item_id"] for r in dc.unsearched_items(items, "item_id", "text").collect()) == [1, 3]


def test_mix_of_many_rows(spark):
    """Every source comes within a short document of its target, a hot one and whole-number names too."""
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), [0, 0, 0, 1, 2, None, -3][i % 7]) for i in range(3000)]
    frame = write_and_read(spark.createDataFrame(rows, "doc_id bigint, text string, source int"), "test-mix")
    mixed = mixing.mix(frame, "doc_id").collect()
    sizes, taken, target = Counter(), Counter(), {}
    name = {i: s for i, _, s in rows}
    for r in mixed:
        s = name[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["rate"] <= 3
    ordered = [-3, 0, 1, 2, None]
    expected = mixing.source_targets([sizes[s] for s in ordered], (1.0, 2.0, 3.0))
    for s, t in zip(ordered, expected):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 97
    # The rates of a source tilt one way, by size.
    for s in (0, 1):
        pairs = sorted({(r["size"], r["rate"]) for r in mixed if name[r["doc_id"]] == s})
        rates = [r for _, r in pairs]
        assert rates in (sorted(rates), sorted(rates, reverse=True)) and len(set(rates)) > 5
    again = mixing.mix(frame, "doc_id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed))


def test_columns_with_the_names_of_operators_stay(spark, docs):
    own = {"quality": "mine", "copies": 7, "__row": "a", "__file": "b", "__at": 1, "size": 5, "__size": 3, "multiplier": 0.5}
    frame = docs.select("doc_id", "text", "source", *[F.lit(v).alias(k) for k, v in own.items()])
    frame = write_and_read(frame, "test-clash")
    items = spark.createDataFrame([(1, PROSE[2])], "item_id int, text string")
    for made in (cr.keep_good(frame), order_minhash.keep_one_of_each(frame, "doc_id"), mixing.repeat_rows(frame),
                 dc.drop_contaminated(frame, "text", items, "item_id", "text")):
        assert made.columns == frame.columns and made.count() > 0
        assert made.select(*own).distinct().collect() == [tuple(own.values())]
        assert made.join(frame, "doc_id", "left_semi").count() >= made.filter("doc_id IS NOT NULL").count()


def test_em_finds_the_mixture(spark):
    events = spark.createDataFrame([(1, 0.1, 0.9, 90), (1, 0.1, 0.0, 10)], 'class int, p1 double, p2 double, n bigint')
    weights = lm.learn_weights(events, 1e-6, rounds=200, tolerance=0)
    best = max((90 * math.log(0.1 * (1 - x) + 0.9 * x) + 10 * math.log(0.1 * (1 - x)), x) for x in (i / 1000 for i in range(1000)))[1]
    assert weights[1, 2] == pytest.approx(best, abs=0.01)


CALLS = "conv bigint, id string, position bigint, name string, arguments string, depends_on array<string>"
RESULTS = "conv bigint, id string, position bigint, content string"


def test_tool_calls(spark):
    schemas = {"f": {"a": ("integer", True), "b": ("string", False)}}
    calls = spark.createDataFrame(
        [(1, "x", 1, "f", '{"b": "q", "a": 1}', ["z"]), (1, "z", 2, "f", '{"a": "1", "c": {"y": 1, "x": [2]}}', []), (1, "z", 2, "f", '{"a": "1", "c": {"y": 1, "x": [2]}}', []),
         (1, "l", 3, "g", "{}", ["m"]), (1, "m", 4, "f", None, ["l", "nowhere"]), (None, "x", 5, "f", "[1]", None), (2, None, 6, "f", '{"a": null}', [])], CALLS)
    results = spark.createDataFrame([(1, "x", 9, 'say "hi"\n'), (1, "x", 10, "again"), (3, "o", 1, None)], RESULTS)
    got = {(r["conv"], r["id"]): r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert len(got) == 7
    x, z = got[(1, "x")], got[(1, "z")]
    assert (x["status"], x["level"], x["seq"], x["n_results"], x["errors"]) == ("linked", 1, 1, 2, [])
    assert x["json"] == '{"arguments":{"a":1,"b":"q"},"id":"x","name":"f","result":"say \\"hi\\"\\n"}'
    assert (z["status"], z["level"], z["seq"], z["n_calls"], z["errors"]) == ("no_result", 0, 0, 2, ["type:a", "unknown:c"])
    assert z["json"].startswith('{"arguments":{"a":"1","c":{"x":[2],"y":1}}')
    assert got[(1, "l")]["level"] is None and got[(1, "l")]["errors"] == ["unknown_tool"]
    assert got[(1, "m")]["errors"] == ["not_object", "unknown_dependency"]
    assert got[(None, "x")]["status"] == got[(2, None)]["status"] == "no_id" and got[(2, None)]["errors"] == ["missing:a"]
    assert got[(3, "o")]["status"] == "no_call"
    assert tool_calls.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_bitmaps_never_hide_a_pair_of_the_needed_similarity():
    import numpy as np

    from lexloom.llm import order_minhash as om

    random, sketcher, near = np.random.default_rng(7), om.Sketcher(), 0
    for size in (1, 4, 5, 30, 146, 800, 5000):
        for share in (0.0, 0.01, 0.03, 0.05, 0.3):
            words = [b"w%d" % w for w in random.integers(0, 300, size)]
            other = [b"x" if random.random() < share else w for w in words]
            a, b = sketcher.kmers(words), sketcher.kmers(other)
            apart = np.bitwise_count((om.bitmap(a) ^ om.bitmap(b)).view(np.uint64)).sum()  # of signed numbers it counts the absolute value
            common = len(np.intersect1d(a, b))
            assert apart <= len(a) + len(b) - 2 * common
            if om.similarity(a, b) >= om.THRESHOLD:
                near += 1
                assert apart <= (1 - om.THRESHOLD) / (1 + om.THRESHOLD) * (len(a) + len(b)) + 1e-6
    assert near > 10


def test_rows_keep_their_number_when_files_are_cut_anew(spark, monkeypatch):
    from itertools import cycle

    texts = [" ".join(f"t{(i // 2) * 100 + j}" for j in range(40)) + (" tail" if i % 2 else "") for i in range(24)]
    docs = write_and_read(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("s")).repartition(12), "test-cut")
    items = write_and_read(spark.createDataFrame([(1, texts[0]), (2, texts[22])], "item_id int, text string"), "test-items")
    conf, cuts = "spark.sql.files.minPartitionNum", cycle(["1", "12", "5"])

    def write_then_cut_otherwise(df, name):
        written = write_and_read(df, name)
        spark.conf.set(conf, next(cuts))  # as if the number of registered cores had changed
        return written

    for module in (order_minhash, dc, secret_scan, mixing):
        monkeypatch.setattr(module, "write_and_read", write_then_cut_otherwise)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        classes = order_minhash.near_duplicate_classes(docs, "doc_id").collect()
        assert sorted((r["doc_id"], r["class_id"]) for r in classes) == [(i, i - i % 2) for i in range(24)]
        kept = order_minhash.keep_one_of_each(docs, "doc_id")
        spark.conf.set(conf, "7")
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 24, 2))
        clean = dc.drop_contaminated(docs, "text", items, "item_id", "text")
        spark.conf.set(conf, "2")
        assert sorted(r["doc_id"] for r in clean.collect()) == [i for i in range(24) if i not in (0, 1, 22, 23)]
        rows = order_minhash.stored_rows(docs).select("__row", F.col("text").alias("__text"))
        with pytest.raises(RuntimeError, match="2 rows wanted, 1 found"):
            order_minhash.kmers_of(rows, spark.sql("SELECT 3L AS a, 99L AS b"))
    finally:
        spark.conf.unset(conf)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_that_no_file_holds_are_written_before_they_are_numbered(spark, docs):
    from lexloom.llm.common import stored_rows

    for df in (docs, docs.filter("doc_id > 2"), docs.union(docs), docs.withColumn("r", F.rand()), docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))):
        numbers = sorted(r["__row"] for r in stored_rows(df).collect())
        assert len(set(numbers)) == df.count() and numbers[0] >= 0
    assert sorted(r["__row"] for r in stored_rows(docs).collect()) == list(range(docs.count()))


def test_bare_keys_are_found_without_a_pattern(spark):
    import random

    rng = random.Random(5)
    key = "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(40))
    texts = [" ".join(rng.choice(["language", "ordinary", "sentence", "document", "identifier", "2024-11-05T10"]) for _ in range(200)) for _ in range(20)]
    texts += [f"row one {key} row two", "seen on 2024-11-05T10/2024-11-05T10 in /documents/identifier/language-ordinary-sentence"]
    docs = write_and_read(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "test-bare")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan_secrets(docs, "doc_id").collect()}
    assert {i: s for i, s in found.items() if s} == {20: [("markov", 8, 48)]}


def test_ordinary_strings_come_from_all_texts_outside_the_spans(spark):
    texts = ["plain-words 2024-11-05 in 😀 text_one", "password: abcdefgh1 after/words token=abcdefgh1", None]
    rows = write_and_read(spark.createDataFrame(list(enumerate(texts)), "__row bigint, __text string").fillna(""), "test-own")
    samples = secret_scan.own_samples(rows, secret_scan.found_spans(rows)).collect()
    assert {r["value"]: r["times"] for r in samples if r["label"] == 0} == {"plain-words": 1, "2024-11-05": 1, "text_one": 1, "after/words": 1}
    assert sum(r["label"] for r in samples) == secret_scan.MADE_KEYS + 2


def test_a_candidate_is_compared_without_itself(spark):
    value = "abab-ababab/ab99"
    samples = lambda times: spark.createDataFrame([(value, 0, times), ("abba-cab/99", 0, 3), ("q9Zx+T", 1, 2)], "v string, y int, n int")
    with_it, without = (secret_scan.count_pairs(samples(n), "v", "y", "n") for n in (2, 1))
    v = F.lit(value)
    row = spark.range(1).select(
        (secret_scan.log_ratio(v, secret_scan.ratios_of(with_it)) + secret_scan.own_weight(v, with_it)).alias("a"),
        secret_scan.log_ratio(v, secret_scan.ratios_of(without)).alias("b"),
    ).first()
    assert row["a"] == pytest.approx(row["b"])


def test_levels_by_brute_force(spark, monkeypatch):
    import random

    rng, needs = random.Random(11), {}
    for i in range(300):  # a chain
        needs[1, f"c{i}"] = [f"c{i - 1}"] if i else []
    for conv in range(2, 30):
        n = rng.randint(1, 12)
        for i in range(n):
            back = [f"c{rng.randint(0, i)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))] if i and rng.random() < 0.9 else []
            needs[conv, f"c{i}"] = back + ([f"c{rng.randint(0, n)}"] if rng.random() < 0.1 else [])

    want, left = {}, dict(needs)
    while ready := [k for k, v in left.items() if all((k[0], x) in want or (k[0], x) not in needs for x in v)]:
        for k in ready:
            want[k] = max((want[k[0], x] + 1 for x in left.pop(k) if (k[0], x) in needs), default=0)
    rounds, write = [], tool_calls.write_and_read
    monkeypatch.setattr(tool_calls, "write_and_read", lambda df, name: (rounds.append(name), write(df, name))[1])
    got, unknown = tool_calls.levels(spark.createDataFrame([(c, i, n) for (c, i), n in needs.items()], "conv bigint, id string, depends_on array<string>"))
    assert {(r["conv"], r["id"]): r["level"] for r in got.collect()} == want and left and want[1, "c299"] == 299
    assert {tuple(r) for r in unknown.collect()} == {k for k, v in needs.items() if any((k[0], x) not in needs for x in v)}
    assert rounds.count("level") < 20


def test_derived_calls_hold_whole_texts_and_whole_chains(spark):
    import json

    from lexloom.llm import queries

    text = 'quote " back \\ slash\nline é 😀 ' * 9
    turns = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", text + "x" * (t % 4)) for c in (1, 3, 5) for t in range(40)], "conv_id bigint, turn int, role string, text string")
    rows = tool_calls.link_calls(queries.derived_calls(turns), queries.derived_results(turns), queries.TOOLS).collect()
    calls = [json.loads(r["json"])["arguments"] for r in rows if r["conv"] == 1]
    found = [a.get("query") or a.get("text") or a["options"]["text"] for a in calls]
    assert len(found) == 20 and all(f.startswith(text) for f in found)
    assert sorted(r["level"] for r in rows if r["conv"] == 1) == list(range(20))
    assert any(r["level"] is None and r["id"] is not None for r in rows if r["conv"] == 3)
