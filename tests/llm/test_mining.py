"""Spelling variants, hard negatives and license templates against brute force, and their defined cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import hard_negatives as hn
from lexloom.llm import license_templates as lt
from lexloom.llm import spelling_variants as sv


def counted(docs):
    found = {}
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] = found.get(run, 0) + 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    for w, (form, *rest) in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, *rest)
    return out


def variant_docs():
    rng = random.Random(3)
    base = ["".join(rng.choice("aeinstß") for _ in range(rng.randint(5, 8))) for _ in range(40)]
    base += ["ÀÉîöü", "banana", "Éclair", "x" * 3000, "x" * 3001, "aaaaa", "aaaaaa", "abcde", "badce"]
    words = []
    for w in base:
        forms = [w] + [w[:i] + rng.choice("aeinstß") + w[i + rng.randint(0, 1) :] for i in rng.choices(range(len(w)), k=6)]
        for f in forms:
            words += [f] * rng.randint(1, 40)
    words += ["x" * 3000] * 9 + ["x" * 3001] * 3
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", ", ", "\n1", "_"]).join(words[i::30])) for i in range(30)]
    return [*docs, docs[4], (None, docs[5][1].upper()), (31, None), (32, ""), (33, "a b 12 ...")]


@pytest.mark.parametrize("cell_words", [4000, 25, 1])
def test_variants_by_brute_force(spark, monkeypatch, cell_words):
    """Whole, in cells, and with nodes that are too large to search at every depth."""
    docs = variant_docs()
    expected = variants(counted(docs))
    assert sum(v[0] is not None for v in expected.values()) > 20 and any(v[1] != v[0] and v[0] for v in expected.values())
    frame = spark.createDataFrame([(k, t, "z", 1) for k, t in docs], "doc_id bigint, text string, word string, n int")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in sv.spelling_variants(frame, "doc_id", cell_words=cell_words).collect()}
    assert got == expected


def test_variants_of_a_dense_dictionary(spark):
    """Every pair once, also where most words share their letters, and nodes of one path stay large."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(5, 7))) for _ in range(900)}
    expected = {(a, b) for a in words for b in words if one_apart(a, b)}
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    for cell_words in (4000, 60, 3):
        rows = [(r["word"], r["near"]) for r in sv.near_pairs(frame, cell_words).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sv.spelling_variants(none, "doc_id").collect() == []


def negatives(rows, scale=256):
    taking = [
        (i, c, [int(np.floor(scale * float(x))) for x in v])
        for i, c, v in rows
        if None not in (i, c, v) and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, c, v in taking:
        if i % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, u)), j, d) for j, d, u in taking if j != i and len(u) == len(v)]
        for p, pid in sorted((s, j) for s, j, d in scored if d == c)[:5]:
            fit = sorted((s, j) for s, j, d in scored if d != c and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, pid, k + 1, j, -p, -s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    rows[20] = (20, 1, rows[21][2])
    rows += [rows[30], rows[31], (None, 1, rows[0][2]), (301, None, rows[0][2]), (302, 1, None), (303, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(304, 1, [float("nan")] * 6), (305, 1, [float("inf")] * 6), (310, 1, []), (311, 2, []), (312, 1, []), (320, 1, [1.0] * 3), (321, 1, [2.0] * 3)]
    return rows + [(400 + i, 2, rows[7][2]) for i in range(30)]


@pytest.mark.parametrize("at_once", [(8192, 4096), (7, 11)])
def test_negatives_by_brute_force(spark, at_once):
    rows = vectors()
    frame = spark.createDataFrame([(i, c, v, 1, "z") for i, c, v in rows], "vec_id bigint, label int, embedding array<double>, rank int, id string").repartition(5)
    found = hn.mine_hard_negatives(frame, "vec_id % 10 = 0", anchors_at_once=at_once[0], candidates_at_once=at_once[1])
    assert sorted(map(tuple, found.collect())) == negatives(rows) != []
    assert hn.mine_hard_negatives(frame.limit(0), "vec_id % 10 = 0").collect() == []


def test_packed_products_are_exact():
    rng = np.random.default_rng(2)
    for size in (3, 2**14, 2**26):
        block, anchors = rng.integers(-size, size, (50, 33)), rng.integers(-size, size, (4, 33))
        packed = hn.PackedBlock(block, int(anchors.min()), int(anchors.max()))
        for a in anchors:
            assert packed.scores(a).tolist() == [sum(x * y for x, y in zip(a.tolist(), c)) for c in block.tolist()]
    with pytest.raises(OverflowError):
        hn.PackedBlock(np.full((2, 2), 1 << 40), -(1 << 40), 1 << 40)
    with pytest.raises(OverflowError):
        hn.whole_components(hn.pa.array([[1e300]]))


def test_templates_accept_what_their_markup_allows():
    a = lt.compile_template("one <<optional>>two <<any 1-2>><</optional>> three <<choice>>x<<or>>y z<</choice>> end")
    accept = lambda t: a.accept(lt.words_of(t), 0)
    assert accept("One, three: X end.") == 4 and accept("one two a three y z end") == 7 and accept("one two a b three x end more") == 7
    for wrong in ("one two three x end", "one two a b c three x end", "one three z end", "one three x", "two three x end", "one three x the end"):
        assert accept(wrong) == -1
    longest = lt.compile_template("a <<optional>>b<</optional>> <<optional>>c d<</optional>>")
    assert longest.accept(["a", "b", "c", "e"], 0) == 2 and longest.accept(["a", "c", "d"], 0) == 3
    for bad in ("<<any 0-2>> a", "<<optional>>a", "a <</optional>>", "<<or>>", "a <<nothing>>", "a <<any 3-2>>", "", "<<optional>>a<</optional>>"):
        with pytest.raises(ValueError):
            lt.compile_template(bad)


def expanded(template, words):
    """The plain wording: every optional part, first choice, ``words`` for each replaceable region."""
    text = re.sub(r"<<or>>.*?<</choice>>", "", template, flags=re.S)
    return re.sub(r"<<[^>]*>>", "", re.sub(r"<<any \d+-\d+>>", words, text))


def test_every_template_accepts_its_own_wording_only():
    scan = lt.scanner(lt.PHRASES, lt.TEMPLATES)
    for label, template in lt.TEMPLATES.items():
        text = expanded(template, " x ")
        assert label in scan(f"Before it.\n{text}\nafter")["labels"]
        words = text.split()
        mandatory = [i for i, w in enumerate(words[:4]) if lt.words_of(w)]
        changed = [*words[: mandatory[0]], "zzz", *words[mandatory[0] + 1 :]]
        assert label not in scan(" ".join(changed))["labels"]


def test_licenses_by_rows(spark):
    texts = [None, "", "Licensed under CC BY-NC 4.0. Released under the MIT License.", "the gnu GENERAL public-license, mit license; Apache license",
             "mit licenseé apache  licensed", "cc by " * 30000, "Licensed under the\nApache License, Version 2.0.", "MIT License", "MIT License"]
    frame = spark.createDataFrame([(None if i == 7 else i, t, "z", ["y"]) for i, t in enumerate(texts)], "doc_id bigint, text string, labels string, spans array<string>")
    rows = [tuple(r) for r in lt.scan_licenses(frame, "doc_id").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()]
    rows = dict(zip((*range(7), None, 8), (r[1:] for r in sorted(rows, key=lambda r: (7 if r[0] is None else r[0])))))
    assert rows[0] == rows[1] == (0, 0, None, None, [], [], 0.0)
    assert rows[2] == (12, 2, 2, 10, ["cc-by", "mit"], ["cc-by", "cc-by-nc-notice", "mit", "mit-notice"], 1.0)
    assert rows[3] == (9, 3, 1, 7, ["apache", "gpl", "mit"], ["apache", "gpl", "mit"], 0.5)
    assert rows[4] == (4, 0, None, None, [], [], 0.0)
    assert rows[5] == (60000, 30000, 0, 59998, ["cc-by"], ["cc-by"], 0.5)
    assert rows[6][4:] == (["apache"], ["apache", "apache-2.0-notice"], 1.0) and rows[None] == rows[8]
    assert lt.scan_licenses(frame.limit(0), "doc_id").count() == 0
    assert lt.scan_licenses(frame, "doc_id").filter(F.size("spans") > 0).count() == 2
