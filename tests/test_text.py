import random
import time

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as rules
from lexloom.plans.registry import spread

CASES = [
    (
        "see https://a.b/c?d=1 and http://x, www.foo.com/bar",
        "see [url] a.b c?d [number] and http x, [url] bar",
    ),
    ("mail me.x@y.com +1 555 123 4567", "mail me.x y.com [number] [number] [number] [number]"),
    (
        "Bob's dog's b'raw\\x00' 3.14 555-123-4567 5551234567",
        "bo s [number].[number] [phone number] [phone number]",
    ),
    ("<b>Hi</b> \U0001f600© a b\u000bc\u001cd\u0085e", "html hi html a b c d e"),
    ("www.5551234567 xhttps://q", "[url] number] x[url] q"),
    ("b'a\nb' c'", "b'a"),
    ("", ""),
    ("<a\nb>x", "html x"),
]


def one(spark, text, func):
    return spark.createDataFrame([(text,)], "t string").select(func(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, expected", CASES)
def test_clean_text(spark, text, expected):
    assert one(spark, text, rules.clean_text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("mail me.x@y.com now", "mail [email] now"),
        ("call +15551234567 or 555-123-4567", "call [phone number] or [phone number]"),
        ("see https://a.b/c?d=1, ok", "see [url] ok"),
        ("<p>x</p>", "[html] x[html]"),
    ],
)
def test_mask_first(spark, text, expected):
    assert one(spark, text, lambda c: rules.clean_text(c, mask_first=True)) == expected


def test_null_stays_null(spark):
    assert one(spark, None, rules.clean_text) is None


def test_plan_stays_in_codegen(spark, small, capsys):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.select("doc_id", rules.clean_text(F.col("text"))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_allow_list_is_the_set_of_its_characters(spark):
    allowed = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\n,.!?'\"-")
    points = [*range(0x3000), *range(0xD700, 0xD800), *range(0xE000, 0xE100), 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    rows = spark.createDataFrame([(i, f"a{chr(i)}b") for i in points], "i int, t string")
    held = F.regexp_replace("t", rules.NOT_ALLOWED_OR_HELD, " ").alias("held")
    for r in rows.select("i", rules.allow_list(F.col("t")).alias("plain"), rules.allow_list(F.col("t"), True).alias("more"), held).collect():
        assert r.plain == f"a{chr(r.i) if chr(r.i) in allowed else ' '}b"
        assert r.more == f"a{chr(r.i) if chr(r.i) in allowed | {'+', '@'} else ' '}b"
        assert r.held == f"a{chr(r.i) if chr(r.i) in allowed or 0xE000 <= r.i <= 0xE003 else ' '}b"


def test_allow_list_costs_no_more_than_other_sets(spark):
    rows = spark.range(1).select(F.repeat(F.lit("some plain words, as they come "), 200_000).alias("t")).localCheckpoint()

    def seconds(rule):
        taken = []
        for _ in range(3):
            begun = time.perf_counter()
            rows.agg(F.sum(F.length(rule(F.col("t"))))).collect()
            taken.append(time.perf_counter() - begun)
        return min(taken)

    assert seconds(rules.allow_list) < 5 * seconds(rules.blank_control) + 0.2


def test_tasks_of_a_corpus_stay_small(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(1000).repartition(2).write.parquet(path)
    dealt = spread(spark.read.parquet(path), rows_per_task=50)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100


def test_rules_match_what_their_plain_patterns_match(spark):
    rng = random.Random(4)
    pieces = ["1", "23", "456", "7890", "1234567890", "-", "+", " ", "  ", "\n", "a", "h", "w", "ww", "http", "www", "_", "é", "́", ".", "'", "~", "\x00", "ÿ", "ſ", "😀"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = {
        rules.NOT_ALLOWED: r"[^a-zA-Z0-9\n,.!?'\"\- ]", rules.URL: r"http\S+|www\S+", rules.NUMBER: r"\b\d+\b",
        rules.PHONE_TEN_DIGITS: r"\b\d{10}\b", rules.PHONE_DASHED: r"\b\d{3}-\d{3}-\d{4}\b", rules.SPACES: " +",
    }
    for used, meant in plain.items():
        replaced = [F.regexp_replace("t", F.lit(p), F.lit(" ")) for p in (used, meant)]
        assert df.filter(replaced[0] != replaced[1]).count() == 0


def test_the_chain_equals_its_single_rules(spark):
    rng = random.Random(8)
    pieces = ["1", "123", "456", "7890", "1234567890", "555-123-4567", "-", " ", "  ", "\n", "\t", "\x1f", "a", "b'", "'", "http", "www", "_", "<", ">", ".", "é", "@"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 16))) for _ in range(6000)] + ["", " ", "\n \n", " 1 \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    col = rules.mark_dashed_phone(rules.mark_ten_digit_phone(rules.allow_list(rules.mark_html(F.col("t")))))
    col = rules.strip_ends(rules.blank_control(rules.blank_bytes_literal(rules.mark_url(col))))
    single = rules.lowercase(rules.collapse_spaces(rules.mark_number(col)))
    assert df.filter(single != rules.clean_text(F.col("t"))).count() == 0
