"""URL filters: host and path rules, and a weighted vocabulary found by Aho-Corasick.

``judge_urls`` splits each url into host and path, applies the longest fitting rule
and, where no rule fits, the vocabulary: a url is rejected on one strict term or on
several distinct soft terms.  A term counts only where the characters before and
after it are not ASCII letters or digits.

Defined cases: a null url and a url without ``://`` have an empty host and path, and
no rule fits them; a null url holds no terms and is allowed.  Repeated rows are judged
one by one.  An empty vocabulary or an empty rule list is valid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, ascii_lower

STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "camgirls", "milf", "escorts", "hardcore-sex")
SOFT_TERMS = ("adult", "sex", "nude", "casino", "betting", "poker", "viagra", "dating", "lingerie", "webcam", "free", "hot")
SOFT_LIMIT = 2
STRICT_WEIGHT = 1.0
MOST_TERMS = 1_000_000

# (rule, verdict): host, then path from the first slash on.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """Item ``value`` (0 the rule, 1 its verdict) of the longest rule that fits; null if none does."""
    chosen: Column | None = None
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule[0].partition("/")
        fits = (F.concat(F.lit("."), host).endswith(F.lit("." + name))) & path.startswith(F.lit(slash + rest))
        chosen = F.when(fits, F.lit(rule[value])) if chosen is None else chosen.when(fits, F.lit(rule[value]))
    return F.lit(None).cast("string") if chosen is None else chosen


def terms_from_table(
    terms: DataFrame, term: str = "term", weight: str = "weight", strict_weight: float = STRICT_WEIGHT, most: int = MOST_TERMS
) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms for ``judge_urls`` out of a table: strict from ``strict_weight`` on, soft
    with a weight above 0, by the highest weight of a term that stands there several times.

    Terms are compared with A-Z in lower case; null and empty ones and those without a weight
    are left out.  A vocabulary of more than ``most`` terms is an error, as it goes to every task.
    """
    rows = terms.select(ascii_lower(F.col(term)).alias("t"), F.col(weight).cast("double").alias("w"))
    rows = rows.filter("t <> '' AND w > 0").groupBy("t").agg(F.max("w").alias("w")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    strict = tuple(sorted(r["t"] for r in rows if r["w"] >= strict_weight))
    return strict, tuple(sorted(r["t"] for r in rows if r["w"] < strict_weight))


def term_hits(strict: Sequence[str], soft: Sequence[str]):
    """A column function from url to the distinct strict and soft terms in it, sorted.

    The vocabulary goes to each task once, with the function, and the automaton is
    built from it there: the vocabulary is a list on the driver, so its size is known.
    """
    weight = {t: "soft" for t in soft} | {t: "strict" for t in strict}
    lower = str.maketrans(UPPER, LOWER)

    @F.pandas_udf("strict array<string>, soft array<string>")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in weight:
            machine.add_word(term, term)
        if weight:
            machine.make_automaton()
        solid = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in urls:
            rows = []
            for url in batch:
                found: set[str] = set()
                if url and weight:
                    text = url.translate(lower)
                    for last, term in machine.iter(text):
                        first = last - len(term)
                        if (first < 0 or text[first] not in solid) and text[last + 1 : last + 2] not in solid:
                            found.add(term)
                rows.append(
                    (
                        sorted(t for t in found if weight[t] == "strict"),
                        sorted(t for t in found if weight[t] == "soft"),
                    )
                )
            yield pd.DataFrame(rows, columns=["strict", "soft"])

    return hits


def judge_urls(
    pages: DataFrame,
    key: str,
    url: str,
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, ``strict_terms``, ``soft_terms``."""
    rows = pages.select(F.col(key), F.col(url).alias("__url"))
    rows = rows.withColumn("__hits", term_hits(strict, soft)(F.col("__url")))
    rows = rows.select(
        F.col(key),
        host_of(F.col("__url")).alias("host"),
        path_of(F.col("__url")).alias("path"),
        F.col("__hits.strict").alias("strict_terms"),
        F.col("__hits.soft").alias("soft_terms"),
    )
    rejected = (F.size("strict_terms") >= 1) | (F.size("soft_terms") >= soft_limit)
    return rows.select(
        key,
        "host",
        "path",
        fitting_rule(F.col("host"), F.col("path"), rules, 0).alias("rule"),
        F.coalesce(
            fitting_rule(F.col("host"), F.col("path"), rules, 1),
            F.when(rejected, F.lit("block")).otherwise(F.lit("allow")),
        ).alias("verdict"),
        "strict_terms",
        "soft_terms",
    )
