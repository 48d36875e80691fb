"""Secret scans: three patterns, and character Markov models compared by likelihood ratio; native.

Patterns find assigned passwords and tokens, access keys and long hexadecimal strings.
Beside them, every run of key characters is a candidate: it is reported when the
log-likelihood of its characters under a Markov model of random strings exceeds that
under one of ordinary identifiers by ``LEAST_RATIO``.  Both models are trained from
labelled samples.  Ordinary are all runs of six or more key characters of all texts,
outside the spans of the patterns.  Random is what the patterns found, and a fixed
sample of ``MADE_KEYS`` generated keys, so that a corpus without a hit has a model too.
A model is one count for each pair of characters, so its size is bounded by the
alphabet.  Keys that stand bare are among the ordinary strings, so a candidate is
compared with the ordinary model less one occurrence of itself.  Where bare keys are
most of what a corpus holds, they are what is ordinary in it.

Positions are code points, from zero, ends exclusive.  Matches are leftmost and do not
overlap within a kind; a match that fails its kind's test is dropped.  Candidates that
overlap a pattern's span are left to the pattern.

Defined cases: a null text is an empty one and has no spans; texts are scanned whole;
repeated rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import stored_rows
from lexloom.session import write_and_read


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
# Kind, pattern, the group whose length counts, its least length.
PATTERNS = (
    ("assign", rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
MODEL_KIND = "markov"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_-]{6,}"
MADE_KEYS = 600
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
SMOOTHING = 0.5
LEAST_RATIO = 12.0
# A text where no pattern and no candidate can stand is not looked at further.
ANY = "|".join(
    [
        rf"(?:{NAMES})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{{8,}}",
        r"AKIA[A-Z0-9]{12,}",
        CANDIDATE,
    ]
)


def found_spans(rows: DataFrame) -> DataFrame:
    """``__row``, ``kind``, ``start``, ``end``, ``value``: matches of all patterns and candidates in ``__text``.

    ``split`` gives what stands between the matches, so a match begins after the sum of
    all that comes before it in its text.
    """
    kinds = [(k, p, g, n) for k, p, g, n in PATTERNS] + [(MODEL_KIND, CANDIDATE, 0, 0)]
    text = F.col("__text")
    scans = F.array(
        *[
            F.struct(
                F.lit(i).alias("order"),
                F.lit(kind).alias("kind"),
                F.lit(least).alias("least"),
                F.arrays_zip(
                    F.split(text, pattern, -1).alias("gap"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
                ).alias("pieces"),
            )
            for i, (kind, pattern, group, least) in enumerate(kinds)
        ]
    )
    pieces = (
        rows.filter(text.rlike(ANY))
        .select("__row", F.explode(scans).alias("s"))
        .select("__row", "s.order", "s.kind", "s.least", F.posexplode_outer("s.pieces").alias("at", "piece"))
        .filter("piece.match IS NOT NULL")
        .select("__row", "order", "kind", "least", "at", F.length("piece.gap").alias("gap"), F.length("piece.match").alias("width"), "piece.value")
    )
    # A group is the matches of one kind in one text.
    upto = Window.partitionBy("__row", "order").orderBy("at")
    spans = pieces.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(upto).cast("int"))
    return spans.filter(F.length("value") >= F.col("least")).select(
        "__row", "order", "kind", (F.col("end") - F.col("width")).alias("start"), "end", "value"
    )


def places_of(value: Column) -> Column:
    """The place in the alphabet of each character of a string, 0 for others: cut into characters
    once, as to look for each one from the beginning takes the square of the length."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def pair_codes(value: Column) -> Column:
    """``first * letters + second`` for each two neighbouring characters."""
    places = places_of(value)
    n = F.greatest(F.length(value) - 1, F.lit(0))
    letters = len(ALPHABET) + 1
    return F.zip_with(F.slice(places, 1, n), F.slice(places, 2, n), lambda a, b: a * letters + b)


def character_pairs(strings: DataFrame, value: str, *keep: str) -> DataFrame:
    """One row for each two neighbouring characters: their ``code``."""
    # explode() would test the size first, in a filter that makes the codes twice
    return strings.select(*keep, F.explode_outer(pair_codes(F.col(value))).alias("code")).filter("code IS NOT NULL")


def count_pairs(samples: DataFrame, value: str, label: str, times: str | None = None) -> dict[int, list[int]]:
    """For each label the number of each pair of characters; index ``first * letters + second``.

    A sample counts as often as its column ``times`` says."""
    letters = len(ALPHABET) + 1
    samples = samples.withColumn("__times", F.col(times) if times else F.lit(1))
    counted = character_pairs(samples, value, label, "__times").groupBy(label, "code").agg(F.sum("__times").alias("count"))
    counts = {0: [0] * letters**2, 1: [0] * letters**2}
    for row in counted.collect():  # two labels, all pairs of letters at most
        counts[int(row[label])][row["code"]] = row["count"]
    return counts


def train_ratios(samples: DataFrame, value: str, label: str) -> list[float]:
    """``ratios_of`` labelled samples."""
    return ratios_of(count_pairs(samples, value, label))


def ratios_of(counts: dict[int, list[int]]) -> list[float]:
    """For each pair of characters, log of its chance after the first one in random strings
    (``label`` 1) over that in ordinary ones (``label`` 0); index ``first * letters + second``."""
    letters = len(ALPHABET) + 1

    def chances(c: list[int]) -> list[float]:
        after = [sum(c[i * letters : (i + 1) * letters]) for i in range(letters)]
        return [math.log((n + SMOOTHING) / (after[i // letters] + SMOOTHING * letters)) for i, n in enumerate(c)]

    return [a - b for a, b in zip(chances(counts[1]), chances(counts[0]))]


def log_ratio(value: Column, ratios: list[float]) -> Column:
    """Sum of the ratios of all neighbouring characters of a string."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    step = lambda total, code: total + F.element_at(table, code + 1)
    return F.aggregate(pair_codes(value), F.lit(0.0), step)


def own_weight(value: Column, counts: dict[int, list[int]]) -> Column:
    """What ``log_ratio`` gains when the ordinary strings have one ``value`` less."""
    letters = len(ALPHABET) + 1
    pairs = counts[0]
    after = [sum(pairs[i * letters : (i + 1) * letters]) for i in range(letters)]
    codes = pair_codes(value)

    def gain(codes: Column, numbers: list[int], floor: float) -> Column:
        # Of each code that stands run times in the value, run times the log of its number with the value over that without.
        table = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<double>")  # folded to one literal
        with_own = lambda a: F.element_at(table, F.greatest(a["code"], F.lit(0)) + 1)
        closed = lambda a: a["run"] * F.log(
            (with_own(a) + floor) / (F.greatest(with_own(a) - a["run"], F.lit(0.0)) + floor)
        )
        begun = F.struct(F.lit(-1).alias("code"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
        step = lambda a, x: F.struct(
            x.alias("code"),
            F.when(a["code"] == x, a["run"] + 1).otherwise(1).alias("run"),
            F.when(a["code"] == x, a["sum"]).otherwise(a["sum"] + closed(a)).alias("sum"),
        )
        return F.aggregate(F.array_sort(codes), begun, step, lambda a: a["sum"] + closed(a))

    firsts = F.transform(codes, lambda c: F.floor(c / letters).cast("int"))
    gained = gain(codes, pairs, SMOOTHING) - gain(firsts, after, SMOOTHING * letters)
    return F.when(F.length(value) < 2, F.lit(0.0)).otherwise(gained)


def made_keys(n: int = MADE_KEYS) -> list[str]:
    """A fixed sample of random strings: digests in hexadecimal digits and in both alphabets of base64, in turn."""
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    forms = (base64.b64encode, base64.urlsafe_b64encode, base64.b16encode)
    made = [forms[i % 3](d).decode().rstrip("=") for i, d in enumerate(digests)]
    return [m.lower() if i % 6 == 2 else m for i, m in enumerate(made)]


def outside(text: Column, spans: Column) -> Column:
    """``text`` without its ``spans`` (``start``, ``end``, sorted), a line end in place of each."""
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, s: F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece(a, s), F.lit("\n")).alias("out")
    )
    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.aggregate(spans, begun, step, rest)


def own_samples(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``value``, ``label``, ``times``: what patterns found and generated keys as random,
    and the strings of all texts outside the patterns' spans as ordinary."""
    secrets = spans.filter(F.col("kind") != MODEL_KIND)
    made = rows.sparkSession.createDataFrame([(k,) for k in made_keys()], "value string")
    random = secrets.select("value").union(made).select("value", F.lit(1).alias("label"), F.lit(1).cast("bigint").alias("times"))
    cuts = secrets.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    # Written, so that Spark knows its size; most texts have no span.
    cuts = write_and_read(cuts, "cuts")
    rest = rows.join(cuts, "__row", "left").select(
        F.when(F.col("__cuts").isNull(), F.col("__text")).otherwise(outside(F.col("__text"), F.col("__cuts"))).alias("__text")
    )
    words = rest.select(F.explode(F.regexp_extract_all("__text", F.lit(ORDINARY), F.lit(0))).alias("value"))
    ordinary = words.groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    return random.union(ordinary.select("value", F.lit(0).alias("label"), "times"))


def scan_secrets(docs: DataFrame, key: str, text: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``__row``, ``key``, ``spans``: for every row, an array of ``start``, ``order``, ``kind``, ``end``, sorted.

    Rows are told apart by their place in the stored table.
    """
    rows = stored_rows(docs).select(
        "__row",
        F.col(key).alias("__key"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
    )
    spans = write_and_read(found_spans(rows), "spans")
    counts = count_pairs(own_samples(rows, spans), "value", "label", "times")
    ratio = log_ratio(F.col("value"), ratios_of(counts)) + own_weight(F.col("value"), counts)
    fixed = spans.filter(F.col("kind") != MODEL_KIND)
    likely = spans.filter(F.col("kind") == MODEL_KIND).filter(ratio >= least_ratio)
    taken = fixed.select(F.col("__row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    overlap = (F.col("__row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))
    kept = fixed.union(likely.join(taken, overlap, "left_anti"))
    listed = kept.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    return rows.select("__row", "__key").join(listed, "__row", "left").select(
        "__row", F.col("__key").alias(key), F.coalesce("spans", empty).alias("spans")
    )


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
