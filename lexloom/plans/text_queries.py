"""Cleaning rules, one by one and composed, as checkable queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as rules
from lexloom.functions.nested import map_strings
from lexloom.plans import sql
from lexloom.plans.registry import query, spread, table

DOCUMENTS = ("documents", "doc_id", "text")
PAGES = ("pages", "page_id", "html")


def rule(name: str, source: tuple[str, str, str], func: Callable[[Column], Column], oracle: str, derived: str = "") -> None:
    """One rule on the whole of one text column; ``oracle`` is SQL with ``{}`` for the text.

    ``derived`` is SQL that both engines read: the text with something added that the
    given tables do not hold.
    """
    name_of_table, key, text = source
    derived = derived or text

    def plan(spark: SparkSession, folder: str) -> DataFrame:
        rows = spread(table(spark, folder, name_of_table).select(key, text))
        return rows.select(key, func(F.expr(derived)).alias("text"))

    from_rows = f"(select {key}, {derived} as {text} from {name_of_table})"
    query(name, f"select {key}, {oracle.replace('{}', text)} as text from {from_rows}")(plan)


# Characters, numbers and literals that no page or document of the tables holds.
WITH_ASTRAL = "concat(html, case page_id % 4 when 0 then ' 😀x' when 1 then '𝄞' when 2 then ' plain' else ' 🚀🚀.' end)"
WITH_SYMBOLS = "concat(html, case page_id % 4 when 0 then ' ©x' when 1 then '☀' when 2 then ' → + €' else ' 21°♥' end)"
WITH_DASHED_PHONE = """concat(html, ' call 555-', lpad(cast(page_id % 1000 as string), 3, '0'), '-',
  lpad(cast(page_id * 7 % 10000 as string), 4, '0'), case page_id % 3 when 0 then '9' else ' now' end)"""
WITH_INTERNATIONAL_PHONE = """concat(text, ' +', cast(doc_id % 900 as string), ' ', cast(doc_id * 7919 as string),
  case doc_id % 3 when 0 then ' or +x' else '+12' end)"""
WITH_BYTES_LITERAL = """concat(html, ' b''raw ', cast(page_id as string), ''' and Bob''s dog''s b''a', chr(10), 'c''')"""


ALLOWED = sql.allowed("{}")
LOOSE = sql.allowed_keep_plus_at("{}")


def after_allow_list(func: Callable[[Column], Column], keep: bool = False) -> Callable[[Column], Column]:
    return lambda c: func(rules.allow_list(c, keep))


rule("html_tags", PAGES, rules.mark_html, sql.replace_all("{}", "<[^>]*>", "[HTML]"))
rule("astral_characters", PAGES, rules.blank_astral, sql.replace_all("{}", r"[\x{10000}-\x{10FFFF}]", " "), WITH_ASTRAL)
rule("symbol_characters", PAGES, rules.blank_symbols, sql.replace_all("{}", r"\p{So}", " "), WITH_SYMBOLS)
rule("allow_list", DOCUMENTS, rules.allow_list, ALLOWED)
rule(
    "phone_ten_digits",
    PAGES,
    after_allow_list(rules.mark_ten_digit_phone),
    sql.replace_all(ALLOWED, r"\b\d{10}\b", "[Phone Number]"),
)
rule(
    "phone_dashed",
    PAGES,
    after_allow_list(rules.mark_dashed_phone),
    sql.replace_all(ALLOWED, r"\b\d{3}-\d{3}-\d{4}\b", "[Phone Number]"),
    WITH_DASHED_PHONE,
)
rule(
    "phone_international",
    DOCUMENTS,
    after_allow_list(rules.mark_international_phone, True),
    sql.replace_all(LOOSE, r"\+\d{1,3}\s?\d{1,14}", "[Phone Number]"),
    WITH_INTERNATIONAL_PHONE,
)
rule(
    "email",
    DOCUMENTS,
    after_allow_list(rules.mark_email, True),
    sql.replace_all(LOOSE, r"\S+@\S+", "[Email]"),
)
rule("url", PAGES, after_allow_list(rules.mark_url), sql.replace_all(ALLOWED, r"http\S+|www\S+", "[URL]"))
rule(
    "bytes_literal",
    PAGES,
    after_allow_list(rules.blank_bytes_literal),
    sql.replace_all(ALLOWED, r"b'(.*?)'", " "),
    WITH_BYTES_LITERAL,
)
rule(
    "control_characters",
    DOCUMENTS,
    after_allow_list(rules.blank_control),
    sql.replace_all(ALLOWED, r"[\x00-\x1f]", " "),
)
rule("newlines", DOCUMENTS, rules.blank_newline, "replace({}, chr(10), ' ')")
rule("strip_ends", DOCUMENTS, after_allow_list(rules.strip_ends), f"trim({ALLOWED})")
rule(
    "numbers",
    PAGES,
    after_allow_list(rules.mark_number),
    sql.replace_all(ALLOWED, r"\b\d+\b", "[Number]"),
)
rule(
    "collapse_spaces",
    PAGES,
    after_allow_list(rules.collapse_spaces),
    sql.replace_all(ALLOWED, " +", " "),
)
rule("lowercase", DOCUMENTS, after_allow_list(rules.lowercase), f"lower({ALLOWED})")
rule("clean_text", DOCUMENTS, rules.clean_text, sql.clean("{}"))
rule("clean_text_pages", PAGES, rules.clean_text, sql.clean("{}"))
rule("clean_text_benchmark", ("benchmark", "item_id", "text"), rules.clean_text, sql.clean("{}"))
rule("clean_text_mask_first", DOCUMENTS, lambda c: rules.clean_text(c, True), sql.clean_mask_first("{}"))
rule("clean_text_mask_first_pages", PAGES, lambda c: rules.clean_text(c, True), sql.clean_mask_first("{}"))


def nested_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn as a struct that holds strings in an array, a map and a deeper struct."""
    turns = table(spark, folder, "conversations")
    value = F.struct(
        F.col("turn").alias("turn"),
        F.struct(F.upper("role").alias("role")).alias("who"),
        F.split("text", "\n").alias("lines"),
        F.create_map(F.lit("whole"), F.col("text")).alias("named"),
    )
    return turns.select("conv_id", "turn", value.alias("value"))


@query(
    "clean_nested_strings",
    f"""select conv_id, turn, turn as inner_turn, {sql.clean('upper(role)')} as role,
               array_to_string(list_transform(string_split(text, chr(10)), lambda x: {sql.clean('x')}), '|') as lines,
               {sql.clean('text')} as whole
        from conversations""",
)
def clean_nested_strings(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested_turns(spark, folder)
    rows = rows.withColumn("value", map_strings(rows, "value", rules.clean_text))
    return rows.select(
        "conv_id",
        "turn",
        F.col("value.turn").alias("inner_turn"),
        F.col("value.who.role").alias("role"),
        F.array_join("value.lines", "|").alias("lines"),
        F.col("value.named")["whole"].alias("whole"),
    )
