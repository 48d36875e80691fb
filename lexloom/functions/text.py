"""Text cleaning as column expressions; every rule stays inside whole-stage codegen.

The composed cleaner folds rules that have the same effect.  Astral characters,
symbols and everything outside the allow-list all become one space each, so one
replacement does for the three; after it the text is ASCII, on which Java's
``\\b``, ``\\d`` and ``\\S`` mean what other regex engines mean by them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and placeholders of the cleaning rules.
HTML_TAG = r"<[^>]*>"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
SYMBOL_OTHER = r"\p{So}"
# All but these and a newline, which is replaced.  Each is named by itself: Java looks such a set up
# in a table, and searches through one of ranges at each character.
ALLOWED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ,.!?'\""
NOT_ALLOWED = rf"[^{ALLOWED}\n\-]"
# A digit is looked for first, and only there whether a word begins with it.
FIRST_DIGIT = r"\d(?<=\b\d)"
PHONE_TEN_DIGITS = FIRST_DIGIT + r"\d{9}\b"
PHONE_DASHED = FIRST_DIGIT + r"\d{2}-\d{3}-\d{4}\b"
PHONE_OF_TEN = FIRST_DIGIT + r"(?:\d{9}|\d{2}-\d{3}-\d{4})\b"
PHONE_INTERNATIONAL = r"\+\d{1,3}\s?\d{1,14}"
EMAIL = r"\S+@\S+"
URL = r"[hw](?:(?<=h)ttp|(?<=w)ww)\S+"
BYTES_LITERAL = r"(?d)b'(.*?)'"
CONTROL = r"[\x00-\x1f]"
NUMBER = FIRST_DIGIT + r"\d*\b"
SPACES = r" {2,}"
# Control characters as spaces, and runs of both as one; a single space is left where it stands.
BLANKS = r"[\x00-\x20](?:[\x00-\x20]+|(?<! ))"
HTML_MARK = "[HTML]"
PHONE_MARK = "[Phone Number]"
EMAIL_MARK = "[Email]"
URL_MARK = "[URL]"
NUMBER_MARK = "[Number]"

# Stand-ins for placeholders while the allow-list runs: private-use characters,
# which cannot be in the text by then.
_HELD = {"\ue000": HTML_MARK, "\ue001": PHONE_MARK, "\ue002": EMAIL_MARK, "\ue003": URL_MARK}
_HTML_HELD, _PHONE_HELD, _EMAIL_HELD, _URL_HELD = _HELD
NOT_PRINTABLE_ASCII = r"[^\n -~]"
NOT_ALLOWED_OR_HELD = r"[\x00-\x09\x0B-\x1F#-&(-+/:->@\x5B-\x60\x7B-\x{DFFF}\x{E004}-\x{10FFFF}]"
NOT_ALLOWED_KEEP_PLUS_AT = r"[\x00-\x09\x0B-\x1F#-&(-*/:->\x5B-\x60\x7B-\x{10FFFF}]"


def _sub(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(replacement))


def mark_html(col: Column) -> Column:
    return _sub(col, HTML_TAG, HTML_MARK)


def blank_astral(col: Column) -> Column:
    return _sub(col, ASTRAL, " ")


def blank_symbols(col: Column) -> Column:
    return _sub(col, SYMBOL_OTHER, " ")


def allow_list(col: Column, keep_plus_and_at: bool = False) -> Column:
    """One space for each character outside the allow-list; newlines stay."""
    return _sub(col, NOT_ALLOWED_KEEP_PLUS_AT if keep_plus_and_at else NOT_ALLOWED, " ")


def mark_ten_digit_phone(col: Column) -> Column:
    return _sub(col, PHONE_TEN_DIGITS, PHONE_MARK)


def mark_dashed_phone(col: Column) -> Column:
    return _sub(col, PHONE_DASHED, PHONE_MARK)


def mark_international_phone(col: Column) -> Column:
    return _sub(col, PHONE_INTERNATIONAL, PHONE_MARK)


def mark_email(col: Column) -> Column:
    return _sub(col, EMAIL, EMAIL_MARK)


def mark_url(col: Column) -> Column:
    return _sub(col, URL, URL_MARK)


def blank_bytes_literal(col: Column) -> Column:
    return _sub(col, BYTES_LITERAL, " ")


def blank_control(col: Column) -> Column:
    return _sub(col, CONTROL, " ")


def blank_newline(col: Column) -> Column:
    return F.replace(col, F.lit("\n"), F.lit(" "))


def strip_ends(col: Column) -> Column:
    return F.trim(col)


def mark_number(col: Column) -> Column:
    return _sub(col, NUMBER, NUMBER_MARK)


def collapse_spaces(col: Column) -> Column:
    return _sub(col, SPACES, " ")


def lowercase(col: Column) -> Column:
    return F.lower(col)


def _finish(col: Column) -> Column:
    # ``blank_control`` and ``collapse_spaces`` in one pass: a number's mark holds no space.
    return mark_number(strip_ends(_sub(blank_bytes_literal(col), BLANKS, " ")))


def clean_text(col: Column, mask_first: bool = False) -> Column:
    """The whole chain of rules.

    By default the allow-list runs before the masking rules, so e-mail addresses
    and international numbers have already lost their ``@`` and ``+`` and are
    never masked.  ``mask_first`` masks before the allow-list and keeps the
    brackets of the placeholders.
    """
    if not mask_first:
        col = allow_list(mark_html(col))
        # Both phone rules in one pass: no number is part of the other.
        col = mark_url(_sub(col, PHONE_OF_TEN, PHONE_MARK))
        return lowercase(_finish(col))
    # Private-use characters of the input go first, so only ours are left.
    col = _sub(col, NOT_PRINTABLE_ASCII, " ")
    for pattern, held in (
        (HTML_TAG, _HTML_HELD),
        (PHONE_TEN_DIGITS, _PHONE_HELD),
        (PHONE_DASHED, _PHONE_HELD),
        (PHONE_INTERNATIONAL, _PHONE_HELD),
        (EMAIL, _EMAIL_HELD),
        (URL, _URL_HELD),
        (NOT_ALLOWED_OR_HELD, " "),
    ):
        col = _sub(col, pattern, held)
    col = _finish(col)
    for held, mark in _HELD.items():
        col = F.replace(col, F.lit(held), F.lit(mark))
    return lowercase(col)
