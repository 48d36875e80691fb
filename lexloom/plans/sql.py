"""Pieces of oracle SQL that many queries share."""

from __future__ import annotations

def replace_all(expr: str, pattern: str, replacement: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({expr}, '{quoted}', '{replacement}', 'g')"


def allowed(expr: str) -> str:
    return replace_all(expr, "[^a-zA-Z0-9\\n,.!?'\"-]", " ")


def allowed_keep_plus_at(expr: str) -> str:
    return replace_all(expr, "[^a-zA-Z0-9\\n,.!?'\"+@-]", " ")


def clean(expr: str) -> str:
    expr = replace_all(expr, "<[^>]*>", "[HTML]")
    expr = allowed(expr)
    expr = replace_all(expr, r"\b\d{10}\b", "[Phone Number]")
    expr = replace_all(expr, r"\b\d{3}-\d{3}-\d{4}\b", "[Phone Number]")
    expr = replace_all(expr, r"http\S+|www\S+", "[URL]")
    expr = replace_all(expr, r"b'(.*?)'", " ")
    expr = replace_all(expr, r"[\x00-\x1f]", " ")
    expr = replace_all(f"trim({expr})", r"\b\d+\b", "[Number]")
    return f"lower({replace_all(expr, ' +', ' ')})"


HELD = {"": "[HTML]", "": "[Phone Number]", "": "[Email]", "": "[URL]"}


def clean_mask_first(expr: str) -> str:
    html, phone, email, url = HELD
    expr = replace_all(expr, r"[^\n -~]", " ")
    expr = replace_all(expr, "<[^>]*>", html)
    expr = replace_all(expr, r"\b\d{10}\b", phone)
    expr = replace_all(expr, r"\b\d{3}-\d{3}-\d{4}\b", phone)
    expr = replace_all(expr, r"\+\d{1,3}\s?\d{1,14}", phone)
    expr = replace_all(expr, r"\S+@\S+", email)
    expr = replace_all(expr, r"http\S+|www\S+", url)
    expr = replace_all(expr, f"[^a-zA-Z0-9\\n,.!?'\"{html}{phone}{email}{url}-]", " ")
    expr = replace_all(expr, r"b'(.*?)'", " ")
    expr = replace_all(expr, r"[\x00-\x1f]", " ")
    expr = replace_all(f"trim({expr})", r"\b\d+\b", "[Number]")
    expr = replace_all(expr, " +", " ")
    for held, mark in HELD.items():
        expr = f"replace({expr}, '{held}', '{mark}')"
    return f"lower({expr})"


# Integer ids that both engines can make: a number for each word of the cleaned text.
IDS = f"""ids as (
  select doc_id, list_transform(
    list_filter(string_split({clean('text')}, ' '), lambda w: w <> ''),
    lambda w: ((ascii(w) * 131 + length(w) * 17) % 997 + 5)::integer) as ids
  from documents)"""

TOKENS = f"""{IDS},
tokens as (
  select doc_id, unnest(ids) as id, unnest(range(len(ids))) as i from ids)"""


def batches(source: str, key: str, shards: int, size: int) -> str:
    """A CTE ``batched``: shard, batch_id, pos_in_batch of each row of ``source``."""
    return f"""positioned as (
  select *, row_number() over (order by {key}) - 1 as pos, count(*) over () as n from {source}),
sharded as (
  select *, case when pos < (n % {shards}) * (n // {shards} + 1) then pos // (n // {shards} + 1)
                 else (pos - n % {shards}) // (n // {shards}) end as shard from positioned),
in_shard as (
  select *, row_number() over (partition by shard order by pos) - 1 as nth from sharded),
batched as (
  select *, dense_rank() over (order by shard, nth // {size}) - 1 as batch_id, nth % {size} as pos_in_batch
  from in_shard)"""


def permuted(source: str, key: str, seed: int) -> str:
    return f"""permuted as (
  select *, row_number() over (order by md5('{seed}|' || {key}), {key}) - 1 as perm_pos from {source})"""
