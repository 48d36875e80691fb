"""The registered queries of the subpackage, one for each operator, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import (
    compression_rules,
    decontamination,
    hard_negatives,
    interpolation_lm,
    license_templates,
    mixing,
    order_minhash,
    secret_scan,
    sharding,
    spelling_variants,
    token_files,
    tool_calls,
    url_filter,
)
from lexloom.llm.common import query, table
from lexloom.session import new_stage_path


def _terms_sql(terms) -> str:
    return ", ".join(f"('{t}')" for t in terms)


OP1_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, v) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in url_filter.RULES)}),
strict(t) AS (VALUES {_terms_sql(url_filter.STRICT_TERMS)}),
soft(t) AS (VALUES {_terms_sql(url_filter.SOFT_TERMS)}),
judged AS (
  SELECT *,
    (SELECT max_by(rule, length(rule)) FROM rules
     WHERE ends_with('.' || host, '.' || split_part(rule, '/', 1))
       AND starts_with(path, substr(rule, strpos(rule, '/')))) AS rule,
    (SELECT coalesce(list(t ORDER BY t), []) FROM strict
     WHERE regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')) AS strict_terms,
    (SELECT coalesce(list(t ORDER BY t), []) FROM soft
     WHERE regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')) AS soft_terms
  FROM p)
SELECT page_id, host, path, rule,
  coalesce((SELECT v FROM rules r WHERE r.rule = judged.rule),
    CASE WHEN len(strict_terms) >= 1 OR len(soft_terms) >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  strict_terms, soft_terms
FROM judged
"""


@query("op1_url_filter", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url")


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_stage_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    model = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.document_digests(token_files.write_token_files(docs, "doc_id", "text", folder, model))


SHARDS = 16


@query("op4_feistel_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )


@query("op9_compression_bands")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = compression_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "quality.*")


@query("op10_entropy_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id")


@query("op3_order_minhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = order_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"), "doc_id")
    return classes.select("doc_id", "class_id", "n_links")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
  SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(any_value(n) AS INTEGER) AS n_item,
  count(*) / any_value(n) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
"""


@query("op8_containment", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text"
    )
    return found.select("doc_id", F.col("item").alias("item_id"), "n_shared", "n_item", "containment")


@query("op6_markov_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), "doc_id")
    kinds = [p[0] for p in secret_scan.PATTERNS]
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in kinds],
        F.sha2(secret_scan.joined_spans(base), 256).alias("base_sha256"),
        secret_scan.joined_spans(F.col("spans")).alias("spans"),
        of_kind(secret_scan.MODEL_KIND).alias("n_markov"),
    )


TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "exact": ("boolean", False)},
    "summarize": {"text": ("string", True), "ratio": ("number", True)},
    "convert": {"values": ("array", True), "options": ("object", False)},
}


def derived_calls(turns: DataFrame) -> DataFrame:
    """Calls as assistants' turns make them, derived from the given conversations: the tool, the
    defects of the arguments and the dependencies follow from turn number and text length.

    Arguments hold the whole text.  A call depends on the one before it in its conversation,
    some also on one that is not there; in one conversation of 16 some also depend on the
    call after them, and so stand on a cycle; in another one some have no identifier."""
    text, size = "coalesce(text, '')", "coalesce(length(text), 0)"
    call = lambda turn: f"concat('call-', conv_id, '-', {turn})"
    none = "cast(array() AS array<string>)"
    return turns.filter("role = 'assistant'").selectExpr(
        "conv_id AS conv",
        f"CASE WHEN conv_id % 16 = 5 AND {size} % 7 = 0 THEN NULL ELSE {call('turn')} END AS id",
        "turn AS position",
        "CASE turn % 6 WHEN 1 THEN 'search' WHEN 3 THEN 'summarize' ELSE 'convert' END AS name",
        f"""CASE turn % 6
          WHEN 1 THEN CASE WHEN {size} % 7 = 0 THEN to_json(named_struct('query', {text}, 'limit', 'ten'), map('pretty', 'true'))
            ELSE to_json(named_struct('query', {text}, 'limit', {size}), map('pretty', 'true')) END
          WHEN 3 THEN CASE WHEN {size} % 5 = 0 THEN to_json(named_struct('text', {text}))
            ELSE to_json(named_struct('text', {text}, 'ratio', 0.5)) END
          ELSE CASE WHEN {size} % 3 = 0
            THEN to_json(named_struct('values', array(turn, {size}), 'options', named_struct('text', {text}), 'added', 1))
            ELSE to_json(named_struct('values', array(turn, {size}), 'options', named_struct('text', {text}))) END
          END AS arguments""",
        f"""concat(
          CASE WHEN turn > 2 THEN array({call('turn - 2')}) ELSE {none} END,
          CASE WHEN {size} % 11 = 0 THEN array({call("'none'")}) ELSE {none} END,
          CASE WHEN conv_id % 16 = 3 AND {size} % 3 = 0 THEN array({call('turn + 2')}) ELSE {none} END) AS depends_on""",
    )


def derived_results(turns: DataFrame) -> DataFrame:
    """A user's turn answers the turn before it."""
    return turns.filter("role = 'user' AND turn > 0").selectExpr(
        "conv_id AS conv", "concat('call-', conv_id, '-', turn - 1) AS id", "turn AS position", "text AS content"
    )


@query("op7_tool_calls")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    linked = tool_calls.link_calls(derived_calls(turns), derived_results(turns), TOOLS)
    return linked.withColumnRenamed("conv", "conv_id").withColumnRenamed("id", "call_id")


@query("op5_deleted_interpolation")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation_lm.score_documents(table(spark, sf_dir, "documents"), "doc_id")


@query("op11_spelling_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"), "doc_id")


OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""


@query("op12_kronecker_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives.mine_hard_negatives(rows, "vec_id % 100 = 0")


def _template_pattern(template: str) -> str:
    """A template as a regular expression over words that each have a space behind them."""
    out = ""
    for piece in re.split("(<<[^>]*>>)", template):
        if not piece.startswith("<<"):
            out += "".join(f"{w} " for w in license_templates.words_of(piece))
        elif piece.startswith("<<any"):
            out += "(?:[^ ]+ ){%s,%s}" % tuple(piece[6:-2].split("-"))
        else:
            out += {"<<optional>>": "(?:", "<</optional>>": ")?", "<<choice>>": "(?:", "<<or>>": "|", "<</choice>>": ")"}[piece]
    return out


def _phrase_places_sql() -> str:
    """Places (from 0) of all phrases in the words ``w``, and the labels found."""
    tests = []
    for phrase, label in license_templates.PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))
        tests.append(f"(SELECT list({{'at': i, 'label': '{label}'}}) FROM range(len(w) - {len(words) - 1}) r(i) WHERE {same})")
    return "list_concat(" + ", ".join(f"coalesce({t}, [])" for t in tests) + ")"


OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{license_templates.WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, {_phrase_places_sql()} AS p, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
l AS (SELECT *, list_sort(list_distinct(list_transform(p, lambda x: x.label))) AS base,
  list_filter([{", ".join(f"CASE WHEN regexp_matches(t, ' {_template_pattern(v)}') THEN '{k}' END" for k, v in license_templates.TEMPLATES.items())}],
    lambda x: x IS NOT NULL) AS own FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
  list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""


@query("op13_license_templates", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_templates.scan_licenses(table(spark, sf_dir, "documents"), "doc_id")
    return found.drop("spans").withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
