"""Words, byte-pair training, encoding and decoding, as checkable queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import clean_text
from lexloom.operators import bpe_encoding as enc
from lexloom.operators import bpe_training as bpe
from lexloom.operators import tokenizer as tk
from lexloom.plans import sql
from lexloom.plans.packing_queries import listed
from lexloom.plans.registry import query, spread, table
from lexloom.session import new_stage_path
from lexloom.sources import readers, stages

VOCAB_SIZE, MIN_FREQUENCY = 300, 10
# What a real corpus takes: the size that the reference's training script asks for.
FULL_VOCAB_SIZE, MAX_TOKEN_LENGTH = 20_000, 20
FIRST_MERGED = bpe.FIRST_MERGED

WORD_RE = f"'{tk.WORD_PATTERN}'"


def marked(expr: str) -> str:
    w = tk.WORD_START
    text = f"replace({expr}, ' ', '{w}')"
    return f"case when {expr} = '' or starts_with({text}, '{w}') then {text} else '{w}' || {text} end"


WORDS_SQL = f"""texts as materialized (select doc_id, {sql.clean('text')} as t from documents),
doc_words as materialized (select doc_id, regexp_extract_all({marked('t')}, {WORD_RE}) as ws from texts),
words as materialized (select word, count(*) as cnt from (select unnest(ws) as word from doc_words) group by word)"""

ALPHABET_CTES = f"""characters as materialized (select distinct unnest(string_split(word, '')) as ch from words),
alphabet as materialized (
  select row_number() over (order by unicode(ch)) + {len(tk.TRAINED_SPECIALS) - 1} as id, ch as token from characters)"""
ALPHABET_SQL = f"{WORDS_SQL},\n{ALPHABET_CTES}"


def symbol_pairs(syms: str) -> str:
    return f"unnest(list_zip(string_split(trim({syms}), '  ')[:-2], string_split(trim({syms}), '  ')[2:]))"


def trained_sql(more_ctes: str = "", more_words: str | None = None, words: str = WORDS_SQL) -> str:
    """One merge per step; a merged symbol is numbered above all code points.

    The state keeps a row for each word, each pair and each step, replaced where a merge changes
    it.  ``more_words`` (of one column ``word``) are merged too, but not counted.
    """
    extra = f"union all select word, 0 from ({more_words}) where word not in (select word from words) group by word" if more_words else ""
    room = f"{VOCAB_SIZE} - {len(tk.TRAINED_SPECIALS)} - (select count(*) from alphabet)"
    pair = "' ' || b.l || '  ' || b.r || ' '"
    return f"""with recursive {words},
{ALPHABET_CTES},
{more_ctes}
all_words as materialized (
  select word, cnt, array_to_string(list_transform(string_split(word, ''), lambda c: ' ' || unicode(c) || ' '), '') as syms
  from (select word, cnt from words {extra})),
state(kind, id, cnt, l, r, syms) using key (kind, id) as (
  select 'word' as kind, word as id, cnt::bigint as cnt, 0 as l, 0 as r, syms from all_words
  union
  select 'pair', p[1] || ' ' || p[2], sum(cnt)::bigint, p[1]::int, p[2]::int, '' from (
    select {symbol_pairs('syms')} as p, cnt from all_words where cnt > 0) group by p
  union
  select * from (
    with b as materialized (
      select l, r, step from (
        select l, r from recurring.state where kind = 'pair' and cnt >= {MIN_FREQUENCY} order by cnt desc, l, r limit 1),
        (select count(*) as step from recurring.state where kind = 'step') where step < {room}),
    changed as materialized (
      select s.id, s.cnt, s.syms as old, replace(s.syms, {pair}, ' ' || ({FIRST_MERGED} + b.step) || ' ') as new
      from recurring.state s, b where s.kind = 'word' and contains(s.syms, {pair}))
    select 'word', id, cnt, 0, 0, new from changed
    union all
    select 'pair', d.id, (d.n + coalesce(o.cnt, 0))::bigint, d.l, d.r, '' from (
      select p[1] || ' ' || p[2] as id, p[1]::int as l, p[2]::int as r, sum(cnt) as n from (
        select {symbol_pairs('old')} as p, -cnt as cnt from changed where cnt > 0
        union all
        select {symbol_pairs('new')} as p, cnt from changed where cnt > 0) group by p) d
      left join (select id, cnt from recurring.state where kind = 'pair') o on o.id = d.id
    union all
    select 'step', step::varchar, step + 1, l, r, '' from b)),
steps as materialized (select cnt as step, l, r from state where kind = 'step'),
learned as (
  select 0 as step, []::varchar[] as tokens
  union all
  select t.step + 1, list_append(t.tokens,
    (case when s.l < {FIRST_MERGED} then chr(s.l) else t.tokens[s.l - {FIRST_MERGED} + 1] end) ||
    (case when s.r < {FIRST_MERGED} then chr(s.r) else t.tokens[s.r - {FIRST_MERGED} + 1] end))
  from learned t join steps s on s.step = t.step + 1),
merged as materialized (select tokens from learned order by step desc limit 1),
vocab as materialized (
  select id, token, true as is_special from (
    select unnest({list(tk.TRAINED_SPECIALS)}) as token, unnest(range({len(tk.TRAINED_SPECIALS)})) as id)
  union all select id, token, false from alphabet
  union all select {len(tk.TRAINED_SPECIALS)} + (select count(*) from alphabet) + i, token, false
    from (select unnest(tokens) as token, unnest(range(len(tokens))) as i from merged)
  union all select {len(tk.TRAINED_SPECIALS)} + (select count(*) from alphabet) + (select len(tokens) from merged),
    '{tk.EOS}', true),
word_ids as materialized (
  select word, list(case when c < {FIRST_MERGED} then coalesce(id, 0)
      else {len(tk.TRAINED_SPECIALS)} + (select count(*) from alphabet) + c - {FIRST_MERGED} end order by i) as ids
  from (select word, unnest(string_split(trim(syms), '  ')::int[]) as c,
               unnest(range(len(string_split(trim(syms), '  ')))) as i
        from (select id as word, syms from state where kind = 'word'))
    left join (select id, unicode(token) as code from alphabet) on code = c
  group by word)
"""


TRAINED_SQL = trained_sql()


def full_size_sql() -> str:
    """The replay for a vocabulary of the full size, where tokens grow to the longest allowed and may be made twice.

    The state keeps the token of each pair and a row for each token made; one made once more keeps its number.
    """
    room = f"{FULL_VOCAB_SIZE} - {len(tk.TRAINED_SPECIALS)} - (select count(*) from alphabet)"
    pair = "' ' || b.l || '  ' || b.r || ' '"

    def text(code: str, known: str) -> str:
        return f"case when {code} < {FIRST_MERGED} then chr({code}) else {known}.syms end"

    return f"""with recursive {WORDS_SQL},
{ALPHABET_CTES},
all_words as materialized (
  select word, cnt, array_to_string(list_transform(string_split(word, ''), lambda c: ' ' || unicode(c) || ' '), '') as syms from words),
state(kind, id, cnt, l, r, syms) using key (kind, id) as (
  select 'word' as kind, word as id, cnt::bigint as cnt, 0 as l, 0 as r, syms from all_words
  union
  select 'pair', p[1] || ' ' || p[2], sum(cnt)::bigint, p[1]::int, p[2]::int, chr(p[1]::int) || chr(p[2]::int) from (
    select {symbol_pairs('syms')} as p, cnt from all_words) group by p
  union
  select * from (
    with best as materialized (
      select l, r, syms from recurring.state
      where kind = 'pair' and cnt >= {MIN_FREQUENCY} and ((l < {FIRST_MERGED} and r < {FIRST_MERGED}) or length(syms) < {MAX_TOKEN_LENGTH})
        and (select count(*) from recurring.state where kind = 'token') < {room}
      order by cnt desc, l, r limit 1),
    tokens as materialized (select cnt::int as code, syms from recurring.state where kind = 'token'),
    b as materialized (
      select l, r, syms, coalesce((select code from tokens where tokens.syms = best.syms),
        {FIRST_MERGED} + (select count(*) from tokens))::int as code from best),
    changed as materialized (
      select s.id, s.cnt, s.syms as old, replace(s.syms, {pair}, ' ' || b.code || ' ') as new
      from recurring.state s, b where s.kind = 'word' and contains(s.syms, {pair})),
    known as materialized (select code, syms from tokens union select code, syms from b)
    select 'word', id, cnt, 0, 0, new from changed
    union all
    select 'pair', d.id, (d.n + coalesce(o.cnt, 0))::bigint, d.l, d.r, {text('d.l', 'x')} || {text('d.r', 'y')} from (
      select p[1] || ' ' || p[2] as id, p[1]::int as l, p[2]::int as r, sum(cnt) as n from (
        select {symbol_pairs('old')} as p, -cnt as cnt from changed
        union all
        select {symbol_pairs('new')} as p, cnt from changed) group by p) d
      left join (select id, cnt from recurring.state where kind = 'pair') o on o.id = d.id
      left join known x on x.code = d.l left join known y on y.code = d.r
    union all
    select 'token', code::varchar, code, l, r, syms from b))
select {len(tk.TRAINED_SPECIALS)} + (select count(*) from alphabet) + (select count(*) from state where kind = 'token') + 1 as vocab_size"""


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", clean_text(F.col("text")).alias("text"))


def word_table(spark: SparkSession, folder: str) -> DataFrame:
    return tk.count_words(cleaned(spark, folder), "text", ascii_only=True)


_TRAINED: dict[tuple[str, int], tk.Tokenizer] = {}


def trained(spark: SparkSession, folder: str, again: bool = False, vocab_size: int = VOCAB_SIZE) -> tk.Tokenizer:
    """The tokenizer of a folder, learned from all its documents.

    The queries of the vocabulary, its size and the merges learn it each time; those that use a
    tokenizer take the one learned last in this process.
    """
    if again or (folder, vocab_size) not in _TRAINED:
        tok = bpe.train_bpe(word_table(spark, folder), vocab_size, MIN_FREQUENCY, max_token_length=MAX_TOKEN_LENGTH)
        _TRAINED[folder, vocab_size] = tok.with_specials()
    return _TRAINED[folder, vocab_size]


@query("normalize_text", f"select doc_id, {sql.clean('text')} as text from documents")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = cleaned(spark, folder)
    return rows.select("doc_id", tk.normalize(F.upper("text")).alias("text"))


@query(
    "split_words",
    f"""select doc_id, array_to_string(regexp_extract_all({marked('lower(text)')}, {WORD_RE}), '¦') as words
        from documents""",
)
def split_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(tk.split_words(tk.normalize(F.col("text"), True)), "¦").alias("words"))


@query("word_counts", f"with {WORDS_SQL} select word, cnt from words")
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return word_table(spark, folder)


@query("initial_alphabet", f"with {ALPHABET_SQL} select id, token from alphabet")
def initial_alphabet(spark: SparkSession, folder: str) -> DataFrame:
    return tk.initial_alphabet(word_table(spark, folder)).select(F.col("id").cast("bigint").alias("id"), "token")


PAIRS_SQL = f"""with {WORDS_SQL},
pairs as materialized (
  select p[1] as l, p[2] as r, sum(cnt)::bigint as n from (
    select unnest(list_zip(x[:-2], x[2:])) as p, cnt
    from (select list_transform(string_split(word, ''), lambda c: unicode(c)) as x, cnt from words) where len(x) > 1)
  group by 1, 2)"""


@query("pair_counts", f"{PAIRS_SQL} select l, r, n from pairs")
def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    state = word_table(spark, folder).select(bpe.as_symbols(F.col("word")).alias("symbols"), "cnt")
    pairs = bpe.count_pairs(state)
    return pairs.select(F.col("a").alias("l"), F.col("b").alias("r"), "n")


@query(
    "merge_step",
    f"""{PAIRS_SQL}, best as materialized (select l, r from pairs order by n desc, l, r limit 1)
    select word, replace(
      array_to_string(list_transform(string_split(word, ''), lambda c: ' ' || unicode(c) || ' '), ''),
      ' ' || l || '  ' || r || ' ', ' {FIRST_MERGED} ') as symbols
    from words, best""",
)
def merge_step(spark: SparkSession, folder: str) -> DataFrame:
    """The first merge, on every word."""
    state = word_table(spark, folder).select("word", bpe.as_symbols(F.col("word")).alias("symbols"), "cnt")
    pairs = bpe.count_pairs(state)
    best = pairs.orderBy(F.desc("n"), "a", "b").first()
    return state.select("word", bpe.merge_symbols(F.col("symbols"), best.a, best.b, FIRST_MERGED).alias("symbols"))


@query("bpe_vocab", TRAINED_SQL + "select id::bigint as id, token, is_special from vocab")
def bpe_vocab(spark: SparkSession, folder: str) -> DataFrame:
    vocab = trained(spark, folder, again=True).vocab_table(spark)
    return vocab.select(F.col("id").cast("bigint").alias("id"), "token", "is_special")


@query(
    "bpe_merges",
    TRAINED_SQL
    + f"""select step - 1 as rank, case when l < {FIRST_MERGED} then chr(l) else tokens[l - {FIRST_MERGED} + 1] end as left_token,
      case when r < {FIRST_MERGED} then chr(r) else tokens[r - {FIRST_MERGED} + 1] end as right_token
    from steps, merged""",
)
def bpe_merges(spark: SparkSession, folder: str) -> DataFrame:
    merges = trained(spark, folder, again=True).merges_table(spark)
    return merges.select("rank", F.col("left").alias("left_token"), F.col("right").alias("right_token"))


@query("vocab_size", full_size_sql())
def vocab_size(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens a training to the full size gives: fewer where no pair is frequent enough any more."""
    return tk.vocab_size(trained(spark, folder, again=True, vocab_size=FULL_VOCAB_SIZE).vocab_table(spark))


@query("stored_tokenizer", TRAINED_SQL + "select id::bigint as id, token, is_special from vocab")
def stored_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Saved, loaded, and made into a table again."""
    path = new_stage_path(spark, "tokenizer")
    stages.save_tokenizer(spark, trained(spark, folder), path)
    vocab = stages.load_tokenizer(spark, path).vocab_table(spark)
    return vocab.select(F.col("id").cast("bigint").alias("id"), "token", "is_special")


LINE_WORDS_SQL = f"""lines as materialized (select lower(unnest(string_split(text, chr(10)))) as t from documents),
words as materialized (
  select word, count(*) as cnt from (select unnest(regexp_extract_all({marked('t')}, {WORD_RE})) as word from lines) group by word)"""


@query(
    "vocab_from_lines",
    trained_sql(words=LINE_WORDS_SQL) + "select id::bigint as id, token, is_special from vocab where token <> '[EOS]'",
)
def vocab_from_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A vocabulary straight from text files, each line a text."""
    path = new_stage_path(spark, "lines")
    table(spark, folder, "documents").select("text").write.option("lineSep", "\n").text(path)
    words = tk.count_words(readers.read_lines(spark, path), "text", ascii_only=True)
    vocab = bpe.train_bpe(words, VOCAB_SIZE, MIN_FREQUENCY).vocab_table(spark)
    return vocab.select(F.col("id").cast("bigint").alias("id"), "token", "is_special")


ENCODED_SQL = """occurrences as (
  select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from doc_words),
encoded as (
  select o.doc_id, flatten(list(w.ids order by o.i)) as ids
  from occurrences o join word_ids w using (word) group by o.doc_id)
"""


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    return enc.encode(cleaned(spark, folder), "doc_id", "text", trained(spark, folder), ascii_only=True)


@query(
    "encode_documents",
    TRAINED_SQL.rstrip() + ",\n" + ENCODED_SQL
    + """select d.doc_id, coalesce(array_to_string(ids, ','), '') as ids, coalesce(len(ids), 0)::bigint as length,
      coalesce(len(ids), 0)::bigint as mask_sum, 0::bigint as type_sum
    from documents d left join encoded using (doc_id)""",
)
def encode_documents(spark: SparkSession, folder: str) -> DataFrame:
    def total(c: str):
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, i: a + i)

    return encoded(spark, folder).select(
        "doc_id",
        listed("input_ids").alias("ids"),
        F.col("length").cast("bigint").alias("length"),
        total("attention_mask").alias("mask_sum"),
        total("token_type_ids").alias("type_sum"),
    )


@query("decode_round_trip", f"select doc_id, {sql.clean('text')} as text from documents")
def decode_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(spark, folder).select(
        "doc_id", enc.decode(F.col("input_ids"), trained(spark, folder)).alias("text")
    )


FEW = "abcdefghijklm"
N_SPECIAL = len(tk.TRAINED_SPECIALS)


@query(
    "unknown_characters",
    f"""with {WORDS_SQL},
    occurrences as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from doc_words),
    encoded as (
      select doc_id, flatten(list(list_transform(string_split(word, ''), lambda c:
        case when c = '{tk.WORD_START}' then {N_SPECIAL + len(FEW)}
             when contains('{FEW}', c) then unicode(c) - unicode('a') + {N_SPECIAL} else 0 end) order by i)) as ids
      from occurrences group by doc_id)
    select d.doc_id, coalesce(array_to_string(ids, ','), '') as ids from documents d left join encoded using (doc_id)""",
)
def unknown_characters(spark: SparkSession, folder: str) -> DataFrame:
    """An alphabet of few characters and no merges; every other one is unknown by itself."""
    tok = tk.Tokenizer((*tk.TRAINED_SPECIALS, *FEW, tk.WORD_START), frozenset(tk.TRAINED_SPECIALS), ())
    rows = enc.encode(cleaned(spark, folder), "doc_id", "text", tok, ascii_only=True, common_words=2)
    return rows.select("doc_id", listed("input_ids").alias("ids"))
