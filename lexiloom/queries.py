"""The registered queries of the text-encoding operators, each with the SQL that DuckDB runs for the same rows.

All of them read whole tables. Texts become rows of tokens or pieces; arrays and structs are taken apart into columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import arrays, matching, normalize, splitters
from lexiloom.functions.codemap import BYTE_MAP, CodeMap
from lexiloom.functions.template import ConstTerm, IndexInputTerm, InputTerm, RepeatedTerm, SequenceTemplate
from lexiloom.operators import vocab as vocabulary
from lexiloom.operators.encoder import TextEncoder
from lexiloom.operators.pipeline import PipeGet, Pipeline
from lexiloom.operators.vocab import Vocab
from lexiloom.plans import tokenization as tk
from lexiloom.plans.stages import DOCUMENT, SENTENCE
from lexiloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOP_WORDS, LENGTH = 2000, 32
_BLANK = "[ \\t\\r\\n]+"
#: Words of documents in DuckDB, with their places from 1.
_WORDS = """
w0 as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1)::bigint as pos from w0)"""
_TOP = """
v as (select word, row_number() over (order by n desc, word)::bigint as idx from (select word, count(*) as n from w group by word order by n desc, word limit 2000))"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rows(df: DataFrame, items: Column, *keys: str, at: str = "pos") -> DataFrame:
    """A row for each element; the expression is exploded as it is, so it's evaluated once."""
    return df.select(*keys, F.posexplode(items).alias("_at", "item")).select(*keys, (F.col("_at") + 1).cast("long").alias(at), "item")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_docs(spark, sf), splitters.blank_words(F.col("text")), "doc_id").withColumnRenamed("item", "word")


def _top(words: DataFrame) -> Vocab:
    return Vocab.top(words, "word", TOP_WORDS)


# ---- splitting and matching ----


@query(f"with {_WORDS} select doc_id, pos, word from w")
def split_words(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.EachSplitTokenization(re.compile(_BLANK)))
    return _rows(_docs(spark, sf), t.apply(F.col("text"), SENTENCE), "doc_id").select("doc_id", "pos", F.col("item.x").alias("word"))


@query("with m as (select doc_id, regexp_extract_all(text, '[a-zA-Z]+|[0-9]+') as ms from documents) select doc_id, unnest(ms) as word, generate_subscripts(ms, 1)::bigint as pos from m")
def find_all(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.EachMatchTokenization(re.compile("[a-zA-Z]+|[0-9]+")))
    return _rows(_docs(spark, sf), t.apply(F.col("text"), SENTENCE), "doc_id").select("doc_id", F.col("item.x").alias("word"), "pos")


def _splits_sql(source: str, pattern: str, k: str) -> str:
    """Pieces of (doc_id, ..., x): gaps have odd, matches even numbers in ``k``."""
    return f"""(select * from (
  select * exclude (g, x), unnest(g) as x, generate_subscripts(g, 1) * 2 - 1 as {k}, false as ismatch from (select *, string_split_regex(x, '{pattern}') as g from {source})
  union all by name
  select * exclude (g, x), unnest(g) as x, generate_subscripts(g, 1) * 2 as {k}, true as ismatch from (select *, regexp_extract_all(x, '{pattern}') as g from {source})) where x <> '')"""


@query(f"select doc_id, row_number() over (partition by doc_id order by k)::bigint as pos, ismatch, x from {_splits_sql('(select doc_id, text as x from documents)', '[0-9]+|[.,]', 'k')}")
def match_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_docs(spark, sf), matching.matchsplits(F.col("text"), re.compile("[0-9]+|[.,]")), "doc_id").select("doc_id", "pos", "item.ismatch", "item.x")


_LEVELS = f"""
a as (select * from {_splits_sql('(select doc_id, text as x from documents)', 'th', 'k1')}),
b0 as (select doc_id, k1, x from a where not ismatch),
b as (select * from {_splits_sql('b0', 'en', 'k2')}),
c0 as (select doc_id, k1, k2, x from b where not ismatch),
c as (select * from {_splits_sql('c0', '[0-9]', 'k3')}),
pieces as (select doc_id, k1, 0 as k2, 0 as k3, ismatch, x from a where ismatch union all select doc_id, k1, k2, 0, ismatch, x from b where ismatch union all select doc_id, k1, k2, k3, ismatch, x from c)"""


@query(f"with {_LEVELS} select doc_id, row_number() over (partition by doc_id order by k1, k2, k3)::bigint as pos, ismatch, x from pieces")
def match_splits_priority(spark: SparkSession, sf: str) -> DataFrame:
    pieces = matching.matchsplits(F.col("text"), ["th", "en", re.compile("[0-9]")])
    return _rows(_docs(spark, sf), pieces, "doc_id").select("doc_id", "pos", "item.ismatch", "item.x")


@query(f"""with p as (select doc_id, k, ismatch, x from {_splits_sql('(select doc_id, text as x from documents)', '[0-9]+', 'k')}),
q as (select doc_id, k, ismatch, case when ismatch then [x] else list_filter(string_split_regex(lower(x), '[ \\t\\r\\n]+'), lambda y: y <> '') end as ws from p),
r as (select doc_id, k, ismatch, unnest(ws) as word, generate_subscripts(ws, 1) as j from q)
select doc_id, row_number() over (partition by doc_id order by k, j)::bigint as pos, ismatch, word from r""")
def match_protect_lower(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.MatchTokenization(tk.LowercaseNormalizer(tk.EachSplitTokenization(re.compile(_BLANK))), [re.compile("[0-9]+")]))
    return _rows(_docs(spark, sf), t.apply(F.col("text"), SENTENCE), "doc_id").select("doc_id", "pos", "item.ismatch", F.col("item.x").alias("word"))


@query("with p as (select page_id, regexp_extract_all(html, '<[a-z0-9]+') as ms from pages) select page_id, unnest(ms) as tag, generate_subscripts(ms, 1)::bigint as pos from p")
def find_all_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(table(spark, sf, "pages").select("page_id", "html"), matching.find_all(F.col("html"), re.compile("<[a-z0-9]+")), "page_id").select("page_id", F.col("item").alias("tag"), "pos")


@query("""with p as (select item_id, list_filter(string_split(replace(replace(text, ',', ' '), '.', ' '), ' '), lambda x: x <> '') as ws from benchmark)
select item_id, unnest(ws) as word, generate_subscripts(ws, 1)::bigint as pos from p""")
def split_characters_list(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.EachSplitTokenization((" ", ",", ".")))
    return _rows(table(spark, sf, "benchmark"), t.apply(F.col("text"), SENTENCE), "item_id").select("item_id", F.col("item.x").alias("word"), "pos")


# ---- stages, ids, batches ----

_LINES = tk.WordTokenization(splitters.newline_sentences, splitters.blank_words)
_SENTENCES = """
s0 as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as ss from documents),
s as (select doc_id, unnest(ss) as sentence, generate_subscripts(ss, 1)::bigint as sentence_id from s0),
w0 as (select doc_id, sentence_id, list_filter(string_split_regex(sentence, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from s)"""


@query(f"with {_SENTENCES} select doc_id, sentence_id, sentence from s")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_docs(spark, sf), splitters.newline_sentences(F.col("text")), "doc_id", at="sentence_id").withColumnRenamed("item", "sentence")


@query(f"""with {_SENTENCES}, w as (select doc_id, sentence_id, unnest(ws) as word, generate_subscripts(ws, 1)::bigint as word_id from w0)
select doc_id, sentence_id, word_id, word_id as token_id, word as x from w""")
def indexed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.IndexedTokenization(_LINES))
    return t.rows(_docs(spark, sf), "doc_id").select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("sentence_id", "word_id", "token_id")], "x")


@query(f"""with {_SENTENCES}, w as (select doc_id, sentence_id, unnest(ws) as word, generate_subscripts(ws, 1)::bigint as word_id from w0),
c as (select doc_id, sentence_id, word_id, unnest(string_split(word, '')) as x, generate_subscripts(string_split(word, ''), 1) as k from w)
select doc_id, sentence_id, word_id, row_number() over (partition by doc_id, sentence_id order by word_id, k)::bigint as token_id, x from c""")
def indexed_chars(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.IndexedTokenization(tk.SubwordTokenization(splitters.characters, _LINES)))
    return t.rows(_docs(spark, sf), "doc_id").select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("sentence_id", "word_id", "token_id")], "x")


@query(f"""with {_SENTENCES}, p as (select doc_id, sentence_id, k, ismatch, x from {_splits_sql('(select doc_id, sentence_id, sentence as x from s)', '[0-9]', 'k')}),
q as (select doc_id, sentence_id, k, ismatch, case when ismatch then [x] else list_filter(string_split_regex(x, '[ \\t\\r\\n]+'), lambda y: y <> '') end as ws from p),
r as (select doc_id, sentence_id, k, ismatch, unnest(ws) as x, generate_subscripts(ws, 1) as j from q)
select doc_id, sentence_id, ismatch, row_number() over (partition by doc_id, sentence_id order by k, j)::bigint as word_id, x from r""")
def indexed_matches(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.IndexedTokenization(tk.MatchTokenization(_LINES, [re.compile("[0-9]")])))
    return t.rows(_docs(spark, sf), "doc_id").select("doc_id", F.col("sentence_id").cast("long").alias("sentence_id"), "ismatch", F.col("word_id").cast("long").alias("word_id"), "x")


@query(f"with {_SENTENCES} select doc_id, count(*) as n_sentences, sum(len(ws))::bigint as n_tokens, max(len(ws))::bigint as longest from w0 group by doc_id")
def flat_vs_nested(spark: SparkSession, sf: str) -> DataFrame:
    flat, deep = tk.FlatTokenizer(_LINES).apply(F.col("text")), tk.NestedTokenizer(_LINES).apply(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(deep).cast("long").alias("n_sentences"), F.size(flat).cast("long").alias("n_tokens"), arrays.nestedmaxlength(deep, 2).cast("long").alias("longest")).where("n_sentences > 0")


@query("""with b as (select conv_id, row_number() over (partition by conv_id order by turn)::bigint as sentence_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from conversations)
select conv_id, sentence_id, unnest(ws) as x, generate_subscripts(ws, 1)::bigint as token_id from b""")
def batch_conversations(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.IndexedTokenization(_LINES))
    done = tk.tokenize_batch(table(spark, sf, "conversations"), t, "turn", stage=SENTENCE, batch_key="conv_id")
    return _rows(done, F.col("tokens"), "conv_id").select("conv_id", F.col("item.sentence_id").cast("long").alias("sentence_id"), "item.x", F.col("item.token_id").cast("long").alias("token_id"))


@query("""with b as (select conv_id, row_number() over (partition by conv_id order by turn)::bigint as document_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as ss from conversations),
s as (select conv_id, document_id, unnest(ss) as sentence, generate_subscripts(ss, 1)::bigint as sentence_id from b)
select conv_id, document_id, sentence_id, len(list_filter(string_split_regex(sentence, '[ \\t\\r\\n]+'), lambda x: x <> ''))::bigint as n_tokens from s""")
def batch_documents(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.NestedTokenizer(tk.IndexedTokenization(_LINES))
    done = tk.tokenize_batch(table(spark, sf, "conversations"), t, "turn", stage=DOCUMENT, batch_key="conv_id")
    rows = _rows(done, F.col("tokens"), "conv_id", at="sentence_id").where(F.size("item") > 0)
    return rows.select("conv_id", F.get("item", F.lit(0))["document_id"].cast("long").alias("document_id"), "sentence_id", F.size("item").cast("long").alias("n_tokens"))


# ---- normalizers ----


@query("select doc_id, lower(text) as text from documents")
def lowercase(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", normalize.lowercase(F.col("text")).alias("text"))


@query("select doc_id, nfc_normalize(text) as text from documents")
def nfc(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", normalize.normal_form("NFC")(F.col("text")).alias("text"))


@query("select doc_id, strip_accents(text) as text from documents")
def strip_marks(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", normalize.composed(normalize.UnicodeFlags.of(stripmark=True).steps())(F.col("text")).alias("text"))


@query("select doc_id, regexp_replace(text, '([0-9])([0-9]+)', '<\\1|\\2>', 'g') as text from documents")
def regex_replace_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", normalize.replaced("([0-9])([0-9]+)", "<\\1|\\2>")(F.col("text")).alias("text"))


@query(f"with {_WORDS} select doc_id, pos, regexp_replace(word, '^', '--') as word from w")
def regex_replace_word(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.WordReplaceNormalizer("^", "--", tk.EachSplitTokenization(re.compile(_BLANK))))
    return _rows(_docs(spark, sf), t.apply(F.col("text"), SENTENCE), "doc_id").select("doc_id", "pos", F.col("item.x").alias("word"))


@query("select doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') as text from documents")
def code_swapcase(spark: SparkSession, sf: str) -> DataFrame:
    swap = CodeMap((("a", "z"), ("A", "Z")), (("A", "Z"), ("a", "z")))
    return _docs(spark, sf).select("doc_id", swap(F.col("text")).alias("text"))


@query("select doc_id, text, octet_length(encode(text))::bigint as n_units from documents")
def byte_map_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    bytes_ = CodeMap(*BYTE_MAP)
    there = _docs(spark, sf).select("doc_id", bytes_(F.col("text")).alias("m"))
    return there.select("doc_id", bytes_.inverse()(F.col("m")).alias("text"), F.length("m").cast("long").alias("n_units"))


# ---- vocabularies ----


@query(f"""with {_WORDS}, f as (select word, min((doc_id, pos)) as seen_at from w group by word)
select row_number() over (order by seen_at)::bigint as idx, word from f""")
def vocab_build(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.first_seen(_words(spark, sf), "word", ["doc_id", "pos"]).select(F.col("idx").cast("long").alias("idx"), "word")


@query(f"with {_WORDS}, {_TOP} select doc_id, pos, w.word, coalesce(idx, 0)::bigint as idx from w left join v using (word)")
def vocab_encode(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf)
    return _top(words).encode_ids(words, "word").select("doc_id", "pos", "word", F.col("idx").cast("long").alias("idx"))


@query(f"""with {_WORDS}, {_TOP}, n as (select doc_id, pos, length(word)::bigint * 40 as idx from w)
select doc_id, pos, n.idx, coalesce(word, '[UNK]') as word from n left join v using (idx)""")
def vocab_decode(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf)
    numbers = words.select("doc_id", "pos", (F.length("word").cast("long") * 40).alias("idx"))
    return _top(words).decode_ids(numbers, "idx").select("doc_id", "pos", "idx", "word")


@query(f"with {_WORDS}, {_TOP} select word, count(*) as n from w where word not in (select word from v) group by word")
def vocab_oov(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf)
    return _top(words).unknown(words, "word").groupBy("word").agg(F.count("*").alias("n"))


@query(f"with {_WORDS}, {_TOP} select idx, case idx when 2 then '<two>' when 5 then '<five>' else word end as word from v")
def vocab_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    out = _top(_words(spark, sf)).overwrite({2: "<two>", 5: "<five>"})
    return out.frame.select(F.col("idx").cast("long").alias("idx"), "word")


@query(f"with {_WORDS}, {_TOP} select case idx when 2 then '<two>' else word end as word, idx from v union all select '<far>', 2500")
def vocab_perforated(spark: SparkSession, sf: str) -> DataFrame:
    out = _top(_words(spark, sf)).perforated({2: "<two>", 2500: "<far>"})
    return out.frame.select("word", F.col("idx").cast("long").alias("idx"))


@query("""with v as (select event_type as word, row_number() over (order by seen_at)::bigint as idx from (select event_type, min(event_id) as seen_at from events group by event_type))
select event_id, word as event_type, idx, (select count(*) from v)::bigint as width from events join v on word = event_type""")
def onehot_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type")
    v = Vocab(vocabulary.first_seen(events, "event_type", ["event_id"]))
    coded = v.encode_ids(events, "event_type").withColumn("hot", v.onehot(F.col("idx")))
    return coded.select("event_id", "event_type", F.col("hot.idx").cast("long").alias("idx"), F.col("hot.width").cast("long").alias("width"))


@query(f"""with {_WORDS}, {_TOP}, i as (select item_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from benchmark),
j as (select item_id, unnest(list_concat(ws, ws[1:1])) as word, generate_subscripts(list_concat(ws, ws[1:1]), 1)::bigint as pos from i)
select item_id, pos, coalesce(idx, 0)::bigint as idx, (select count(*) from v)::bigint as width from j left join v using (word)""")
def onehot_concat(spark: SparkSession, sf: str) -> DataFrame:
    v = _top(_words(spark, sf))
    ws = table(spark, sf, "benchmark").select("item_id", splitters.blank_words(F.col("text")).alias("ws"))
    ids = v.encode_arrays(ws, "ws", "item_id")
    hot = v.onehot_concat(F.col("ids"), F.slice("ids", 1, 1))
    return _rows(ids.select("item_id", hot.alias("hot")), F.col("hot.ids"), "item_id").select("item_id", "pos", F.col("item").cast("long").alias("idx"), F.lit(v.size).cast("long").alias("width"))


# ---- sequences ----


@query("""with x as (select doc_id, list_concat(['<s>'], list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> ''), ['</s>']) as s from documents)
select doc_id, unnest(s) as word, generate_subscripts(s, 1)::bigint as pos from x""")
def head_tail(spark: SparkSession, sf: str) -> DataFrame:
    s = arrays.with_head_tail(splitters.blank_words(F.col("text")), "<s>", "</s>")
    return _rows(_docs(spark, sf), s, "doc_id").select("doc_id", F.col("item").alias("word"), "pos")


def _trunc_pad_sql(trunc: str, pad: str) -> str:
    cut = "ws[1:64]" if trunc == "tail" else "ws[-64:]"
    more = "list_transform(range(64 - len(ws)), lambda i: '<pad>')"
    filled = f"list_concat(ws, {more})" if pad == "tail" else f"list_concat({more}, ws)"
    return f"""with x as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from documents),
y as (select doc_id, case when len(ws) > 64 then {cut} else {filled} end as s from x) select doc_id, unnest(s) as word, generate_subscripts(s, 1)::bigint as pos from y"""


def _trunc_pad(trunc: str, pad: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = arrays.trunc_or_pad(splitters.blank_words(F.col("text")), 64, "<pad>", trunc, pad)
        return _rows(_docs(spark, sf), s, "doc_id").select("doc_id", F.col("item").alias("word"), "pos")

    run.__name__ = f"trunc_pad_{trunc[0]}{pad[0]}"
    return run


for _t in ("tail", "head"):
    for _p in ("tail", "head"):
        query(_trunc_pad_sql(_t, _p))(_trunc_pad(_t, _p))


@query("""with x as (select conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from conversations),
y as (select *, max(len(ws)) over (partition by conv_id) as m from x),
z as (select conv_id, turn, list_concat(ws, list_transform(range(m - len(ws)), lambda i: '<pad>')) as s from y)
select conv_id, turn, unnest(s) as word, generate_subscripts(s, 1)::bigint as pos from z""")
def pad_to_batch_max(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", splitters.blank_words(F.col("text")).alias("ws"))
    done = arrays.pad_batch(rows, "ws", "<pad>", batch_key="conv_id")
    return _rows(done, F.col("ws"), "conv_id", "turn").select("conv_id", "turn", F.col("item").alias("word"), "pos")


@query("""with x as (select item_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from benchmark), m as (select least(max(len(ws)), 24) as n from x),
y as (select item_id, case when len(ws) > n then ws[1:n] else list_concat(ws, list_transform(range(n - len(ws)), lambda i: '<pad>')) end as s from x, m)
select item_id, unnest(s) as word, generate_subscripts(s, 1)::bigint as pos from y""")
def trunc_and_pad_frame(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select("item_id", splitters.blank_words(F.col("text")).alias("ws"))
    return _rows(arrays.pad_batch(rows, "ws", "<pad>", most=24), F.col("ws"), "item_id").select("item_id", F.col("item").alias("word"), "pos")


@query("""with x as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as ss from documents),
y as (select doc_id, ss, list_max(list_transform(ss, lambda s: len(list_filter(string_split_regex(s, '[ \\t\\r\\n]+'), lambda x: x <> '')))) as m from x)
select doc_id, coalesce(m, 0)::bigint as inner_size, len(ss)::bigint as outer_size, coalesce(m, 0)::bigint * len(ss)::bigint as n_values, true as restored from y""")
def nested_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of words, padded, made rectangular and nested again."""
    words = F.transform(splitters.newline_sentences(F.col("text")), splitters.blank_words)
    square = _docs(spark, sf).select("doc_id", arrays.trunc_or_pad(words, None, "<pad>", depth=2).alias("s"))
    batch = square.select("doc_id", "s", arrays.nested2batch(F.col("s"), 2).alias("b"))
    size = lambda k: F.get("b.shape", F.lit(k)).cast("long")
    return batch.select("doc_id", size(0).alias("inner_size"), size(1).alias("outer_size"), F.size("b.data").cast("long").alias("n_values"), ((size(0) == 0) | (arrays.batch2nested(F.col("b"), 2) == F.col("s"))).alias("restored"))


@query("""with x as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from documents)
select doc_id, case when len(ws) < 2 then array_to_string(ws, ', ') else concat(array_to_string(ws[1:len(ws) - 1], ', '), ' and ', ws[-1]) end as joined from x""")
def join_text_last(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", arrays.join_text(splitters.blank_words(F.col("text")), ", ", " and ").alias("joined"))


@query("select vec_id, list_max(embedding)::double as largest, len(embedding)::bigint as n, len(list_filter(embedding, lambda x: x > 0)) = len(embedding) as all_positive, len(list_filter(embedding, lambda x: x > 0)) > 0 as any_positive from embeddings")
def all_any(spark: SparkSession, sf: str) -> DataFrame:
    both = arrays.allany(lambda x: x > 0, F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("largest"), F.size("embedding").cast("long").alias("n"), both["all"].alias("all_positive"), both["any"].alias("any_positive"))


# ---- templates ----

_TURNS = """
t as (select conv_id, row_number() over (partition by conv_id order by turn) as k, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from conversations)"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, xs): the word lists of a conversation's turns."""
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", splitters.blank_words(F.col("text")).alias("ws")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv_id", F.transform("ts", lambda t: t["ws"]).alias("xs"))


def _template_rows(df: DataFrame, seq: Column, ids: Column) -> DataFrame:
    return _rows(df, F.arrays_zip(seq.alias("x"), ids.alias("type_id")), "conv_id").select("conv_id", "pos", F.col("item.x").alias("x"), F.col("item.type_id").cast("long").alias("type_id"))


def _pair_sql(more: str) -> str:
    return f"""with {_TURNS}, c as (select conv_id, count(*) as n from t group by conv_id),
x as ({more}),
y as (select conv_id, o, type_id, unnest(ws) as x, generate_subscripts(ws, 1) as j from x)
select conv_id, row_number() over (partition by conv_id order by o, j)::bigint as pos, x, type_id::bigint as type_id from y"""


@query(_pair_sql("""select conv_id, 0 as o, 1 as type_id, ['[CLS]'] as ws from c union all select conv_id, 1, 1, ws from t where k = 1 union all select conv_id, 2, 1, ['[SEP]'] from c
union all select conv_id, 3, 2, ws from t where k = 2 union all select conv_id, 4, 2, ['[SEP]'] from c where n > 1"""))
def template_bert_pair(spark: SparkSession, sf: str) -> DataFrame:
    template = SequenceTemplate(ConstTerm("[CLS]"), InputTerm(), ConstTerm("[SEP]"), RepeatedTerm(InputTerm(2), ConstTerm("[SEP]", 2)))
    two = _turns(spark, sf).withColumn("xs", F.slice("xs", 1, 2))
    return _template_rows(two, *template.over(F.col("xs")))


@query(_pair_sql("""select conv_id, 0 as o, 1 as type_id, ['[CLS]'] as ws from c union all select conv_id, 2 * k - 1, k, ws from t union all select conv_id, 2 * k, k, ['[SEP]'] from t"""))
def template_dynamic_ids(spark: SparkSession, sf: str) -> DataFrame:
    template = SequenceTemplate(ConstTerm("[CLS]"), InputTerm(), ConstTerm("[SEP]"), RepeatedTerm(InputTerm(2), ConstTerm("[SEP]", 2), dynamic_type_id=1))
    return _template_rows(_turns(spark, sf), *template.over(F.col("xs")))


@query(_pair_sql("select conv_id, k as o, case when k = 1 then 1 else 2 end as type_id, ws from t union all select conv_id, 1000000, 1, ws from t where k = 1"))
def template_indexed(spark: SparkSession, sf: str) -> DataFrame:
    template = SequenceTemplate(IndexInputTerm(1), RepeatedTerm(InputTerm(2)), IndexInputTerm(1))
    return _template_rows(_turns(spark, sf), *template.over(F.col("xs")))


# ---- encoders and pipelines ----

_ENCODED = f"""{_WORDS}, {_TOP},
e0 as (select doc_id, list_concat(['<s>'], ws, ['</s>']) as s from w0),
e1 as (select doc_id, case when len(s) > 32 then s[1:32] else list_concat(s, list_transform(range(32 - len(s)), lambda i: '<pad>')) end as s from e0),
e as (select doc_id, unnest(s) as token, generate_subscripts(s, 1)::bigint as pos from e1),
v2 as (select word, idx from v union all select '<s>', 2001 union all select '</s>', 2002 union all select '<pad>', 2003)"""


def _encoder(spark: SparkSession, sf: str) -> TextEncoder:
    v = _top(_words(spark, sf)).perforated({TOP_WORDS + 1: "<s>", TOP_WORDS + 2: "</s>", TOP_WORDS + 3: "<pad>"})
    shape = lambda s: arrays.trunc_or_pad(arrays.with_head_tail(s, "<s>", "</s>"), LENGTH, "<pad>")
    return TextEncoder(tk.FlatTokenizer(tk.EachSplitTokenization(re.compile(_BLANK))), v, shape)


@query(f"with {_ENCODED} select doc_id, pos, token, coalesce(idx, 0)::bigint as idx from e left join v2 on token = word")
def encode_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: split, frame, cut to one length, look up; a broadcast join after the split, and no shuffle of texts."""
    enc = _encoder(spark, sf)
    rows = _rows(enc.encode_indices(_docs(spark, sf), stage=SENTENCE), F.col("words"), "doc_id").withColumnRenamed("item", "token")
    return enc.vocab.encode_ids(rows, "token").select("doc_id", "pos", "token", F.col("idx").cast("long").alias("idx"))


@query(f"with {_ENCODED} select doc_id, string_agg(coalesce(word, '[UNK]'), ' ' order by pos) as decoded from e left join v2 on token = word group by doc_id")
def decode_text(spark: SparkSession, sf: str) -> DataFrame:
    enc = _encoder(spark, sf)
    ids = enc.encode(_docs(spark, sf), stage=SENTENCE)
    return enc.decode_text(ids).select("doc_id", "decoded")


@query("""select doc_id, len(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> ''))::bigint as n_words, length(lower(text))::bigint as n_chars,
list_max(list_transform(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> ''), lambda x: length(x)))::bigint as longest from documents""")
def pipeline_features(spark: SparkSession, sf: str) -> DataFrame:
    steps = (
        Pipeline("lower", normalize.lowercase)
        | Pipeline("words", splitters.blank_words, "lower")
        | Pipeline(("n_words", "longest"), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_max(F.transform(w, lambda x: F.length(x))).cast("long").alias("m")), "words")
        | Pipeline("n_chars", lambda t, _: F.length(t).cast("long"), ("lower", 0))
        | PipeGet("doc_id", "n_words", "n_chars", "longest")
    )
    return steps(_docs(spark, sf))


@query("""with x as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as ws from documents), y as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1)::bigint as pos from x)
select doc_id, pos, lower(word) as word from y""")
def word_function(spark: SparkSession, sf: str) -> DataFrame:
    t = tk.FlatTokenizer(tk.WordFuncNormalizer(normalize.lowercase, tk.EachSplitTokenization(re.compile(_BLANK))))
    return _rows(_docs(spark, sf), t.apply(F.col("text"), SENTENCE), "doc_id").select("doc_id", "pos", F.col("item.x").alias("word"))


@query()
def default_words(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences and words by the default rules; tests compare them with the fixtures."""
    t = tk.FlatTokenizer(tk.IndexedTokenization())
    return t.rows(_docs(spark, sf), "doc_id").select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("sentence_id", "word_id", "token_id")], "x")


@query()
def byte_level_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of a byte-level sub-word model, as mapped bytes; RE2 has no look-ahead, so tests compare with Python."""
    t = tk.FlatTokenizer(tk.CodeNormalizer(CodeMap(*BYTE_MAP), tk.EachMatchTokenization(matching.Regex(splitters.BYTE_LEVEL))))
    return _rows(_docs(spark, sf), t.apply(F.col("text"), SENTENCE), "doc_id").select("doc_id", "pos", F.col("item.x").alias("x"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return encode_fixed(spark, folder)
