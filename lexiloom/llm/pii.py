"""Personal data: patterns, and terms that disclose a found entity (operator 1), with DataFrame operations only.

Base spans are those of four fixed patterns, leftmost and not overlapping within a kind; a match that fails its test
(parts of an ip, digits of a card and Luhn's sum, digits of a phone number) is dropped without another try.
The patterns are written with possessive quantifiers and starts at the borders of runs, which finds the same matches in
linear time.

The method adds spans of the kind ``term``. A base match's normalised value is a protected entity e. Terms t are the
words of three letters or more among the ``NEAR`` words on either side of a match. From the whole corpus:

- n(e, t): occurrences of t near e; n(t): occurrences of t in all texts; p(e | t) = n(e, t) / n(t);
- p(e): words near e of all words; the information of e is -log p(e);
- disclosure = PMI(e; t) / -log p(e) = 1 + log p(e | t) / -log p(e): the share of e's information that t gives away.

Pairs seen in at least ``LEAST_CONTEXTS`` different contexts (texts around the match; copies of one count once) with a
disclosure of ``GENERALISED`` or more give spans wherever t stands near e; from ``REMOVED`` on they're removed, else
generalised. ``sanitised`` does both, and puts ``[KIND]`` for base spans.

Null texts are empty: no spans. Spans are code points, ends exclusive. A null doc_id is kept; rows are judged by text, so
repeated ids and texts each have their rows. Terms with equal figures are treated alike. Very long texts: all steps but
the sum over a card's digits are linear, prefix sums take n ** 1.5. Extra columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import joined, let, table, written

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NEAR, LEAST_CONTEXTS, GENERALISED, REMOVED = 5, 3, 0.8, 0.9
#: Code points beside a match in which its ``NEAR`` words are sought first; see ``_beside``.
_BESIDE = 512
_WORD = r"[\p{L}\p{M}]{3,}"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def running(sizes: Column) -> Column:
    """Sums of all values before each one, in blocks of about the root of their number."""
    n = F.size(sizes)
    width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))

    def inside(part: Column, base: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(part, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / w).cast("int")), lambda b: F.slice(sizes, b * w + 1, w)))
    return let(blocks, lambda bs: let(inside(F.transform(bs, total), F.lit(0)), lambda base: F.flatten(F.transform(bs, lambda b, i: inside(b, F.get(base, i))))))


def found(text: Column, pattern: str, kept) -> Column:
    """struct(spans: start, end, value of matches that are ``kept``, gaps between all matches, at: places in all matches)."""

    def of(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def place(g: Column) -> Column:
            sizes = F.transform(hits, lambda h, i: F.length(F.get(g, i)) + F.length(h))
            starts = let(sizes, lambda s: F.zip_with(running(s), F.zip_with(hits, g, lambda h, x: F.struct(h.alias("h"), F.length(x).alias("n"))), lambda a, b: F.struct((a + b["n"]).alias("start"), (a + b["n"] + F.length(b["h"])).alias("end"), b["h"].alias("value"))))
            spans = F.slice(starts, 1, F.size(hits))
            return let(spans, lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.get(g, i).alias("before"), F.get(g, i + 1).alias("after"))), lambda x: kept(x["value"])))

        return let(gaps, place)

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(of(hits)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    twice = lambda i: F.when(i % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + twice(i)) % 10 == 0


def _part(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.when(F.length(short) <= 3, short).otherwise(F.lit("999")).cast("int") <= 255)


#: kind -> pattern, test of a match, normal form of a value; in the order in which spans are listed.
KINDS = {
    "email": (EMAIL, lambda v: F.lit(True), lambda v: F.lower(v)),
    "ip": (IP, lambda v: F.forall(F.split(v, r"\."), _part), lambda v: v),
    "card": (CARD, lambda v: let(_digits(v), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))), _digits),
    "phone": (PHONE, lambda v: F.length(_digits(v)).between(9, 15), _digits),
}


def _terms(piece: Column, at: Column, last: bool) -> Column:
    """The ``NEAR`` words beside a match: (start, end, term); ``piece`` begins at code point ``at``."""

    def of(words: Column) -> Column:
        gaps = F.split(piece, _WORD, -1)
        sizes = F.transform(words, lambda w, i: F.length(F.get(gaps, i)) + F.length(w))
        placed = let(sizes, lambda s: F.zip_with(running(s), words, lambda a, w: F.struct(a.alias("a"), w.alias("w"))))
        full = let(placed, lambda p: F.transform(F.slice(p, 1, F.size(words)), lambda x, i: F.struct((at + x["a"] + F.length(F.get(gaps, i))).alias("start"), (at + x["a"] + F.length(F.get(gaps, i)) + F.length(x["w"])).alias("end"), F.lower(x["w"]).alias("term"))))
        return let(full, lambda f: F.slice(f, F.greatest(F.size(f) - NEAR, F.lit(0)) + 1, NEAR) if last else F.slice(f, 1, NEAR))

    none = F.array().cast("array<struct<start:int,end:int,term:string>>")
    return let(F.regexp_extract_all(piece, F.lit(_WORD), F.lit(0)), lambda w: F.when(F.size(w) == 0, none).otherwise(of(w)))


def _beside(gap: Column, end) -> Column:
    """As much of a gap as its ``NEAR`` words at this ``end`` need: all of it, unless more words are in ``_BESIDE`` code points, where only the last one may be cut."""
    few = lambda p: F.size(F.regexp_extract_all(p, F.lit(_WORD), F.lit(0))) <= NEAR
    return let(end(gap, F.lit(_BESIDE)), lambda p: F.when((F.length(gap) > _BESIDE) & few(p), gap).otherwise(p))


def _context(kind: str, x: Column, normal) -> Column:
    """struct(entity, terms near it, hash of what is around it)."""
    before = _beside(x["before"], F.right)
    after = _beside(x["after"], F.left)
    near = let(before, lambda b: let(after, lambda a: F.struct(F.concat(_terms(b, x["start"] - F.length(b), True), _terms(a, x["end"], False)).alias("terms"), F.xxhash64(F.right(b, F.lit(64)), F.left(a, F.lit(64))).alias("around"))))
    return F.struct(F.concat(F.lit(f"{kind}:"), normal(x["value"])).alias("entity"), near.alias("near"))


def _measured(t: Column) -> Column:
    """struct(text_key, spans, contexts) of a text that isn't null; the first only where there are spans."""

    def result(f: Column) -> Column:
        of = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        near = lambda k: lambda x: _context(k, x, KINDS[k][2])
        spans = F.concat(*[F.transform(f[k], of(k)) for k in KINDS])
        contexts = F.concat(*[F.transform(f[k], near(k)) for k in KINDS])
        return F.struct(F.when(F.size(spans) > 0, F.sha2(t, 256)).alias("text_key"), spans.alias("spans"), contexts.alias("contexts"))

    return let(F.struct(*[found(t, p, ok).alias(k) for k, (p, ok, _) in KINDS.items()]), result)


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, spans, contexts): a row's base spans by kind, and for texts that have some their hash and contexts."""
    return docs.select(F.col(key).alias("doc_id"), _measured(F.coalesce(F.col(text), F.lit(""))).alias("o")).select("doc_id", "o.text_key", "o.spans", "o.contexts")


def disclosing(contexts: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, n_pair, disclosure) of all pairs, null unless it counts. ``contexts``: (entity, term, around), one a row."""
    pairs = contexts.groupBy("entity", "term", "around").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("n_contexts"))
    near = contexts.groupBy("entity").agg(F.count("*").alias("n_near"))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    words = written(words, "words")
    total = words.agg(F.sum("n_term").alias("total"))
    pairs = written(pairs, "pairs")
    terms = pairs.groupBy("term").agg(F.count("*").alias("_pairs")).join(words, "term")
    entities = pairs.groupBy("entity").agg(F.count("*").alias("_pairs")).join(near, "entity")
    pairs = joined(joined(pairs, written(terms, "terms"), ["term"], "_pairs"), written(entities, "entities"), ["entity"], "_pairs").join(F.broadcast(total))  # one row
    inform = -F.log(F.col("n_near") / F.greatest(F.col("total"), F.col("n_near") + 1))
    share = 1 + F.log(F.least(F.lit(1.0), F.col("n_pair") / F.col("n_term"))) / inform
    return pairs.select("entity", "term", "n_pair", F.when((F.col("n_contexts") >= LEAST_CONTEXTS) & (share >= GENERALISED), share).alias("disclosure"))


def personal(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, spans: kind, start, end, removed) of every row: base spans by kind, then disclosing terms."""
    base = written(measured(docs, text, key), "found")
    some = base.where("text_key is not null")
    contexts = some.select("text_key", F.explode("contexts").alias("c")).select("text_key", "c.entity", F.col("c.near.around").alias("around"), F.explode("c.near.terms").alias("t"))
    contexts = written(contexts.select("text_key", "entity", "around", "t.start", "t.end", "t.term"), "contexts")
    pairs = written(disclosing(contexts.select("entity", "term", "around"), docs, text), "disclosing")
    told = joined(contexts, pairs, ["entity", "term"], "n_pair").where("disclosure is not null")
    told = told.groupBy("text_key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    told = told.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", (F.col("disclosure") >= REMOVED).alias("removed")))).alias("terms"))  # of one text
    times = some.groupBy("text_key").agg(F.count("*").alias("n_rows"))
    told = written(times.join(told, "text_key", "left"), "terms")
    own = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("removed")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,removed:boolean>>")
    rows = joined(some, told, ["text_key"], "n_rows").select("doc_id", "text_key", F.concat(own, F.coalesce("terms", none)).alias("spans"))
    return rows.unionByName(base.where("text_key is null").select("doc_id", "text_key", none.alias("spans")))


def sanitised(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with their own columns and clean texts: ``[KIND]`` for base spans and generalised terms, nothing for removed terms."""
    spans = written(personal(docs, text, key).where("text_key is not null").groupBy("text_key").agg(F.first("spans").alias("spans"), F.count("*").alias("n_rows")), "spans")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_row"), _measured(F.coalesce(F.col(text), F.lit("")))["text_key"].alias("text_key"))
    out = joined(rows.where("text_key is not null"), spans, ["text_key"], "n_rows").unionByName(rows.where("text_key is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    t = F.col(f"_row.`{text}`")

    def step(acc: Column, s: Column) -> Column:
        # spans by start; one that begins inside what is cut already only lengthens the cut
        name = F.when((s["kind"] == "term") & s["removed"], F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece, name))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    by_start = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    new = F.when(F.col("spans").isNull(), t).otherwise(clean)
    return out.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_ = personal(table(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "term"), name), ",")
    removed = F.size(F.filter("spans", lambda s: (s["kind"] == "term") & s["removed"])).cast("long")
    return found_.select("doc_id", *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"), count("term"), removed.alias("n_removed"))
