from __future__ import annotations

import re

import pytest
from lexiloom.functions import matching, normalize, splitters
from lexiloom.functions.codemap import BYTE_MAP, CodeMap
from lexiloom.plans import stages
from lexiloom.plans import tokenization as tk
from lexiloom.plans.nodes import replace
from pyspark.sql import functions as F

DOCUMENT = "This is the first sentence. And the second one with some number 12345."
SENTENCE = "A single sentence with 31 char."
D1 = ["This", "is", "the", "first", "sentence", "."]
D2 = ["And", "the", "second", "one", "with", "some", "number", "12345", "."]
S = ["A", "single", "sentence", "with", "31", "char", "."]
PROTECT = [re.compile(r"\d"), re.compile("en")]


def run(spark, tokenizer, text, stage):
    return spark.createDataFrame([(text,)], "t string").select(tokenizer.apply(F.col("t"), stage).alias("o")).first().o


def xs(tokens):
    return [t.x if hasattr(t, "x") else xs(t) for t in tokens]


def flat(spark, plan, text, stage):
    return xs(run(spark, tk.FlatTokenizer(plan), text, stage))


def test_default(spark):
    assert flat(spark, tk.DefaultTokenization(), DOCUMENT, "document") == D1 + D2
    assert flat(spark, tk.DefaultTokenization(), SENTENCE, "sentence") == S
    assert flat(spark, tk.DefaultTokenization(), "word", "word") == ["word"]
    for stage in ("document", "sentence", "word", "token"):
        assert flat(spark, tk.DefaultTokenization(), "", stage) == []
    assert run(spark, tk.FlatTokenizer(), None, "document") is None
    assert flat(spark, tk.DefaultTokenization(), "Don't stop: it's 1,234.5 (really)...", "sentence") == ["Do", "n't", "stop", ":", "it", "'s", "1,234.5", "(", "really", ")", "..."]


def test_word_and_split(spark):
    loose = tk.WordTokenization(tokenize=splitters.loose_words)
    assert flat(spark, loose, SENTENCE, "sentence") == S[:-1]
    split = tk.EachSplitTokenization((" ", ",", "."))
    match = tk.EachMatchTokenization(re.compile(r"[^\. ]+|\."))
    assert flat(spark, split, DOCUMENT, "document") == [w for w in D1 + D2 if w != "."]
    assert flat(spark, match, DOCUMENT, "document") == D1 + D2
    assert flat(spark, split, "a    b", "sentence") == flat(spark, match, "a    b", "sentence") == ["a", "b"]
    assert flat(spark, split, "word", "word") == ["word"]
    assert flat(spark, split, "a, b", "subsentence") == ["a", ",", "b"]  # sub-sentences are split by default


def test_match_splits(spark):
    assert "".join(flat(spark, tk.MatchSplitsTokenization(" "), SENTENCE, "sentence")) == SENTENCE
    assert flat(spark, tk.MatchSplitsTokenization(","), "a, b, c,d", "sentence") == ["a", ",", " b", ",", " c", ",", "d"]
    assert flat(spark, tk.MatchSplitsTokenization((",,", ", ")), "a,, b, c,d", "sentence") == ["a", ",,", " b", ", ", "c,d"]
    pieces = lambda s, p: [(r.ismatch, r.x) for r in spark.createDataFrame([(s,)], "t string").select(matching.matchsplits(F.col("t"), p).alias("o")).first().o]
    assert pieces("abcabcabc", re.compile("[ac]")) == [(True, "a"), (False, "b"), (True, "c")] * 3
    assert pieces("abcabcabc", ["ab", "bc"]) == [(True, "ab"), (False, "c")] * 3
    assert pieces("abc", ["bc", "ab"]) == [(False, "a"), (True, "bc")]  # priority, not alternation
    assert pieces("a.b\\Ec", [".", "\\E"]) == [(False, "a"), (True, "."), (False, "b"), (True, "\\E"), (False, "c")]
    with pytest.raises(ValueError):
        matching.matchsplits(F.lit("a"), [])
    with pytest.raises(ValueError):
        matching.find_all(F.lit("a"), re.compile("x*"))


def test_protected(spark):
    plan = tk.MatchTokenization(PROTECT)
    assert flat(spark, plan, SENTENCE, "sentence") == ["A", "single", "s", "en", "t", "en", "ce", "with", "3", "1", "char", "."]
    assert flat(spark, plan, DOCUMENT, "document") == "This is the first s en t en ce . And the second one with some number 1 2 3 4 5 .".split()
    assert flat(spark, plan, "word", "word") == ["word"] and flat(spark, plan, "123", "word") == ["1", "2", "3"]


def test_ids(spark):
    got = run(spark, tk.FlatTokenizer(tk.IndexedTokenization()), DOCUMENT, "document")
    want = [(w, s, i, i) for s, ws in ((1, D1), (2, D2)) for i, w in enumerate(ws, 1)]
    assert [(t.x, t.sentence_id, t.word_id, t.token_id) for t in got] == want
    got = run(spark, tk.FlatTokenizer(tk.IndexedTokenization()), SENTENCE, "sentence")
    assert [tuple(t) for t in got] == [(w, i, i) for i, w in enumerate(S, 1)]
    assert [tuple(t) for t in run(spark, tk.FlatTokenizer(tk.IndexedTokenization()), "word", "word")] == [("word", 1, 1)]
    got = run(spark, tk.FlatTokenizer(tk.IndexedTokenization(tk.MatchTokenization(PROTECT))), SENTENCE, "sentence")
    assert [t.ismatch for t in got] == [c == "T" for c in "FFFTFTFFTTFF"] and [t.word_id for t in got] == list(range(1, 13))
    chars = tk.IndexedTokenization(tk.MatchTokenization(tk.SubwordTokenization(), PROTECT))
    got = run(spark, tk.FlatTokenizer(chars), SENTENCE, "sentence")
    assert [t.word_id for t in got] == [1] + [2] * 6 + [3, 4, 5, 6] + [7] * 2 + [8] * 4 + [9, 10] + [11] * 4 + [12]
    assert [t.token_id for t in got] == list(range(1, 25))


def test_nested(spark):
    t = tk.NestedTokenizer(tk.IndexedTokenization())
    assert xs(run(spark, t, DOCUMENT, "document")) == [D1, D2]
    assert xs(run(spark, t, SENTENCE, "sentence")) == [S]
    assert xs(run(spark, t, "word", "word")) == ["word"]
    assert run(spark, t, "", "sentence") == [[]]


def test_batches(spark):
    rows = spark.createDataFrame([(1, DOCUMENT), (2, SENTENCE), (3, "This is another sentence")], "n int, text string")
    got = {r.n: r.tokens for r in tk.tokenize_batch(rows, tk.NestedTokenizer(tk.IndexedTokenization()), "n").collect()}
    assert [tuple(got[1][1][0])[1:], tuple(got[3][0][3])] == [(1, 2, 1, 1), ("sentence", 3, 1, 4, 4)]
    got = {r.n: r.tokens for r in tk.tokenize_batch(rows, tk.FlatTokenizer(tk.IndexedTokenization()), "n", stage="sentence").collect()}
    assert [(t.sentence_id, t.word_id) for t in got[3]] == [(3, 1), (3, 2), (3, 3), (3, 4)]
    assert [r.asDict() for r in stages.Batch(stages.SENTENCE).rows(spark.createDataFrame([(7, ["a", "b"])], "k int, t array<string>"), "t", "k").collect()] == [{"k": 7, "ordinal": 1, "t": "a"}, {"k": 7, "ordinal": 2, "t": "b"}]


def test_normalizers(spark):
    fold = tk.UnicodeNormalizer(casefold=True)
    assert flat(spark, fold, DOCUMENT.upper(), "document") == [w.lower() for w in D1 + D2]
    assert flat(spark, fold, "WORD", "word") == ["word"]
    number = [re.sub(r"\d+", "NUMBER", w) for w in D1 + D2]
    assert flat(spark, tk.SentenceReplaceNormalizer(r"\d+", "NUMBER"), DOCUMENT, "document") == number
    assert flat(spark, tk.SentenceReplaceNormalizer("^(.*)$", "--\\1"), SENTENCE, "sentence") == flat(spark, tk.DefaultTokenization(), "--" + SENTENCE, "sentence")
    assert flat(spark, tk.WordReplaceNormalizer("^", "--"), DOCUMENT, "document") == ["--" + w for w in D1 + D2]
    protect = [re.compile(p) for p in (r"This|A", "en", r"\d")]
    inner = tk.MatchTokenization(tk.UnicodeNormalizer(casefold=True), protect)
    assert flat(spark, inner, DOCUMENT, "document") == "This is the first s en t en ce . A nd the second one with some number 1 2 3 4 5 .".split()
    swap = tk.SentenceFuncNormalizer(CodeMap((("a", "z"), ("A", "Z")), (("A", "Z"), ("a", "z"))))
    assert flat(spark, tk.MatchTokenization(swap, protect), DOCUMENT, "document")[:14] == "This IS THE FIRST S en T en CE . A ND THE SECOND".split()
    python = tk.WordFuncNormalizer(normalize.PythonText(str.swapcase))
    assert flat(spark, tk.MatchTokenization(python, protect), SENTENCE, "sentence") == "A SINGLE S en T en CE WITH 3 1 CHAR .".split()
    outer = tk.SentenceReplaceNormalizer("b", "c", tk.SentenceReplaceNormalizer("a", "b"))
    assert flat(spark, outer, "ab", "sentence") == ["bc"]  # the outer one runs first
    assert flat(spark, tk.CodeNormalizer(CodeMap((("a", "z"), ("A", "Z")))), "word", "word") == ["WORD"]


def test_forms_and_flags(spark):
    one = lambda flags, x: spark.createDataFrame([(x,)], "t string").select(normalize.composed(flags.steps())(F.col("t")).alias("o")).first().o
    of, named = normalize.UnicodeFlags.of, normalize.UnicodeFlags.named
    assert one(named("NFD"), "é") == "é" and one(named("NFC"), "é") == "é" and one(named("NFKC"), "ﬁ") == "fi"
    assert one(of(stripmark=True), "éàb") == "eab" and one(of(stripignore=True), "a­b​c") == "abc"
    assert one(of(newline2lf=True), "a\r\nb\rc\u0085d") == "a\nb\nc\nd" and one(of(newline2ls=True), "a\nb") == "a b"
    assert one(of(stripcc=True), "a\x01b\tc\nd") == "ab c d" and one(of(lump=True), "a–b’c") == "a-b'c"
    assert one(of(casefold=True), "Straße ΑΣ ı") == "strasse ας ı".replace("ς", "σ")
    assert repr(named("NFKD")) == "NFKD" and repr(of(casefold=True)) == "compose = true, casefold = true"
    for bad in ({"compat": True, "compose": False}, {"newline2lf": True, "newline2ls": True}, {"nosuch": True}):
        with pytest.raises(ValueError):
            of(**bad)
    with pytest.raises(ValueError):
        named("NFX")
    with pytest.raises(Exception, match="unassigned"):
        one(of(rejectna=True), "a͸")


def test_casefold_is_that_of_unicode(spark):
    chars = [chr(c) for c in range(0x20, 0x2000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c,) for c in chars], "t string").select("t", normalize.casefold(F.col("t")).alias("o")).collect()
    wrong = [r.t for r in got if r.o != r.t.casefold()]
    assert len(wrong) < 120  # titlecase and Cherokee corners
    assert not [c for c in wrong if ord(c) < 0x250]


def test_codemaps(spark):
    bytes_ = CodeMap(*BYTE_MAP)
    split = tk.EachMatchTokenization(matching.Regex(splitters.BYTE_LEVEL))
    assert flat(spark, tk.CodeNormalizer(bytes_, split), "This is a 😺", "sentence") == ["This", "Ġis", "Ġa", "ĠðŁĺº"]
    back = spark.createDataFrame([("ĠðŁĺº",)], "t string").select(bytes_.inverse()(F.col("t"))).first()[0]
    assert back == " 😺"
    assert bytes_.find_code(32) == 288 and bytes_.find_code(65) == 65 and (bytes_.source_bits, bytes_.target_bits) == (8, 16)
    with pytest.raises(ValueError):
        CodeMap((("a", "z"), ("A", "Y")))


def test_word_pieces(spark):
    split = splitters.word_pieces(["p", "##eck", "pe", "un", "##able", "##ab"])
    plan = tk.IndexedTokenization(tk.SubwordTokenization(split))
    got = run(spark, tk.FlatTokenizer(plan), "unable peck xyz", "sentence")
    assert [(t.x, t.word_id, t.token_id) for t in got] == [("un", 1, 1), ("##able", 1, 2), ("[UNK]", 2, 3), ("[UNK]", 3, 4)]
    got = run(spark, tk.FlatTokenizer(tk.SubwordTokenization(splitters.word_pieces(["p", "##eck"]))), "peck", "word")
    assert xs(got) == ["p", "##eck"]


def test_stages():
    assert stages.kind(stages.register_stage("title", "sentence")) == stages.SENTENCE
    for bad in ("3", "A{B}", "a b", 3):
        with pytest.raises(ValueError):
            stages.register_stage(bad)
    with pytest.raises(ValueError):
        stages.register_stage("word")
    with pytest.raises(ValueError):
        stages.register_stage("x_y", "nosuch")


def test_shown_and_replaced():
    pats = PROTECT
    assert repr(tk.FlatTokenizer()) == "FlatTokenizer(default)"
    assert repr(tk.FlatTokenizer(tk.IndexedTokenization(tk.MatchTokenization(pats)))) == "FlatTokenizer(IndexedTokenization(MatchTokenization(default, 2 patterns)))"
    assert repr(tk.FlatTokenizer(tk.UnicodeNormalizer(casefold=True))) == "FlatTokenizer(UnicodeNormalizer(default, compose = true, casefold = true))"
    assert repr(tk.NestedTokenizer(tk.IndexedTokenization())) == "NestedTokenizer(IndexedTokenization(default))"
    assert repr(tk.FlatTokenizer(tk.WordTokenization(tokenize=splitters.loose_words))) == "FlatTokenizer(WordTokenization(split_sentences = split_sentences, tokenize = loose_words))"
    swap = lambda f: splitters.words if f is splitters.loose_words else f
    assert replace(swap, tk.FlatTokenizer(tk.WordTokenization(tokenize=splitters.loose_words))) == tk.FlatTokenizer(tk.WordTokenization())
    bare = lambda x: x.base if isinstance(x, tk.IndexedTokenization) else x
    assert replace(bare, tk.IndexedTokenization(tk.MatchTokenization(pats))) == tk.MatchTokenization(pats)
    nfc = lambda x: tk.UnicodeNormalizer(x.base, "NFC") if isinstance(x, tk.UnicodeNormalizer) else x
    assert replace(nfc, tk.FlatTokenizer(tk.UnicodeNormalizer(casefold=True))) == tk.FlatTokenizer(tk.UnicodeNormalizer("NFC"))
    mixed = tk.MixedTokenization(tk.DefaultTokenization(), tk.IndexedTokenization())
    assert len(mixed) == 2 and mixed[1] == tk.IndexedTokenization()


def test_native_plans_have_no_python_node(spark):
    df = spark.createDataFrame([(DOCUMENT,)], "t string")
    plan = tk.IndexedTokenization(tk.MatchTokenization(tk.LowercaseNormalizer(), PROTECT))
    text = df.select(tk.FlatTokenizer(plan).apply(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text


def test_custom_tokenization(spark):
    class Halves(tk.BaseTokenization):
        def split_word(self, text):
            n = F.floor(F.length(text) / 2).cast("int")
            return F.array(F.substring(text, F.lit(1), n), F.substring(text, n + 1, F.length(text)))

    assert flat(spark, Halves(), "abcd", "word") == ["ab", "cd"] and flat(spark, Halves(), "a", "word") == ["a"]
    assert Halves().splittable("word") and not tk.DefaultTokenization().splittable("word")


def test_token_fields(spark):
    df = spark.createDataFrame([("a",)], "t string").select(stages.token(F.col("t"), word_id=F.lit(1)).alias("k"))
    out = df.select(stages.updatemeta(stages.updatevalue(F.upper, F.col("k")), word_id=F.lit(2), extra=F.lit(True)).alias("k"))
    assert tuple(out.first().k) == ("A", 2, True) and stages.hasmeta(out, "k", "extra") and not stages.hasmeta(df, "k", "extra")
    assert out.select(stages.getvalue(F.col("k")), stages.getmeta(F.col("k"), "word_id")).first()[:] == ("A", 2)
