from __future__ import annotations

import re

import pytest
from lexiloom import queries
from lexiloom.functions import normalize, splitters
from lexiloom.plans import tokenization as tk
from pyspark.sql import functions as F

TEXTS = [
    "One line of words.\nAnd 12 more,  in a second one!",
    "\n\n  \n x \n\n",
    "",
    None,
    "   ",
    "été naïve \U0001f63a\U0001f63ab c\td",
    "thenthen 1 en 22th",
    "A. B? C! 345",
]
LINES = tk.WordTokenization(splitters.newline_sentences, splitters.blank_words)
CHARS = tk.SubwordTokenization(splitters.characters, LINES)
PATTERNS = [re.compile("[0-9]"), "en"]
#: Made when a test runs: some need a session.
PLANS = {
    "default": lambda: tk.DefaultTokenization(),
    "words": lambda: tk.IndexedTokenization(LINES),
    "characters": lambda: tk.IndexedTokenization(CHARS),
    "characters without ids": lambda: CHARS,
    "matches": lambda: tk.IndexedTokenization(tk.MatchTokenization(LINES, PATTERNS)),
    "matches and characters": lambda: tk.IndexedTokenization(tk.MatchTokenization(CHARS, PATTERNS)),
    "word pieces": lambda: tk.IndexedTokenization(tk.SubwordTokenization(splitters.word_pieces(["th", "##en", "x"]), LINES)),
    "vanishing words": lambda: tk.IndexedTokenization(tk.WordReplaceNormalizer("[a-m]", "", CHARS)),
    "normalized": lambda: tk.IndexedTokenization(tk.LowercaseNormalizer(tk.UnicodeNormalizer(CHARS, "NFD"))),
    "Python's words": lambda: tk.IndexedTokenization(tk.WordFuncNormalizer(normalize.PythonText(str.swapcase), CHARS)),
    "Python's gaps": lambda: tk.IndexedTokenization(tk.MatchTokenization(tk.WordFuncNormalizer(normalize.PythonText(str.swapcase), CHARS), PATTERNS)),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").cache()


@pytest.mark.parametrize("name, stage", [(n, "document") for n in PLANS] + [(n, s) for n in ("characters", "matches and characters") for s in ("sentence", "subsentence", "word", "token")])
def test_rows_are_the_tokens_of_the_array(docs, name, stage):
    tokenizer = tk.FlatTokenizer(PLANS[name]())
    want = docs.select("k", F.explode(tokenizer.apply(F.col("text"), stage)).alias("t")).select("k", "t.*")
    got = tokenizer.rows(docs, "k", stage=stage)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_characters_and_their_numbers(docs):
    want = []
    for k, text in enumerate(TEXTS):
        for s, line in enumerate([x for x in (text or "").split("\n") if x], 1):
            words = [w for w in re.split("[ \t\r\n]+", line) if w]
            want += [(k, c, s, w, n) for n, (w, c) in enumerate([(w, c) for w, word in enumerate(words, 1) for c in word], 1)]
    got = tk.FlatTokenizer(PLANS["characters"]()).rows(docs, "k").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    both = docs.select("k", F.explode(tk.FlatTokenizer(PLANS["characters"]()).apply(F.col("text"))).alias("t")).select("k", "t.*").collect()
    assert sorted(map(tuple, both)) == sorted(want)


@pytest.mark.parametrize("name", ["indexed_chars", "indexed_tokens", "indexed_matches"])
def test_tokens_are_exploded_from_plain_arrays_of_a_sentence(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    generated = re.findall(r"Generate posexplode\((.{12})", plan)
    assert len(generated) == 2 and generated[0].startswith("_all#") and not re.search(r"[-)] (Filter|Exchange)", plan)
