from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom.functions import arrays, matching
from lexiloom.functions.codemap import BYTE_MAP, CodeMap
from lexiloom.operators.vocab import Vocab
from pyspark.sql import functions as F

TEXTS = st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=30)
SOME = settings(max_examples=8, deadline=None)


def rows(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    return [r.o for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


@SOME
@given(TEXTS)
def test_pieces_restore_their_text(spark, texts):
    got = rows(spark, texts, lambda c: matching.matchsplits(c, [re.compile("[a-m0-4]+"), " ", re.compile("[n-z]")]))
    for text, pieces in zip(texts, got):
        assert "".join(p.x for p in pieces) == text
        assert not any(re.search("[a-m0-4 n-z]", p.x) for p in pieces if not p.ismatch)
        assert all(re.fullmatch("[a-m0-4]+| |[n-z]", p.x) for p in pieces if p.ismatch)
        assert all(a.ismatch or b.ismatch for a, b in zip(pieces, pieces[1:]))


@SOME
@given(TEXTS)
def test_code_maps_have_inverses(spark, texts):
    m = CodeMap(*BYTE_MAP)
    assert rows(spark, texts, lambda c: m.inverse()(m(c))) == texts
    swap = CodeMap((("a", "z"), ("A", "Z")), (("A", "Z"), ("a", "z")))
    assert rows(spark, texts, lambda c: swap(swap(c))) == texts


@SOME
@given(st.lists(st.lists(st.sampled_from("abcxyz"), max_size=8), min_size=1, max_size=20))
def test_known_words_come_back(spark, words):
    v = Vocab.of(spark, "zyxabc")
    df = spark.createDataFrame(list(enumerate(words)), "k int, w array<string>")
    got = v.decode_arrays(v.encode_arrays(df, "w", "k"), "ids", "k").orderBy("k").collect()
    assert [r.words for r in got] == words and all(all(1 <= i <= 6 for i in r.ids) for r in got)


@SOME
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=8))
def test_batches_are_nested_again(spark, shapes):
    deep = [[[[i * 10 + j] * 3 for j in range(b)] for i in range(a)] for a, b in shapes]
    assert rows(spark, deep, lambda c: arrays.batch2nested(arrays.nested2batch(c, 3), 3), "array<array<array<int>>>") == deep
