from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom.functions import arrays
from lexiloom.functions.columns import nested
from pyspark.sql import functions as F

NINE, THREE = list(range(1, 10)), [1, 2, 3]


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("head, tail, want", [(0, 6, [0, 1, 2, 3, 4, 5, 6]), (None, 6, [1, 2, 3, 4, 5, 6]), (0, None, [0, 1, 2, 3, 4, 5]), (None, None, [1, 2, 3, 4, 5])])
def test_head_tail(spark, head, tail, want):
    assert one(spark, [1, 2, 3, 4, 5], "array<int>", lambda c: arrays.with_head_tail(c, head, tail)) == want
    assert one(spark, [[1, 2, 3, 4, 5], []], "array<array<int>>", arrays.with_head_tail(head=head, tail=tail, depth=2)) == [want, [v for v in (head, tail) if v is not None]]


@pytest.mark.parametrize("t, p, cut, padded", [("tail", "tail", [1, 2, 3, 4, 5], [1, 2, 3, 0, 0]), ("tail", "head", [1, 2, 3, 4, 5], [0, 0, 1, 2, 3]), ("head", "tail", [5, 6, 7, 8, 9], [1, 2, 3, 0, 0]), ("head", "head", [5, 6, 7, 8, 9], [0, 0, 1, 2, 3])])
def test_trunc_or_pad(spark, t, p, cut, padded):
    assert one(spark, [NINE, THREE], "array<array<int>>", arrays.trunc_or_pad(None, 5, 0, t, p, depth=2)) == [cut, padded]
    assert one(spark, THREE, "array<int>", lambda c: arrays.trunc_or_pad(c, 5, 0, t, p)) == padded
    got = one(spark, [NINE, [2, 3]], "array<array<int>>", lambda c: arrays.trunc_or_pad(c, None, -1, t, p, depth=2))
    assert [len(x) for x in got] == [9, 9] and got[0] == NINE
    assert one(spark, THREE, "array<int>", lambda c: arrays.trunc_and_pad(c, 5, 0, t, p)) == THREE
    assert one(spark, [NINE, [2, 3]], "array<array<int>>", lambda c: arrays.trunc_and_pad(c, None, 0, t, p, depth=2)) == one(spark, [NINE, [2, 3]], "array<array<int>>", lambda c: arrays.trunc_or_pad(c, 9, 0, t, p, depth=2))
    got = one(spark, [NINE, [1, 2, 3, 4, 5], [2, 3]], "array<array<int>>", arrays.trunc_and_pad(None, 7, -1, t, p, depth=2))
    assert [len(x) for x in got] == [7, 7, 7] and got[0] == (NINE[:7] if t == "tail" else NINE[2:])


def test_bad_ends():
    for f in (arrays.trunc_or_pad, arrays.trunc_and_pad):
        with pytest.raises(ValueError):
            f(F.lit(1), 3, 0, "middle")
        with pytest.raises(ValueError):
            f(F.lit(1), 3, 0, "tail", "middle")


def test_pad_batch(spark):
    rows = spark.createDataFrame([("a", 1, [1]), ("a", 2, [1, 2, 3]), ("b", 3, [7]), (None, 4, [])], "k string, n int, v array<int>")
    assert {r.n: r.v for r in arrays.pad_batch(rows, "v", 0).collect()} == {1: [1, 0, 0], 2: [1, 2, 3], 3: [7, 0, 0], 4: [0, 0, 0]}
    got = {r.n: r.v for r in arrays.pad_batch(rows.where("k is not null"), "v", 0, batch_key="k", most=2).collect()}
    assert got == {1: [1, 0], 2: [1, 2], 3: [7]}


@pytest.mark.parametrize("values, d, last, want", [(["a", "b", "c"], "", None, "abc"), (["a", "b", "c"], " + ", " = ", "a + b = c"), (["a"], " + ", " = ", "a"), ([], "+", "=", ""), (["a", "b"], " + ", " = ", "a = b")])
def test_join_text(spark, values, d, last, want):
    assert one(spark, values, "array<string>", lambda c: arrays.join_text(c, d, last)) == want
    assert one(spark, [values, ["x", "y"]], "array<array<string>>", lambda c: arrays.join_text(c, d, last, 2))[0] == want


def test_rectangular(spark):
    deep = [[[[float(i + 5 * j + 20 * k + 60 * m) for i in range(5)] for j in range(4)] for k in range(3)] for m in range(2)]
    kind = "array<array<array<array<double>>>>"
    batch = one(spark, deep, kind, lambda c: arrays.nested2batch(c, 4))
    assert batch.shape == [5, 4, 3, 2] and batch.data == [float(v) for v in range(120)]
    assert one(spark, deep, kind, lambda c: arrays.batch2nested(arrays.nested2batch(c, 4), 4)) == deep
    with pytest.raises(Exception, match="differ in length"):
        one(spark, [[1, 2, 3], [2, 3]], "array<array<int>>", lambda c: arrays.nested2batch(c, 2))
    df = spark.createDataFrame([(deep,)], f"v {kind}")
    assert arrays.sequence_depth(df, "v") == 4 and arrays.nestedtype(df, "v").simpleString() == "double"


def test_nested_calls(spark):
    assert one(spark, [[1], [2, 3]], "array<array<int>>", nested(lambda x: x + 1, 2)) == [[2], [3, 4]]
    assert one(spark, [[1], [2, 3]], "array<array<int>>", lambda c: arrays.nestedmaxlength(c, 2)) == 2
    assert one(spark, [], "array<array<int>>", lambda c: arrays.nestedmaxlength(c, 2)) == 0
    assert tuple(one(spark, [1, -1], "array<int>", lambda c: arrays.allany(lambda x: x > 0, c))) == (False, True)
    assert one(spark, [1], "array<int>", lambda c: arrays.elementmap(lambda x: x * 2, c)) == [2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), min_size=1, max_size=4), st.integers(0, 7))
def test_lengths_are_equal(spark, values, n):
    got = one(spark, values, "array<array<int>>", arrays.trunc_or_pad(None, n, -1, depth=2))
    assert got == [(v + [-1] * n)[:n] for v in values]
