from __future__ import annotations

import math
import string

import pytest
from lexiloom.functions import arrays
from lexiloom.operators import vocab as vocabulary
from lexiloom.operators.encoder import TextEncoder
from lexiloom.operators.pipeline import TARGET, PipeGet, Pipeline
from lexiloom.operators.vocab import Vocab
from lexiloom.plans import tokenization as tk
from lexiloom.streaming import tokens as streaming
from pyspark.sql import functions as F


def frame(spark, values, kind):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")


def looked(spark, v, values, kind, how="lookup"):
    rows = getattr(v, how)(frame(spark, values, kind), "v", "o").orderBy("k").collect()
    return [r.o for r in rows]


def test_words(spark):
    v = Vocab.of(spark, "abcabc")
    assert len(v) == 3 and v.unki == 0
    assert looked(spark, v, ["a", "d", "c", None], "string") == [1, 0, 3, None]
    assert looked(spark, v, [1, 0, 1_000_000, -1, None], "int") == ["a", "[UNK]", "[UNK]", "[UNK]", None]
    w = Vocab.of(spark, ["a", "b", "xxx"], "xxx")
    assert w.unki == 3 and looked(spark, w, ["c"], "string") == [3] and looked(spark, w, [100_000], "int") == ["xxx"]
    assert repr(v) == "Vocab{string}(size = 3, unk = [UNK], unki = 0)"
    chars = Vocab.of(spark, string.ascii_lowercase, " ")
    assert looked(spark, chars, ["a", "x", "z"], "string") == [1, 24, 26]


def test_numbers(spark):
    v = Vocab.of(spark, range(11, 21), 0)
    assert len(v) == 10 and looked(spark, v, [1], "int") == [11]
    assert looked(spark, v, [11, 1], "long", "encode_ids") == [1, 0]
    with pytest.raises(TypeError):
        Vocab.of(spark, "abc").encode_ids(frame(spark, [1], "int"), "v")
    with pytest.raises(TypeError):
        v.encode_ids(frame(spark, ["a"], "string"), "v")
    with pytest.raises(TypeError):
        v.decode_ids(frame(spark, ["a"], "string"), "v")
    with pytest.raises(Exception, match="no word"):
        v.decode_ids(frame(spark, [11], "int"), "v", strict=True).collect()


def test_containers_and_onehot(spark):
    v = Vocab.of(spark, "abc")
    rows = frame(spark, [["a", "d"], [], None, ["c"]], "array<string>")
    got = v.encode_arrays(rows, "v", "k").orderBy("k")
    assert [r.ids for r in got.collect()] == [[1, 0], [], None, [3]]
    assert [r.words for r in v.decode_arrays(got, "ids", "k").orderBy("k").collect()] == [["a", "[UNK]"], [], None, ["c"]]
    pair = spark.createDataFrame([(("a", "z"),)], "s struct<x:string,y:string>")
    assert tuple(v.encode_struct(pair, "s").first().s) == (1, 0)
    hot = spark.range(1).select(v.onehot(F.lit(1)).alias("a"), v.onehot(F.lit(0)).alias("z"), v.onehot_concat(F.array(F.lit(1)), F.array(F.lit(2), F.lit(0))).alias("c"))
    r = hot.select("a", "c", v.dense(F.col("a")).alias("d"), v.dense(F.col("z")).alias("e")).first()
    assert tuple(r.a) == (3, 1) and r.c.ids == [1, 2, 0] and r.d == [1, 0, 0] and r.e == [0, 0, 0]


def test_several_lookups_and_onehot_words(spark):
    v = Vocab.of(spark, "abc")
    df = spark.createDataFrame([("a", 2)], "w string, n int")
    assert v.lookups(df, {"w": "i", "n": "x"}).first().asDict() == {"w": "a", "n": 2, "i": 1, "x": "b"}
    assert df.transform(v.looking("n", "x")).first().x == "b"
    hot = df.select(F.struct(F.lit(99).alias("width"), F.lit(3).alias("idx")).alias("h"), F.array(F.lit(0), F.lit(1), F.lit(0)).alias("d"), F.array(F.lit(0)).alias("z"))
    got = v.decode_onehot(v.decode_onehot(v.decode_onehot(hot, "h", "a"), "d", "b"), "z", "c").first()
    assert (got.a, got.b, got.c) == ("c", "b", "[UNK]")


def test_overwrites(spark):
    v = Vocab.of(spark, "abc")
    w = v.overwrite({"b": "x"})
    assert looked(spark, w, [1, 2, 3], "int") == ["a", "x", "c"] and looked(spark, w, ["b", "x"], "string") == [0, 2]
    assert looked(spark, v.overwrite({2: "x"}), ["x"], "string") == [2]
    for bad, error in (({2: "a"}, ValueError), ({1: "x", 2: "x"}, ValueError), ({4: "x"}, IndexError), ({0: "x"}, IndexError), ({"q": "x"}, KeyError)):
        with pytest.raises(error):
            v.overwrite(bad)
    p = v.perforated({2: "x", 6: "far"})
    assert len(p) == 6 and looked(spark, p, [2, 5, 6], "int") == ["x", "[UNK]", "far"] and looked(spark, p, ["far", "b"], "string") == [6, 0]
    with pytest.raises(ValueError):
        v.perforated({9: "a"})


def test_built_from_frames(spark):
    rows = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (9, "a"), (5, None)], "at int, w string")
    assert [tuple(r) for r in vocabulary.first_seen(rows, "w", ["at"]).orderBy("idx").collect()] == [(1, "c"), (2, "b"), (3, "a")]
    assert [tuple(r) for r in vocabulary.most_frequent(rows.where("w is not null"), "w", 2).orderBy("idx").collect()] == [(1, "b"), (2, "a")]


def test_lookups_are_broadcast_joins(spark):
    v = Vocab.of(spark, "abc")
    assert "BroadcastHashJoin" in v.encode_ids(frame(spark, ["a"], "string"), "v")._jdf.queryExecution().executedPlan().toString()


def test_encoder(spark):
    v = Vocab.of(spark, string.ascii_lowercase + string.ascii_uppercase)
    t = tk.NestedTokenizer(tk.IndexedTokenization(tk.SubwordTokenization()))
    docs = spark.createDataFrame([(1, "A single sentence with 31 char."), (2, "")], "doc_id int, text string")
    enc = TextEncoder(t, v)
    got = enc.encode(docs, stage="sentence").orderBy("doc_id")
    first = got.first()
    assert first.width == 52 and [len(x) for x in first.ids] == [26]
    chars = [c for c in "Asinglesentencewith31char."]
    assert first.ids[0] == [v_ + 1 if (v_ := (string.ascii_lowercase + string.ascii_uppercase).find(c)) >= 0 else 0 for c in chars]
    words = enc.decode(got).orderBy("doc_id").first().words
    assert words == [[c if c.isalpha() else "[UNK]" for c in chars]]
    assert enc.decode_text(got, delim="").orderBy("doc_id").first().decoded == ["".join(words[0])]
    built = TextEncoder.build(tk.FlatTokenizer(tk.SubwordTokenization()), v, lambda e: lambda w: arrays.trunc_or_pad(e.processed(w), 3, "a"))
    assert [r.ids for r in built.encode(docs, stage="sentence").orderBy("doc_id").collect()] == [[27, 19, 9], [1, 1, 1]]


def test_word_piece_batch(spark):
    """Two sentences of different lengths: framed, padded with the unknown word to one length, and looked up."""
    v = Vocab.of(spark, ["[UNK]", "[CLS]", "[SEP]", "a", "b", "##c"], "[UNK]")
    rows = spark.createDataFrame([(1, ["a", "##c", "b"]), (2, ["b"])], "doc_id int, words array<string>")
    framed = rows.withColumn("words", arrays.with_head_tail(F.col("words"), "[CLS]", "[SEP]"))
    ids = v.encode_arrays(arrays.pad_batch(framed, "words", "[UNK]"), "words", "doc_id").orderBy("doc_id")
    assert [r.ids for r in ids.collect()] == [[2, 4, 6, 5, 3], [2, 5, 3, 1, 1]]


def test_pipelines(spark):
    steps = Pipeline("x", F.upper) | Pipeline(("n", "m"), lambda t: F.struct(F.length(t).alias("a"), (F.length(t) * 2).alias("b")), "x") | Pipeline("z", lambda s, n: F.concat(s, n.cast("string")), (0, "n"))
    df = spark.createDataFrame([("ab",)], "text string")
    assert steps(df).first().asDict() == {"text": "ab", "x": "AB", "n": 2, "m": 4, "z": "ab2"}
    assert (steps | PipeGet("z", "x"))(df).columns == ["z", "x"]
    assert len(steps) == 3 and repr(steps[:1] | PipeGet("x", "n")) == "Pipelines:\n  target[x] := upper(source)\n  target := (target.x, target.n)"
    with pytest.raises(ValueError):
        (steps[:1] | Pipeline(("a",), lambda t: F.struct(t, t), "x"))(df)


def test_pipeline_of_numbers(spark):
    """sin and cos of twice the source, their quotient from the target as a whole, and a step replaced."""
    pipes = (
        Pipeline("t", lambda x: x * 2)
        | Pipeline(("sin", "cos"), lambda t: F.struct(F.sin(t), F.cos(t)), "t")
        | Pipeline("tan", lambda target: target["sin"] / target["cos"], TARGET)
        | PipeGet("tan", "t")
    )
    df = spark.createDataFrame([(math.e,)], "x double")
    assert list(pipes(df, "x").first()) == pytest.approx([-1.1306063769531505, 5.43656365691809])
    other = pipes[0] | Pipeline("tan", F.tan, "t") | pipes[-1]
    assert list(other(df, "x").first()) == pytest.approx([-1.1306063769531507, 5.43656365691809])


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b"), (2, "b z")], "doc_id int, text string").write.parquet(source)
    stream = spark.readStream.schema("doc_id int, text string").parquet(source)
    t, v = tk.FlatTokenizer(tk.EachSplitTokenization(" ")), Vocab.of(spark, "ab")
    rows = streaming.token_rows(stream, t, "doc_id", stage="sentence", vocab=v)
    query = streaming.write_tokens(rows, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.pos, r.x, r.idx) for r in got.collect()) == [(1, 1, "a", 1), (1, 2, "b", 2), (2, 1, "b", 2), (2, 2, "z", 0)]
