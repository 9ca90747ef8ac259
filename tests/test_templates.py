from __future__ import annotations

import pytest
from lexiloom.functions.template import ConstTerm, IndexInputTerm, InputTerm, RepeatedTerm, SequenceTemplate
from pyspark.sql import functions as F

PAIR = SequenceTemplate(ConstTerm("CLS", 1), InputTerm(1), ConstTerm("SEP", 1), RepeatedTerm(InputTerm(2), ConstTerm("SEP", 2)))
DYNAMIC = SequenceTemplate(ConstTerm("[CLS]", 1), InputTerm(1), ConstTerm("[SEP]", 1), RepeatedTerm(InputTerm(2), ConstTerm("[SEP]", 2), dynamic_type_id=True))
TRAIL = SequenceTemplate(IndexInputTerm(1, 1), RepeatedTerm(InputTerm(2)), IndexInputTerm(1, 1), kind="int")
GROW = SequenceTemplate(RepeatedTerm(InputTerm(3), dynamic_type_id=2), kind="int")
MULTI = SequenceTemplate(ConstTerm(0, 1), RepeatedTerm(InputTerm(3), ConstTerm(1, 5), InputTerm(7), dynamic_type_id=2), ConstTerm(0, 9), kind="int")

CASES = [
    (SequenceTemplate(ConstTerm(-1), InputTerm(), ConstTerm(-2), kind="int"), [[1, 2, 3, 4, 5]], [-1, 1, 2, 3, 4, 5, -2], [1] * 7),
    (PAIR, [["A"]], ["CLS", "A", "SEP"], [1, 1, 1]),
    (PAIR, [["A"], ["B"], ["C"]], "CLS A SEP B SEP C SEP".split(), [1, 1, 1, 2, 2, 2, 2]),
    (DYNAMIC, [["A"], ["B"], ["C"]], "[CLS] A [SEP] B [SEP] C [SEP]".split(), [1, 1, 1, 2, 2, 3, 3]),
    (TRAIL, [[3, 5], [1, 2, 4]], [3, 5, 1, 2, 4, 3, 5], [1, 1, 2, 2, 2, 1, 1]),
    (TRAIL, [[3, 5]], [3, 5, 3, 5], [1, 1, 1, 1]),
    (GROW, [[1], [2]], [1, 2], [3, 5]),
    (MULTI, [], [0, 0], [1, 9]),
    (MULTI, [[1, 2], [3, 4]], [0, 1, 2, 1, 3, 4, 0], [1, 3, 3, 5, 7, 7, 9]),
    (MULTI, [[1, 2], [3, 4], [5, 6], [7, 8]], [0, 1, 2, 1, 3, 4, 5, 6, 1, 7, 8, 0], [1, 3, 3, 5, 7, 7, 5, 5, 7, 9, 9, 9]),
]


@pytest.mark.parametrize("template, inputs, seq, ids", CASES)
def test_goldens(spark, template, inputs, seq, ids):
    df = spark.createDataFrame([(inputs,)], f"xs array<array<{template.kind}>>")
    columns = [F.get("xs", F.lit(k)) for k in range(len(inputs))]
    assert tuple(df.select(*[c.alias(n) for c, n in zip(template(*columns), "si")]).first()) == (seq, ids)
    assert tuple(df.select(*[c.alias(n) for c, n in zip(template.over(F.col("xs")), "si")]).first()) == (seq, ids)
    got = df.select(*[c.alias(n) for c, n in zip(template.nested(F.array("xs", "xs")), "si")]).first()
    assert got.s == [seq, seq] and got.i == [ids, ids]
    template.validate(len(inputs))


@pytest.mark.parametrize("template, n", [(MULTI, 1), (MULTI, 3), (PAIR, 0), (SequenceTemplate(InputTerm()), 2), (TRAIL, 0)])
def test_wrong_numbers_of_inputs(spark, template, n):
    with pytest.raises(ValueError):
        template.validate(n)
    df = spark.createDataFrame([([["1"]] * n,)], "xs array<array<string>>")
    with pytest.raises(Exception, match="doesn't fit"):
        df.select(template.over(F.col("xs"))[0]).collect()


def test_bad_templates():
    for bad in (lambda: SequenceTemplate(), lambda: SequenceTemplate(RepeatedTerm(InputTerm()), RepeatedTerm(InputTerm())), lambda: RepeatedTerm(ConstTerm(1)), lambda: RepeatedTerm(RepeatedTerm(InputTerm()))):
        with pytest.raises(ValueError):
            bad()


def test_shown():
    assert repr(DYNAMIC) == "SequenceTemplate{string}([CLS]:<type=1> Input:<type=1> [SEP]:<type=1> (Input:<type=2> [SEP]:<type=2>)<type+=1>...)"
    assert repr(TRAIL) == "SequenceTemplate{int}(Input[1]:<type=1> (Input:<type=2>)... Input[1]:<type=1>)"


def test_unused_output_is_pruned(spark):
    df = spark.createDataFrame([([["A"]],)], "xs array<array<string>>")
    seq, ids = PAIR.over(F.col("xs"))
    plan = df.select(seq.alias("s"), ids.alias("i")).select("s")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan
