from __future__ import annotations

from collections import Counter

import pytest
from lexiloom.llm import preferences as pf

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def brute(chosen, rejected):
    out = []
    sides = [{}, {}]
    for side, rows in zip(sides, (chosen, rejected)):
        for c, t, role, text, *_ in rows:
            side.setdefault(c, {}).setdefault(float("inf") if t is None else t, []).append((role or "user", text or ""))
    for c in {*sides[0], *sides[1]}:
        a, b = (s.get(c, {}) for s in sides)
        differ = [t for t in {*a, *b} if Counter(a.get(t, [])) != Counter(b.get(t, []))]
        first = min(differ) if differ else None
        for side, part in ((a, "chosen"), (b, "rejected")):
            for t, turns in side.items():
                common = first is None or t < first
                if common and part == "rejected":
                    continue
                for role, text in turns:
                    shown = f"<|{role}|>\n{text.replace('<|', '<||')}<|end|>\n"
                    out.append((c, "prompt" if common else part, None if t == float("inf") else t, role, shown, not common and role == "assistant"))
    return sorted(out, key=repr)


CHOSEN = [
    (1, 0, "system", "s", "q"), (1, 1, "user", "hi <|end|>", "q"), (1, 2, "assistant", "good", "q"), (1, 3, "user", "more", "q"), (1, 4, "assistant", "end", "q"),
    (2, 0, "user", "same", "q"), (2, 1, "assistant", "same", "q"), (3, 0, "user", None, "q"), (3, None, None, "late", "q"), (4, 0, "user", "only chosen", "q"),
    (5, 0, "user", "a", "q"), (5, 0, "user", "b", "q"), (5, 1, "assistant", "x", "q"), (None, 0, "user", "n", "q"), (None, 1, "assistant", "n", "q"), (7, 0, "user", "é" * 5000, "q"),
]
REJECTED = [
    (1, 0, "system", "s", "q"), (1, 1, "user", "hi <|end|>", "q"), (1, 2, "assistant", "bad", "q"), (2, 0, "user", "same", "q"), (2, 1, "assistant", "same", "q"), (3, 0, "user", "", "q"), (3, None, "user", "late", "q"), (3, 1, "user", "x", "q"),
    (5, 0, "user", "b", "q"), (5, 0, "user", "a", "q"), (5, 1, "user", "x", "q"), (6, 0, "user", "only rejected", "q"), (None, 0, "user", "n", "q"), (None, 1, "assistant", "m", "q"), (7, 0, "user", "é" * 4999, "q"),
]


def test_segments_equal_brute_force(spark):
    got = pf.preferences(spark.createDataFrame(CHOSEN, SCHEMA), spark.createDataFrame(REJECTED, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(CHOSEN, REJECTED)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_examples(spark):
    rows = {r.conv_id: r for r in pf.examples(pf.preferences(spark.createDataFrame(CHOSEN, SCHEMA), spark.createDataFrame(REJECTED, SCHEMA))).collect()}
    r = rows[1]
    assert r.prompt == "<|system|>\ns<|end|>\n<|user|>\nhi <||end|><|end|>\n"
    assert r.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\nend<|end|>\n"
    assert [r.chosen[a:b] for a, b in r.chosen_loss] == ["<|assistant|>\ngood<|end|>\n", "<|assistant|>\nend<|end|>\n"]
    assert [r.rejected[a:b] for a, b in r.rejected_loss] == ["<|assistant|>\nbad<|end|>\n"]
    assert rows[2].chosen == rows[2].rejected == "" and rows[2].chosen_loss == []


def test_cut_short(spark):
    got = pf.cut_short(spark.createDataFrame(CHOSEN, SCHEMA)).collect()
    by = {(r.conv_id, r.turn, r.role): r.text for r in got}
    assert len(got) == len(CHOSEN) and by[1, 4, "assistant"] == "e" and by[1, 2, "assistant"] == "good" and by[2, 1, "assistant"] == "sa"


@pytest.mark.parametrize("a, b", [([], []), (CHOSEN, []), ([], REJECTED)])
def test_empty_sides(spark, a, b):
    got = pf.preferences(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(a, b)
