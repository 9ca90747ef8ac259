from __future__ import annotations

import random

import brute
import pytest
from lexiloom.llm import near_duplicates as nd


def copies(n: int, base: int, changed: int, seed: int) -> list[str]:
    """``n`` different texts of ``base`` words, each with up to ``changed`` words of its own."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
    out = []
    for k in range(n):
        own = list(words)
        for j in range(1 + rng.randrange(changed)):
            own[rng.randrange(base)] = f"x{k}y{j}"
        out.append(" ".join(own))
    return out


def true_links(texts: list[str]) -> list[int]:
    sets = [brute.shingles(t) for t in texts]
    near = lambda a, b: a != b and 100 * len(a & b) >= 85 * len(a | b)
    return [len({frozenset(b) for b in sets if b and near(a, b)}) if a else 0 for a in sets]


@pytest.mark.parametrize("blocks", [1000, 7])
def test_every_link_of_a_component_counts(spark, monkeypatch, blocks):
    monkeypatch.setattr(nd, "BLOCK_SETS", blocks)
    texts = copies(60, 200, 4, 1) + copies(40, 120, 3, 2) + copies(1, 90, 1, 3)
    texts += [texts[0], texts[60], "", "one", "one two"]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    got = {r.doc_id: r for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d].n_links for d in range(len(texts))] == true_links(texts)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.components(rows)


def test_texts_under_one_doc_id_are_judged_apart(spark):
    a, near = copies(2, 150, 2, 5)
    b = copies(1, 150, 1, 6)[0]
    rows = [(5, a), (5, b), (3, near), (7, "x y z"), (7, "p q r"), (7, "x y z"), (8, ""), (8, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nd.one_per_component(docs).collect()), key=repr)
    assert got == sorted([(5, b), (3, near), (7, "x y z"), (7, "p q r"), (8, ""), (8, None), (None, a)], key=repr)
    links = {(r.doc_id, r.component_id, r.n_links) for r in nd.near_duplicates(docs).collect()}
    assert links == {(5, 3, 1), (5, 5, 0), (3, 3, 1), (7, 7, 0), (8, 8, 0), (None, None, 0)}


def family(n: int, same: int, own: int, seed: int) -> list[str]:
    """Pages of one template: the same words, and some of their own, too many for a link."""
    rng = random.Random(seed)
    head = [f"t{rng.randrange(10**6)}" for _ in range(same)]
    return [" ".join(head[: same // 2] + [f"p{k}q{j}" for j in range(own)] + head[same // 2 :]) for k in range(n)]


def test_pages_of_a_template_arent_compared_pair_by_pair(spark):
    texts = family(120, 240, 60, 8)
    for k in range(0, 120, 10):  # and a near copy of some
        texts.append(texts[k].replace(f"p{k}q7 ", "changed "))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs).collect()}
    assert got == brute.components(rows)
    sets = spark.createDataFrame([(k, k, [hash(x) for x in brute.shingles(t)]) for k, t in enumerate(texts)], "rep long, root long, shingles array<long>")
    pairs = {tuple(r) for r in nd.sharing_rare(sets).collect()}
    assert pairs == {(k, 120 + k // 10) for k in range(0, 120, 10)}


def test_recall_near_the_threshold(spark):
    """Pairs of all similarities around 0.85: every true link is found."""
    rng = random.Random(9)
    texts = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(250)]
        texts.append(" ".join(words))
        for j in range(rng.randrange(4, 16)):
            words[rng.randrange(250)] = f"n{k}m{j}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.components(rows)
    assert 20 < sum(c != d for d, (_, c) in want.items()) < 140
    assert got == want


def test_clashing_columns_and_empty_tables(spark):
    a, near = copies(2, 150, 2, 5)
    rows = [(1, a, "x", 1, "y"), (2, near, "x", 2, "y"), (3, None, None, None, None), (4, a, "x", 3, "y"), (1, a, "z", 9, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, n int, `a.b` string")
    kept = nd.one_per_component(docs)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert [r[0] for r in got] == [1, 3]
    empty = docs.where("false")
    assert nd.near_duplicates(empty).count() == 0 and nd.one_per_component(empty).count() == 0


def unhinted(monkeypatch, make) -> list[str]:
    """The joins of all plans that ``make`` runs for which Spark may broadcast a side by an estimate of its size."""
    plans = []
    with monkeypatch.context() as m:
        m.setattr(nd, "written", lambda df, name, own=nd.written: (plans.append(df), own(df, name))[1])
        plans.append(make())
    lines = [line for df in plans for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    assert len(lines) > 10
    return [line for line in lines if "strategy=" not in line]


def test_no_table_is_broadcast_for_its_estimated_size(spark, monkeypatch):
    texts = copies(5, 120, 3, 1) + family(4, 240, 60, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert unhinted(monkeypatch, lambda: nd.near_duplicates(docs)) == []


def test_the_pipelines_stage_broadcasts_no_table_either(spark, monkeypatch):
    texts = copies(3, 120, 3, 1)
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (2, texts[2])], "doc_id long, text string")
    found = spark.createDataFrame([(1, True, 118, 1, 1), (2, False, 118, 2, 2), (2, True, 118, 3, 3)], "doc_id long, kept boolean, n long, h1 long, h2 long")
    monkeypatch.setattr(nd, "settled", lambda *_: found)
    lines = [line for line in nd.one_per_component(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    assert lines and all("strategy=merge" in line for line in lines)
