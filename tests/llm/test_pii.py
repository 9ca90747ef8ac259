from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from lexiloom.llm import pii
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def brute(texts):
    """All spans of each text, by the docstring's definition."""
    word = re.compile(r"[^\W\d_]{3,}")
    contexts, corpus = [], Counter(w.lower() for t in texts for w in word.findall(t or ""))
    for row, t in enumerate(texts):
        for kind, pattern in PATTERNS.items():
            hits = list(re.finditer(pattern, t or ""))
            for n, m in enumerate(hits):
                if not passes(kind, m.group()):
                    continue
                lo, hi = (hits[n - 1].end() if n else 0), (hits[n + 1].start() if n + 1 < len(hits) else len(t))
                before, after = t[lo : m.start()][-512:], t[m.end() : hi][:512]
                near = [(m.start() - len(before) + w.start(), m.start() - len(before) + w.end(), w.group().lower()) for w in word.finditer(before)][-5:]
                near += [(m.end() + w.start(), m.end() + w.end(), w.group().lower()) for w in word.finditer(after)][:5]
                value = m.group().lower() if kind == "email" else m.group() if kind == "ip" else re.sub("[^0-9]", "", m.group())
                contexts += [(row, f"{kind}:{value}", (before[-64:], after[:64]), a, b, w) for a, b, w in near]
    pair, around, entity = Counter(), {}, Counter()
    for _, e, c, _, _, w in contexts:
        pair[e, w] += 1
        entity[e] += 1
        around.setdefault((e, w), set()).add(c)
    total = sum(corpus.values())

    def disclosure(e, w):
        return 1 + math.log(min(1, pair[e, w] / corpus[w])) / -math.log(entity[e] / max(total, entity[e] + 1))

    out = [[(k, a, b) for k, a, b, _ in base(t)] for t in texts]
    for row in range(len(texts)):
        terms = sorted({(a, b) for r, e, _, a, b, w in contexts if r == row and len(around[e, w]) >= 3 and disclosure(e, w) >= 0.8})
        out[row] += [("term", a, b) for a, b in terms]
    return out


def texts():
    rng = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "élan", "straße", "omega", "sigma", "kappa", "lambda"]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    own = [f"{say(30)} Zaphod Beeblebrox zaphod@heart.gold.example, {say(20)}" for _ in range(6)]
    edge = [
        "a@b.c_d@e.f @@ x@y. q..w%+@z-.a-b.c.d. tail", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3 12345.1.1.1.1", "4465 7583-8288 9437, 4465758382889437 4465758382889438 1 2",
        "+1 (743) 555-3824 and +49 30 1234 +1 2 +()5 ++12345678901 +1234567890123456", "\n".join(["😺 é 1.2.3.4"] * 5), "9" * 3000, "a" * 3000 + "@", "a." * 2000 + "@" + "b." * 2000 + "c", "+1" + " " * 3000 + "5", "", None,
        "x 1.1.1.1 " * 300,
    ]
    return own + [own[0]] * 3 + [say(200) for _ in range(20)] + edge + [edge[0]]


def test_spans_equal_brute_force(spark):
    data = texts()
    docs = spark.createDataFrame([(k if k != 4 else None, t, "x", "y") for k, t in enumerate(data)], "doc_id long, text string, spans string, `a.b` string")
    got = pii.personal(docs).collect()
    want = brute(data)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in got), key=key) == sorted(((k if k != 4 else None, s) for k, s in enumerate(want)), key=key)
    assert any(s[0] == "term" for s in want[0]) and not any(s[0] == "term" for s in want[10])


def test_sanitised_texts(spark):
    data = texts()
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(data)], "doc_id long, text string, `a.b` int")
    rows = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert len(rows) == len(data) and all(r["a.b"] == d for d, r in rows.items())
    assert "zaphod" not in rows[0].text.lower() and "[EMAIL]" in rows[0].text
    clean = [k for k, s in enumerate(brute(data)) if not s]
    assert all(rows[k].text == data[k] for k in clean)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_running_sums(spark, n):
    values = [(k * 7) % 5 for k in range(n)]
    got = spark.createDataFrame([(values,)], "v array<int>").select(pii.running(F.col("v")).alias("s")).first().s
    assert got == [sum(values[:k]) for k in range(n)]


def test_empty_table(spark):
    assert pii.personal(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_words_near_a_match_are_found_however_far_off_and_long(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    long = "q" * 700
    data = [f"{say(30)} Zaphod {long}{' ' * 600}zaphod@heart.gold.example {k}{'-' * 600} Beeblebrox {say(20)}" for k in range(6)] + [say(200) for _ in range(20)]
    rows = pii.personal(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").coalesce(1)).collect()
    terms = {r.doc_id: {data[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "term"} for r in rows}
    assert all(terms[k] == ({"Zaphod", long, "Beeblebrox"} if k < 6 else set()) for k in range(26))
