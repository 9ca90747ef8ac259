from __future__ import annotations

import math
import re

import pytest
from lexiloom.llm import url_filters as uf


def brute(pages, labels):
    """{row: (host, path, rule, verdict, template, purity)} by the docstring's definition."""
    rules = dict(uf.RULES)
    quality = {}
    for k, q in labels:
        if k is not None and q is not None:
            quality[k] = min(q, quality.get(k, q))
    rows = []
    for key, url in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        shape = re.sub("[0-9]+", "<n>", re.sub("/[0-9a-fA-F-]{16,}", "/<id>", path))
        rows.append((host, path, shape, quality.get(key)))
    node = {}
    for host, _, shape, q in rows:
        parts = shape.split("/")
        for k in range(len(parts) + 1):
            s = node.setdefault((host, tuple(parts[:k])), [0, 0, 0])
            s[0], s[1], s[2] = s[0] + 1, s[1] + (q is not None), s[2] + (q == 1)

    def merged(host, parts):
        n, l, g = node[host, parts]
        _, ul, ug = node[host, parts[:-1]]
        share = ug / max(1, ul)
        return n < uf.LEAST_PAGES or l == 0 or abs(g / max(1, l) - share) <= uf.Z * math.sqrt(share * (1 - share) / max(1, l))

    def template(host, shape):
        parts = shape.split("/")
        return "/".join("*" if p != "" and merged(host, tuple(parts[: k + 1])) else p for k, p in enumerate(parts))

    every, hosts, templates = [0, 0], {}, {}
    for host, _, shape, q in rows:
        for s in (every, hosts.setdefault(host, [0, 0]), templates.setdefault((host, template(host, shape)), [0, 0])):
            s[0], s[1] = s[0] + (q is not None), s[1] + (q == 1)
    overall = every[1] / every[0] if every[0] else 1.0
    out = []
    for host, path, shape, _ in rows:
        t = template(host, shape)
        hp = (hosts[host][1] + uf.SMOOTH * overall) / (hosts[host][0] + uf.SMOOTH)
        purity = (templates[host, t][1] + uf.SMOOTH * hp) / (templates[host, t][0] + uf.SMOOTH)
        rule = None
        for r in sorted(rules, key=len):
            name, _, rest = r.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
                rule = r
        out.append((host, path, rule, rules[rule] if rule else "block" if purity < uf.LEAST_PURITY else "allow", t, round(purity, 9)))
    return out


def pages():
    urls = [f"https://Shop.example.ORG/spam/{k}/x.html?q=1#t" for k in range(60)] + [f"http://shop.example.org/good/{k}" for k in range(60)]
    urls += [f"https://a.io/{'abcdefgh'[k % 8]}{k}/post" for k in range(40)] + [f"x://b.io/{k % 3}/" for k in range(9)]
    urls += ["https://net/", "https://x.net/a", "https://example.net/en/5", "https://w.example.net/en/", "https://example.net/fr", "http://example.com/de/1", "http://q.example.com/de", "http://a.org/fr/2", "http://org/fr/", "http://a.org/fr"]
    urls += [None, "", "no scheme", "mailto:x", "http://", "http://h?x", "http://h#/a/b", "a://b://c/d", "http://é.io/ü//", "http://k.io/0123456789abcdef0/x", "http://long.io" + "/s" * 300, "http://shop.example.org/good/1"]
    urls += ["http://notexample.net/en/1"]
    labels = [(k, 0) for k in range(0, 60, 2)] + [(k, 1) for k in range(60, 120, 3)] + [(k, k % 2) for k in range(120, 150)] + [(1, None), (60, 0), (None, 1)]
    return list(enumerate(urls)), labels


def test_verdicts_equal_brute_force(spark):
    rows, labels = pages()
    df = spark.createDataFrame([(k, u, "z", k) for k, u in rows], "page_id long, url string, host string, n long")
    got = uf.judged(df, spark.createDataFrame(labels, "label_key long, quality int"))
    want = brute(rows, labels)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in got.collect()} == dict(enumerate(want))
    assert want[0][3] == "block" and want[0][4].startswith("/spam/") and want[70][3] == "allow"


@pytest.mark.parametrize("labels", [[], [(0, 1)]])
def test_few_labels_and_empty_tables(spark, labels):
    rows, _ = pages()
    df, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "label_key long, quality int")
    assert uf.judged(df, known).where("rule is null and verdict <> 'allow'").count() == 0
    assert uf.judged(df.where("false"), known).count() == 0
