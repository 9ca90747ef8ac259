"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def spaced(s: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def decontaminate(docs, items):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)} for rows (id, text)."""
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(s or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text: str | None) -> set:
    w = spaced(ascii_lower(text or ""))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def components(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 85 * (len(x) + len(y) - n):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return {d: (len(sets[d]), root(d)) for d in ids}


def quality(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = text or ""
    w = spaced(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for k in range(len(w) - 2):
        where.setdefault(tuple(w[k : k + 3]), []).append(k)
    hit = {k + j for ks in where.values() if len(ks) > 1 for k in ks for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)
