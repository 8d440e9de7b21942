"""Plain definitions that the Spark operators are held against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def components(texts: dict, pct=75):
    """doc_id -> (n_shingles, component_id) by comparing every pair that shares a shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, s in sets.items():
        for b in {b for x in s for b in where[x] if b > a}:
            inter = len(s & sets[b])
            if 100 * inter >= pct * (len(s) + len(sets[b]) - inter):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}
