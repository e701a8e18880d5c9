"""Plain readings of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def similar_components(rows):
    """Sorted (id, shingles, component) of (id, text) rows; rows that share an id are one vertex."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(a), root(i)) for i, a in sets)


def without_repeats(rows, length):
    """Sorted (id, bytes, removed, spans, sha256 of the rest) of (id, text) rows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + length] for _, b in data for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = bytes(gone).count(b"\0\1") + (gone[:1] == b"\1")
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def spaced_words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def vector_links(rows, least):
    """Sorted (id, links, component) of (id, label, unit vector or None) rows."""
    links, parent = defaultdict(int), {i: i for i, *_ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (i, k, a) in enumerate(rows):
        for j, m, b in rows[:n]:
            if a is not None and b is not None and k is not None and k == m and len(a) == len(b) and float(a @ b) >= least:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, links[i], root(i)) for i, *_ in rows)
