"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def order_key(doc_id):
    return -(2**63) if doc_id is None else doc_id


def repeated(units_by_doc, window):
    """Units of each (id, text) covered by a window that starts earlier. Equal
    documents are one document."""
    first, gone = set(), {}
    for key in sorted(units_by_doc):
        units = units_by_doc[key]
        gone[key] = set()
        for i in range(len(units) - window + 1):
            w = tuple(units[i : i + window])
            if w in first:
                gone[key].update(range(i, i + window))
            first.add(w)
    return gone


def substring_dedup(docs, window=20):
    """docs: (doc_id, text). Returns {(doc_id, text): (n, removed, kept text)}."""
    units = {(order_key(d), t or ""): words(t) for d, t in docs}
    gone = repeated(units, window)
    return {k: (len(u), len(gone[k]), " ".join(w for i, w in enumerate(u) if i not in gone[k])) for k, u in units.items()}


def byte_dedup(docs, width=100):
    units = {(order_key(d), t or ""): (t or "").encode() for d, t in docs}
    gone = repeated(units, width)
    out = {}
    for k, b in units.items():
        g = gone[k]
        spans = sum(1 for i in g if i - 1 not in g)
        out[k] = (len(b), len(g), spans, bytes(x for i, x in enumerate(b) if i not in g))
    return out


def shingles(text, k=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def linked(a, b, percent=75):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def components(sets, percent=75):
    """sets: {id: set}. Smallest reachable id of each."""
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if linked(sets[i], sets[j], percent):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover),
        len(w) < 20 or 100 * len(cover) > 30 * len(w),
    )


def mix_targets(sizes):
    """sizes: {source: words}. Water filling by repeated capping."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        shared = sum(weight[s] for s in names if s not in capped)
        goal = {s: float(3 * sizes[s]) if s in capped else rest * weight[s] / shared for s in names}
        over = {s for s in names if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


def mix(docs, quality):
    """docs: (doc_id, text, source). {(doc_id, text): taken words}."""
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += len(words(t))
    goal = mix_targets(size)
    out = {}
    for s in size:
        epochs = math.floor(goal[s] / size[s]) if size[s] else 0
        rest, total = goal[s] - epochs * size[s], 0

        def key(d):
            u = (int(hashlib.md5(f"mix-{'' if d[0] is None else d[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return -math.log(u) / quality(d[1]), order_key(d[0])

        for d in sorted((d for d in docs if d[2] == s), key=key):
            n = len(words(d[1]))
            total += n
            out[d[0], d[1]] = (epochs + (rest > 0 and total - n / 2 <= rest)) * n
    return out
