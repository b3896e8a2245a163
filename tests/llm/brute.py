"""Plain restatements of what the operators are to return, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def components(nodes, edges):
    p = {x: x for x in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def ngram_join(rows, k=5, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    c = components(ids, edges)
    return {i: (len(sets[i]), c[i]) for i in ids}


def substrings(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (" ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone))
    return out


def lines(rows, min_chars=40, min_docs=5):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if not (len(key(x)) >= min_chars and len(docs[key(x)]) >= min_docs and max(docs[key(x)]) != i)]
        out[i] = ("\n".join(keep), len(own), len(own) - len(keep))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """sizes: by source."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        got = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s: cap * sizes[s] for s, x in got.items() if x > cap * sizes[s]}
        if not over:
            return got | capped
        capped |= over
