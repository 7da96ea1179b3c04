"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np


def words(text):
    return text.encode().split() if text else []


def quality_base(text):
    text = text or ""
    ws = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = Counter(grams)
    hit = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 3)}
    n = len(ws)
    return n, sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def base_scores(rows):
    """doc_id: (held out, tokens, known, training tokens, score)."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tokens = {d: [w.lower() for w in words(t)] + [None] for d, t in rows}
    c = Counter(w for d, ts in tokens.items() if not held[d] for w in ts)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ts), sum(c[w] > 0 for w in ts), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ts)) for d, ts in tokens.items()}


def labels(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def shingle_sets(rows, n=5):
    out = {}
    for d, t in rows:
        ws = [w.lower() for w in words(t)]
        out[d] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())
    return out


def near_labels(rows, percent):
    sets = shingle_sets(rows)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return labels(ids, links), {d: len(s) for d, s in sets.items()}


def span_cuts(rows, window=50):
    """doc_id: (words, removed, sha256 of what stays)."""
    ws = {d: words(t) for d, t in rows}
    first = {}
    for d in sorted(ws):
        for i in range(len(ws[d]) - window + 1):
            first.setdefault(tuple(ws[d][i : i + window]), d)
    out = {}
    for d, w in ws.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def minimax(sizes, shards):
    def greedy(capacity):
        out, used = [0], 0
        for s in sizes:
            if used + s > capacity:
                out.append(0)
                used = 0
            used += s
            out[-1] += 1
        return out

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if len(greedy(mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return low, greedy(low)
