"""Brute-force versions of the training-data operators, for small inputs."""

import collections
import hashlib
import re

import numpy as np
import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pandas()


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def roots(ids, links):
    """Smallest id reachable by links (pairs of positions)."""
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return [ids[find(i)] for i in range(len(ids))]


def near_pairs(texts, percent):
    sets = [shingles(t) for t in texts]
    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in held[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                yield j, i
        for x in s:
            held[x].append(i)


def repeats(texts, length=200, keep="none"):
    """(n_bytes, n_removed, n_spans, sha256 of the kept bytes, kept bytes) per text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    first, out = set(), []
    for b in data:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if seen[w] > 1 and (keep == "none" or w in first):
                mark[i] += 1
                mark[i + length] -= 1
            first.add(w)
        gone = np.cumsum(mark)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out
