"""Word shingles of whole texts as 64-bit hashes, vectorised over the UTF-8 bytes of a batch.

Words are maximal runs of non-white-space (ASCII white space), A-Z lower-cased.  A text's set holds its
distinct ``k``-word shingles; a text with fewer words has its whole sequence as one; a text without words
has none.  All hashes depend on the words and their order only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lanecraft.llm.common import text_bytes

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = U(0x9E3779B97F4A7C15)  # odd: invertible modulo 2^64
_BACK = U(pow(int(_STEP), -1, 2**64))
_BLOCK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWER = np.cumprod(np.concatenate([[U(1)], np.full(_BLOCK, _STEP)]))
_UNDO = np.cumprod(np.concatenate([[U(1)], np.full(_BLOCK, _BACK)]))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the total at the end)."""
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]  # a text's edge is a word's edge
    begins[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(b), U)
    at = 0
    while at < len(b):  # blocks of bytes: prefix sums of byte * step^i, undone at the word's begin
        lo = int(b[at])
        to = max(at + 1, int(np.searchsorted(e, lo + _BLOCK, side="right")))
        hi = int(e[to - 1])
        if hi - lo > _BLOCK:  # one huge word
            h = U(0)
            for x in range(lo, hi, _BLOCK):
                part = _BYTE[raw[x:min(hi, x + _BLOCK)]]
                h = mix64(np.array([h ^ (part * _POWER[:len(part)]).sum(dtype=U)], U))[0]
            out[at] = h
        else:
            sums = np.concatenate([[U(0)], np.cumsum(_BYTE[raw[lo:hi]] * _POWER[:hi - lo])])
            out[at:to] = (sums[e[at:to] - lo] - sums[b[at:to] - lo]) * _UNDO[b[at:to] - lo]
        at = to
    return mix64(out ^ (e - b).astype(U)), np.searchsorted(b, offsets, side="left")


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; offsets of the texts)."""
    raw, offsets = text_bytes(column)
    with np.errstate(over="ignore"):
        w, first = words(raw, offsets)
        n = np.diff(first)
        full = np.zeros(max(0, len(w) - k + 1), U)
        for j in range(k):
            full = (full ^ w[j:j + len(full)]) * _STEP + U(j + 1)
        full = mix64(full)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = first[:-1][owner] + nth
        h = full[np.minimum(at, max(0, len(full) - 1))] if len(full) else np.zeros(len(at), U)
        for i in np.flatnonzero((n > 0) & (n < k)):  # the whole sequence as one
            x = U(n[i])
            for v in w[first[i]:first[i + 1]]:
                x = (x ^ v) * _STEP + U(17)
            h[np.searchsorted(owner, i)] = mix64(np.array([x]))[0]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))
