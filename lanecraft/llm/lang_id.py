"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded reference text (``rows_per_lang`` labelled rows,
``ref_bytes`` bytes).  A text is cut greedily into the longest phrases that occur in the reference; with m
phrases over n symbols and a reference of N symbols the cross entropy is about m * log2(N) / n bits a
symbol.  The language needing the fewest normalised phrases wins, ties go to the smaller name.

Texts are lower-cased UTF-8 bytes with every run of ASCII non-letters as one space.  Whole texts are
parsed; they are laid out as lanes of ``LANE`` bytes (a phrase ends at a lane's end, for every language
alike) and all lanes of a batch advance together, one symbol at a time, through one transition table.

Null texts and texts without a letter give ``und`` with score 0; so does everything when no labelled row
exists.  Score: 1 - best/second entropy (1 with a single learned language).  Rows are independent, so
repeated rows agree.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lanecraft.llm.common import column, grouped, text_bytes

ROWS_PER_LANG = 96
REF_BYTES = 16_384
LANE = 2048
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with ASCII non-letters folded into single zeros, and the texts' offsets."""
    raw, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
    sym = np.where(_LETTER[raw], raw, 0).astype(np.uint8)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    starts = offsets[:-1]
    keep[starts[starts < len(sym)]] = True
    return sym[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def suffix_automaton(symbols: bytes, width: int) -> np.ndarray:
    """Transition table (states x width) of the suffix automaton, -1 for none; state 0 is the start."""
    follow, link, length = [[-1] * width], [-1], [0]
    last = 0
    for c in symbols:
        cur = len(follow)
        follow.append([-1] * width)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and follow[p][c] < 0:
            follow[p][c] = cur
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(follow)
                follow.append(follow[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p][c] == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.array(follow, np.int64)


class Parser:
    """All languages' automata in one table: entry = 2 * (next state * width) + (a phrase starts here)."""

    def __init__(self, refs: dict[str, bytes]):
        self.langs = sorted(refs)
        used = sorted(set().union(*[set(r) for r in refs.values()]) - {0})
        self.width = len(used) + 2  # 0: space, the last: a symbol no reference holds
        self.code = np.full(256, self.width - 1, np.int64)
        self.code[0] = 0
        self.code[used] = np.arange(1, len(used) + 1)
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            t = suffix_automaton(bytes(self.code[np.frombuffer(refs[lang], np.uint8)].astype(np.uint8)), self.width)
            fresh = len(t)  # the state before any phrase: whatever comes starts one
            start = np.where(t[0] < 0, fresh, t[0])  # a symbol the reference lacks is a phrase of its own
            new = np.vstack([t < 0, np.ones((1, self.width), bool)])
            t = np.where(new, start[None, :], np.vstack([t, start[None, :]])) + base
            tables.append((t * self.width * 2 + new).astype(np.int64).ravel())
            self.roots.append((base + fresh) * self.width)
            base += fresh + 1
        table = np.concatenate(tables)
        self.table = table.astype(np.int32) if base * self.width * 2 < 2**31 else table
        self.bits = np.array([math.log2(max(2, len(refs[x]))) for x in self.langs])

    def entropies(self, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits a symbol, texts x languages (infinite for empty texts)."""
        n = np.diff(offsets)
        lanes = (n + LANE - 1) // LANE
        owner = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = offsets[:-1][owner] + nth * LANE
        size = np.minimum(LANE, offsets[1:][owner] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        codes = self.code[sym]
        kind = self.table.dtype
        state = np.repeat(np.array(self.roots, kind)[:, None], len(owner), 1)
        phrases = np.zeros(state.shape, kind)
        if len(owner):
            alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lanes longer than t
            codes = codes.astype(kind)
            for t, a in enumerate(alive.tolist()):
                step = state[:, :a] + codes[begin[:a] + t]
                got = self.table.take(step)
                phrases[:, :a] += got & 1
                np.right_shift(got, 1, out=state[:, :a])
        total = np.zeros((len(self.langs), len(n)))
        for k in range(len(self.langs)):
            total[k] = np.bincount(owner, phrases[k], len(n)) if len(owner) else 0
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n[:, None] > 0, total.T * self.bits[None, :] / n[:, None], np.inf)


@functools.lru_cache(maxsize=2)
def _parser(refs: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(dict(refs))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_lang: int = ROWS_PER_LANG, ref_bytes: int = REF_BYTES) -> tuple[tuple[str, bytes], ...]:
    """Reference texts from a bounded sample: per language the ``rows_per_lang`` rows of least id hash, each
    giving an equal share of ``ref_bytes`` normalised bytes (short rows leave their rest to the others)."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("th")) \
        .where("id is not null and text is not null and lang is not null")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "th")
    keys = {(r["lang"], r["id"], r["th"]) for r in rows.select("id", "lang", "th").withColumn("k", F.row_number().over(w))
            .where(F.col("k") <= rows_per_lang).select("lang", "id", "th").distinct().collect()}
    if not keys:
        return ()
    picked: dict[str, list[bytes]] = {}
    # of a sampled row no more comes to the driver than the longest share it can give (normalising never makes four of one)
    sampled = rows.where(F.col("id").isin([k[1] for k in keys]) & F.col("th").isin([k[2] for k in keys]))
    cut = sampled.groupBy("lang", "id", "th").agg(F.min(F.substring("text", 1, 4 * ref_bytes)).alias("text"))
    for r in sorted({(r["id"], r["text"], r["lang"]) for r in cut.collect() if (r["lang"], r["id"], r["th"]) in keys}):
        sym, _ = normalise(pa.array([r[1]], pa.string()))
        if (sym != 0).any():
            picked.setdefault(r[2], []).append(sym.tobytes())
    refs = []
    for lang, texts in sorted(picked.items()):
        texts.sort(key=len)
        left, parts = ref_bytes, []
        for i, t in enumerate(texts):
            part = t[:left // (len(texts) - i)]
            parts.append(part)
            left -= len(part)
        refs.append((lang, b"\0".join(parts)))
    return tuple(refs)


def predict(docs: DataFrame, refs: tuple[tuple[str, bytes], ...], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` + lang_pred, score, bits (entropy under the winner), one row per row of ``docs``."""
    rows = docs.select(F.struct(*[column(c) for c in id_cols]).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        parser = _parser(refs) if refs else None
        for batch in grouped(batches, "text"):
            text = batch.column(1)
            lettered = pc.match_substring_regex(text.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            n = len(text)
            lang, score, bits = [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan)
            if parser and lettered.any():
                h = parser.entropies(*normalise(text))
                best = h.argmin(1)
                first = h[np.arange(n), best]
                h[np.arange(n), best] = np.inf
                second = h.min(1) if h.shape[1] > 1 else np.full(n, np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where(np.isfinite(second), 1 - first / second, 1.0)
                ok = lettered & np.isfinite(first)
                score[ok], bits[ok] = s[ok], first[ok]
                for i in np.flatnonzero(ok):
                    lang[i] = parser.langs[best[i]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits, from_pandas=True)],
                names=["id", "lang_pred", "score", "bits"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                             T.StructField("bits", T.DoubleType())]))
    return out.select(*[F.col("id").getField(c).alias(c) for c in id_cols], "lang_pred", "score", "bits")
