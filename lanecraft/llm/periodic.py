"""Periodic runs of words: where a text repeats one stretch of words over and over.

A run is a stretch of words with smallest period q (words q apart are identical) of at least ``REPEATS`` periods and
``LEAST`` words that no neighbouring word extends.  Periods are searched by octave: the periods from S = 2^k to 2S - 1
are found from boundaries S words apart.  A run of period q holds at least 3q >= 3S places whose word returns q words
later, so some boundary in it is followed by 2S such places: rolling hashes of 2S words show the boundaries and periods
worth a look, and Z-functions from such a boundary, forwards and backwards, give the exact stretch (a *fragment*) that a
tile shows.  A tile is a piece of a document for one or several octaves: long documents are exploded into overlapping
tiles, longer ones for longer periods, each solved by itself.  Spark then brings the fragments of one document and
period together and stitches overlapping ones.

Words are compared exactly (numbers given per document), never by their hashes alone.  A period that is a multiple of a
smaller one is left out where it is found: its first q words are themselves a power of a shorter stretch.

Defined results: a null or empty text has no words and no run.  Rows are told apart by the digest of their words, so
equal texts share their runs and repeated rows are worked on once a task.  Texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanecraft.llm.common import grouped, partitions, release, sized, stage

REPEATS, LEAST = 4, 6
#: Words in the core of a tile; octaves from 2^k on whose 16 * 2^k words are more have longer tiles.
CORE = 1 << 13
#: Words of a tile beyond its core, in units of the octave's S.
MARGIN = 7
#: Texts from this many bytes on are exploded into tiles that Spark deals out over all tasks.
LONG_BYTES = 1 << 18
#: Words that are solved together at once.
TOGETHER = 1 << 17

TILES = "key binary, first long, low int, high int, words binary"
FRAGMENTS = "key binary, period long, lo long, hi long"


# ── words ────────────────────────────────────────────────────────────────────

def split(text: str | bytes | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09 to 0x0D), which is what bytes.split parts at."""
    return (text.encode() if isinstance(text, str) else text or b"").split()


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, of one document."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def wrapped(words: list, start: int, period: int) -> list:
    """Each word from ``start`` on becomes the one of the first ``period`` words there that its place falls on."""
    tail = words[start:start + period]
    more = len(words) - start
    return words[:start] + (tail * (more // len(tail) + 1))[:more]


# ── tiles ────────────────────────────────────────────────────────────────────

def tiles(n: int, core: int = CORE) -> list[tuple[int, int, int, int]]:
    """(first word, end, lowest octave, octave after the highest) of the tiles of a document of n words."""
    top = max(0, (n // REPEATS).bit_length())  # periods up to n / 4
    if n < LEAST or not top:
        return []
    out, low = [], 0
    while low < top:
        size = max(core, 16 << low)
        high = low + 1
        while high < top and (max(core, 16 << high) == size or size >= n):
            high += 1
        over = MARGIN << (high - 1)
        out += [(at, min(n, at + size + over), low, high) for at in range(0, n if size < n else 1, size)]
        low = high
    return out


def explode(docs: DataFrame, text: str = "text", key: str = "key", rule=None, core: int = CORE) -> DataFrame:
    """Tiles of the documents, as rows.  ``rule(words, extra)`` may change the words first (column ``extra``)."""

    def run(batches):
        for batch in grouped(batches, text):
            rows = []
            for k, t, x in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words = split(t)
                ids = numbers(rule(words, x) if rule else words)
                rows += [(k, a, low, high, ids[a:b].tobytes()) for a, b, low, high in tiles(len(ids), core)]
                if sum(len(r[4]) for r in rows[-64:]) > 1 << 22 or len(rows) > 4096:
                    yield _tiles(rows)
                    rows = []
            if rows:
                yield _tiles(rows)
        release()

    extra = F.col("extra") if "extra" in docs.columns else F.lit(None).cast("int").alias("extra")
    return docs.select(F.col(text), F.col(key), extra).select(key, text, "extra").mapInArrow(run, TILES)


def _tiles(rows) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "first", "low", "high", "words"])


# ── one tile ─────────────────────────────────────────────────────────────────

def z_function(x: list[int], most: int) -> list[int]:
    """Per place the length of the longest common prefix of the list and its rest from there (at most ``most``)."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while k < most and i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def primitive(forward: np.ndarray, lags: np.ndarray, s: int) -> np.ndarray:
    """The lags whose stretch is not a shorter one several times over (``forward``: Z-function from its first word)."""
    short = np.flatnonzero(forward[1:s] >= s)
    if len(short):  # the multiples of the shortest return, at once
        p = int(short[0]) + 1
        lags = lags[(lags % p != 0) | (lags == p) | (forward[p] < lags - p)]
    return np.array([q for q in lags.tolist() if all(forward[q // d] < q - q // d for d in divisors(q))], np.int64)


def divisors(n: int) -> list[int]:
    """The prime divisors of n."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def is_power(root: np.ndarray) -> bool:
    """True if the stretch is a shorter one several times over."""
    return any(np.array_equal(root[len(root) // p:], root[:-(len(root) // p)]) for p in divisors(len(root)))


def boundary(words: np.ndarray, at: int, s: int, lags: np.ndarray) -> list[tuple[int, int, int]]:
    """(lag, places back, places on) per lag that is no multiple: how far back (at most s) and on (at most 4s) from
    ``at`` the word returns ``lag`` later."""
    if len(lags) <= 8:  # a look at each is less work than the Z-function
        lags = lags[[not is_power(words[at:at + q]) for q in lags.tolist()]]
        if not len(lags):
            return []
    forward = np.array(z_function(words[at:at + 6 * s].tolist(), 4 * s))
    lags = primitive(forward, lags[forward[lags] >= 2 * s], s)
    if not len(lags):
        return []
    first = max(0, at - s)
    back = words[first:at].tolist()[::-1]
    shown = words[first:at + 2 * s].tolist()[::-1]
    backward = z_function([*back, -1 << 40, *shown], s)  # the mark is no word's number
    skip = len(back) + 1 + len(shown) - (at - first)
    return [(q, backward[skip - q] if back else 0, int(forward[q])) for q in lags.tolist()]


def octave(words: np.ndarray, rolled: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """(lag, first place, end) of the fragments of the periods s to 2s - 1; ``rolled``: hashes of 2s words from each place."""
    centres = np.arange(0, len(rolled) - s, s)
    if not len(centres):
        return []
    found: list[tuple[int, int, int]] = []
    block = max(1, (1 << 20) // s)
    for i in range(0, len(centres), block):
        c = centres[i:i + block]
        # the last boundaries see fewer lags
        at = c[:, None] + np.arange(s, 2 * s)[None, :]
        same = (rolled[np.minimum(at, len(rolled) - 1)] == rolled[c][:, None]) & (at < len(rolled))
        rows, lags = np.nonzero(same)
        hit, first = np.unique(rows, return_index=True)
        for row, own in zip(hit.tolist(), np.split(lags + s, first[1:])):
            for q, back, on in boundary(words, int(c[row]), s, own):
                if on == 4 * s or back == s or back + on >= 3 * q:
                    found.append((q, int(c[row]) - back, int(c[row]) + on))
    return found


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one lag that meet or overlap become one."""
    out: list[tuple[int, int, int]] = []
    for q, lo, hi in sorted(found):
        if out and out[-1][0] == q and lo <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(hi, out[-1][2]))
        else:
            out.append((q, lo, hi))
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def fragments(words: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """Fragments of the periods from 2^low to 2^high - 1 in a row of word numbers."""
    with np.errstate(over="ignore"):
        rolled = (words.astype(np.uint64) + np.uint64(1)) * _MIX
        rolled ^= rolled >> np.uint64(29)
        found, size = [], 1
        for k in range(high):
            s = 1 << k
            while size < 2 * s and len(rolled) > size:  # of two halves
                rolled = (rolled[:-size] * np.uint64(0xBF58476D1CE4E5B9) ^ (rolled[size:] >> np.uint64(31))) + rolled[size:] * _MIX
                size *= 2
            if size < 2 * s or len(rolled) <= s:
                break
            if k >= low:
                found += merged(octave(words, rolled, s))
    return found


def solve(cut: DataFrame) -> DataFrame:
    """Fragments of the tiles.  Tiles of the same octaves are solved together, a mark of its own after each."""

    def flush(held):
        if not held:
            return
        low, high = held[0][2], max(h[3] for h in held)
        parts, starts, at = [], [], 0
        for i, (_, _, _, _, w) in enumerate(held):
            ids = np.frombuffer(w, np.int32).astype(np.int64)
            parts += [ids, np.array([-2 - i])]
            starts.append(at)
            at += len(ids) + 1
        found = fragments(np.concatenate(parts), low, high)
        if not found:
            return
        q, lo, hi = (np.array(x, np.int64) for x in zip(*found))
        own = np.searchsorted(starts, lo, side="right") - 1
        shift = np.array([h[1] for h in held], np.int64)[own] - np.array(starts, np.int64)[own]
        keys = pa.array([held[i][0] for i in own.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, pa.array(q), pa.array(lo + shift), pa.array(hi + shift)], ["key", "period", "lo", "hi"])

    def run(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                low = row[2]
                held.setdefault(low, []).append(row)
                size[low] = size.get(low, 0) + len(row[4]) // 4
                if size[low] >= TOGETHER:
                    yield from flush(held.pop(low))
                    size[low] = 0
        for rows in held.values():
            yield from flush(rows)
        release()

    return cut.mapInArrow(run, FRAGMENTS)


# ── stitching ────────────────────────────────────────────────────────────────

def stitch(found: DataFrame) -> DataFrame:
    """Runs (key, start, length, period): the fragments of one document and period that meet or overlap, joined."""
    once = found.groupBy("key", "period", "lo").agg(F.max("hi").alias("hi"))
    own = Window.partitionBy("key", "period").orderBy("lo")
    reach = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = once.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
    parts = parts.withColumn("part", F.sum("new").over(own))
    joined = parts.groupBy("key", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("period")
    return joined.select("key", "start", length.alias("length"), "period").where(
        (F.col("length") >= LEAST) & (F.col("length") >= REPEATS * F.col("period")))


def runs(docs: DataFrame, text: str = "text", key: str = "key", rule=None, core: int = CORE, long_bytes: int = LONG_BYTES) -> DataFrame:
    """All periodic runs of the texts: key, start, length, period.  ``key`` (binary) tells the documents apart."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    short = solve(explode(docs.where(size < long_bytes), text, key, rule, core))
    dealt = explode(docs.where(size >= long_bytes), text, key, rule, core).repartition(partitions(docs.sparkSession))
    return stitch(short.unionByName(solve(dealt)))


# ── results per document ─────────────────────────────────────────────────────

def best(found: list[tuple[int, int, int]]):
    """The (start, length, period) of greatest length / period; ties: smallest start, then period."""
    top = None
    for run in found:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist()) if s]


OUT = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
       "runs_sha256 string, collapsed_sha256 string")


def with_runs(docs: DataFrame, found: DataFrame, id_col: str, id_type: str, rule=None, with_text: bool = False) -> DataFrame:
    """Per document: counts, its strongest run and digests (``with_text``: the collapsed text too).  ``docs``: id, text, key, extra."""
    lists = stage(found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")), "runs")
    flat = lists.select("key", F.flatten(F.transform("runs", lambda r: F.array(r["start"], r["length"], r["period"]))).alias("runs"))
    held = flat.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0)), F.count(F.lit(1))).first()
    side = F.broadcast(flat) if held[0] * 8 + held[1] * 48 <= BROADCAST else flat
    joined = docs.join(side, "key", "left").select(F.col(id_col), "text", "extra", "runs")

    def run(batches):
        for batch in grouped(batches, "text"):
            ids, cols = batch.column(0), []
            for t, x, r in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                words = split(t)
                if rule:
                    words = rule(words, x)
                own = list(zip(r[::3], r[1::3], r[2::3])) if r else []
                top = best(own)
                text = b" ".join(kept(words, own) if own else words)
                listed = "".join(f"{a},{b},{q}\n" for a, b, q in own)
                cols.append((len(words), len(own), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                             hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
                             *([text.decode()] if with_text else [])))
            kinds = [pa.int64()] * 6 + [pa.string()] * (3 if with_text else 2)
            names = [c.split()[0] for c in OUT.split(", ")] + ["text"] * with_text
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(zip(*cols), kinds)]], [batch.schema.names[0], *names])

    return joined.mapInArrow(run, f"{id_col} {id_type}, {OUT}" + ", text string" * with_text)


#: Bytes of run lists that are broadcast to the texts; beyond, texts and lists meet by a shuffle.
BROADCAST = 48 << 20


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", extra: Column | None = None, rule=None,
                  with_text: bool = False, **options) -> DataFrame:
    """Per document of ``docs``: id_col, n_words, n_runs, the strongest run, digests (see ``with_runs``).

    ``rule(words, extra)`` changes the words of a document before the search; it has to depend on nothing else."""
    extra = F.lit(None).cast("long") if extra is None else extra
    whole = F.concat(F.coalesce(extra.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    keyed = docs.select(F.col(id_col), F.col(text).alias("text"), F.unhex(F.md5(whole)).alias("key"), extra.alias("extra"))
    found = runs(keyed.select("text", "key", "extra"), rule=rule, **options)
    return with_runs(keyed, found, id_col, docs.schema[id_col].dataType.simpleString(), rule, with_text)


def folded(words: list, h: int | None) -> list:
    """The test rule of the query: every tenth document repeats a stretch of its words to its end."""
    n = len(words)
    if not n or h is None or h % 10:
        return words
    g = h // 10
    start = g % n
    return wrapped(words, start, 1 + (n - start) // (3 + g % 8))


def checksum(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string"))
