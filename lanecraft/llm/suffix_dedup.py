"""Repeated passages by longest-previous-factor arrays.

A passage is a string of at least ``LENGTH`` bytes that starts at two places of the corpus (matches do not
cross documents).  Suffixes are only compared where they can match:

1. *Anchors.*  Each window of LENGTH bytes is represented by the least hash among its ``GRAM``-byte grams
   (the leftmost of equal ones).  Equal windows have equal anchors at equal offsets, so windows are dealt
   by anchor hash; consecutive windows with one anchor form a context (their union of bytes).
2. *Counting.*  Contexts whose anchor occurs once in the corpus hold no repeat and go.  Contexts that equal
   another byte for byte (64-bit digests, compared among those of one 64-bit anchor) repeat as a whole.
3. *Suffix order.*  One copy of every distinct context of the remaining anchors is fetched.  Tasks sort the
   suffixes at its window starts (to LENGTH bytes), take common prefixes of neighbours, and from previous
   and next smaller positions in suffix order the longest previous (and next) factors.
4. Bytes covered by a window whose factor reaches LENGTH are cut: with ``keep="first"`` those of later
   copies (previous factors), with ``keep="none"`` those of all copies.

An anchor with more than ``HOT_CONTEXTS`` distinct contexts (a passage inside a large share of all
documents) is not sorted in one task: its windows are counted as digests, with map-side combination.

Texts meet their lists of wanted contexts, and later their spans, by a broadcast of the list while its
measured size is at most ``BROADCAST_BYTES``; beyond it texts are shuffled, compressed.

Documents are known by id and a digest of their text.  Null text is empty; texts shorter than LENGTH never
match.  Repeated rows are copies of each other.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lanecraft.llm.common import BROADCAST_BYTES, GROUP_BYTES, column, grouped, partitions, side_bytes, sized, stage, text_bytes
from lanecraft.llm.shingles import mix64

LENGTH = 200
GRAM = 64
HOT_CONTEXTS = 4096
#: Window starts sorted at once (LENGTH bytes each).
SORT_ROWS = 25_000

U = np.uint64
_POS = 24  # low bits of a key hold the position inside a slice of a batch
_SLICE = 1 << 19
_BYTE = np.random.Generator(np.random.PCG64(8)).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, by doubling."""
    cur, mult, size = _BYTE[raw], U(0x9E3779B97F4A7C15), 1
    done, have = None, 0
    while True:
        if k & size:
            n = len(raw) - have - size + 1
            done = cur[:n] if done is None else done[:n] * mult + cur[have:have + n]
            have += size
        if 2 * size > k:
            return mix64(done)
        n = len(cur) - size
        cur, mult, size = cur[:n] * mult + cur[size:size + n], mult * mult, 2 * size


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first start, last start) of the runs of windows with one anchor, by position."""
    gram = min(gram, length)
    if len(raw) < length:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = gram_hashes(raw, gram)
    low = U((1 << _POS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=U)
    wide, size, cur = length - gram + 1, 1, key
    while 2 * size <= wide:
        cur, size = np.minimum(cur[:-size], cur[size:]), 2 * size
    n = len(key) - wide + 1
    anchor = (np.minimum(cur[:n], cur[wide - size:wide - size + n]) & low).astype(np.int64)
    edge = np.zeros(len(raw) + 1, np.int32)  # starts whose window stays inside its text
    begin, end = offsets[:-1], offsets[1:]
    ok = end - begin >= length
    np.add.at(edge, begin[ok], 1)
    np.add.at(edge, end[ok] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return h[anchor[at]], start[at], start[np.append(at[1:], len(start)) - 1] if len(at) else start


def factors(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous, longest next factor) of suffixes given by position, as rows of bytes.

    Suffixes are sorted (stable, so equal ones stay in order of position); a previous factor comes from the
    nearest smaller position above or below in suffix order, a next factor from the nearest larger one.
    """
    n, length = windows.shape
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    sorted_ = windows[order]
    same = sorted_[1:] == sorted_[:-1]
    lcp = np.where(same.all(1), length, same.argmin(1))
    out = []
    for pos in (order, n - 1 - order):  # smaller positions, then larger ones (mirrored)
        best = np.zeros(n, np.int64)
        for step in (1, -1):  # the nearest smaller position above, then below
            p, common = (pos, lcp) if step == 1 else (pos[::-1], lcp[::-1])
            near = np.arange(n) - 1
            reach = np.concatenate([[0], common])
            link, held = near.copy(), reach.copy()
            while True:
                wrong = np.flatnonzero((near >= 0) & (reach >= length))
                wrong = wrong[p[near[wrong]] > p[wrong]]
                if not len(wrong):
                    break
                # jump over the larger position; below `length` the common prefix no longer matters
                reach[wrong] = np.minimum(reach[wrong], held[near[wrong]])
                near[wrong] = link[near[wrong]]
                link, held = near.copy(), reach.copy()
            found = np.where((near >= 0) & (p[np.maximum(near, 0)] < p), reach, 0)
            best = np.maximum(best, found if step == 1 else found[::-1])
        by_position = np.empty(n, np.int64)
        by_position[order] = best
        out.append(by_position)
    return out[0], out[1]


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans; touching ones become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), ends[np.append(at[1:], len(starts)) - 1].tolist()))


def _slices(offsets: np.ndarray, length: int):
    """Byte ranges (first text, last text, from, to) of bounded size; a long text is cut with an overlap of
    length - 1 bytes, so every window lies in exactly one range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1)
        if offsets[j] - offsets[i] <= _SLICE:
            yield i, j, int(offsets[i]), int(offsets[j])
        else:
            for lo in range(int(offsets[i]), int(offsets[j]), _SLICE):
                yield i, i + 1, lo, min(int(offsets[j]), lo + _SLICE + length - 1)
        i = j


def _anchor_rows(docs: DataFrame, kind: str, length: int) -> DataFrame:
    def run(batches):
        for batch in grouped(batches, "text", GROUP_BYTES):
            raw, offsets = text_bytes(batch.column(2))
            for i, j, lo, hi in _slices(offsets, length):
                own = np.clip(offsets[i:j + 1], lo, hi) - lo
                part = raw[lo:hi]
                key, first, last = contexts(part, own, length)
                text = part.tobytes()
                digest = np.array([xxhash.xxh3_64_intdigest(text[a:b + length]) for a, b in zip(first.tolist(), last.tolist())], U)
                doc = i + np.searchsorted(own, first, side="right") - 1
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array((first + lo - offsets[doc]).astype(np.int32)),
                     pa.array((last - first + 1).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(digest.view(np.int64))],
                    names=["doc", "th", "start", "count", "key", "c"])

    return docs.select("doc", "th", "text").mapInArrow(
        run, f"doc {kind}, th binary, start int, count int, key bigint, c bigint")


_WANT = np.dtype([("key", "<i8"), ("start", "<i4"), ("count", "<i4")])


def _per_document(rows: DataFrame, kind: str, columns: list[str], pack) -> DataFrame:
    """(doc, th, data): the rows of a document as one packed binary value (bounded by its length)."""
    listed = rows.groupBy("doc", "th").agg(F.collect_list(F.struct(*columns)).alias("rows"))

    def run(batches):
        for batch in batches:
            col = batch.column(2)
            fields = [col.values.field(i).to_numpy() for i in range(len(columns))]
            at = np.asarray(col.offsets)
            data = [pack(*(f[lo:hi] for f in fields)) for lo, hi in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc", "th", "data"])

    return stage(listed.mapInArrow(run, f"doc {kind}, th binary, data binary"), "lists")


def _pack_wants(key, start, count) -> bytes:
    out = np.empty(len(key), _WANT)
    out["key"], out["start"], out["count"] = key, start, count
    return out.tobytes()


def _pack_spans(start, end) -> bytes:
    return np.array(merge(start.astype(np.int64), end.astype(np.int64)), "<i4").tobytes()


def _meet(docs: DataFrame, lists: DataFrame, how: str, limit: int) -> DataFrame:
    """``docs`` (with a ``text``) joined with the lists of :func:`_per_document`, on document and digest."""
    same = docs["doc"].eqNullSafe(lists["doc"]) & (docs["th"] == lists["th"])
    if side_bytes(lists, 96, "data") <= limit:
        return docs.join(F.broadcast(lists), same, how).select(*[docs[c] for c in docs.columns], "data")
    fields = [f for f in docs.schema.fields if f.name != "text"]

    def squeeze(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in grouped(batches, "text"):
            raw, offsets = text_bytes(batch.column(0))
            small = [press.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(small, pa.binary()), *batch.columns[1:]], names=["text", *[f.name for f in fields]])

    small = docs.select("text", *[f.name for f in fields]).mapInArrow(squeeze, T.StructType([T.StructField("text", T.BinaryType()), *fields]))
    same = small["doc"].eqNullSafe(lists["doc"]) & (small["th"] == lists["th"])
    return small.join(lists, same, how).select(*[small[c] for c in docs.columns], "data")


def _texts(column: pa.Array) -> list[bytes]:
    """The texts' bytes, of a text column or a compressed one."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        press = zstandard.ZstdDecompressor()
        return [press.decompress(x) for x in column.to_pylist()]
    raw, offsets = text_bytes(column)
    return [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]


def _fetch(docs: DataFrame, wanted: DataFrame, kind: str, length: int, limit: int) -> DataFrame:
    """The bytes of the wanted contexts (doc, th, key, start, count)."""
    def run(batches):
        for batch in batches:
            row, parts, data = [], [], []
            for i, (text, wants) in enumerate(zip(_texts(batch.column(2)), batch.column(3).to_pylist())):
                own = np.frombuffer(wants, _WANT)
                parts.append(own)
                row += [i] * len(own)
                data += [text[a:a + n + length - 1] for a, n in zip(own["start"].tolist(), own["count"].tolist())]
            own = np.concatenate(parts) if parts else np.empty(0, _WANT)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(own["start"].copy()), pa.array(own["count"].copy()),
                 pa.array(own["key"].copy()), pa.array(data, pa.binary())],
                names=["doc", "th", "start", "count", "key", "data"])

    lists = _per_document(wanted, kind, ["key", "start", "count"], _pack_wants)
    return _meet(docs.select("doc", "th", "text"), lists, "inner", limit).mapInArrow(
        run, f"doc {kind}, th binary, start int, count int, key bigint, data binary")


def _sort_suffixes(found: DataFrame, kind: str, length: int, keep: str) -> DataFrame:
    """(doc, th, start, end) spans of windows with a factor of ``length`` among contexts of one anchor."""
    def spans(rows: pa.Table):
        doc, th, start, count, _, data = (rows.column(i) for i in range(6))
        start, count = (c.to_numpy().astype(np.int64) for c in (start, count))
        flat, at = text_bytes(pa.concat_arrays(data.chunks) if data.num_chunks != 1 else data.chunk(0))
        owner = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        windows = np.lib.stride_tricks.sliding_window_view(flat, length)[at[:-1][owner] + nth]
        previous, following = factors(windows)
        repeat = previous >= length if keep == "first" else (previous >= length) | (following >= length)
        joined = repeat[1:] & repeat[:-1] & (owner[1:] == owner[:-1])
        lo = np.flatnonzero(repeat & ~np.concatenate([[False], joined]))
        hi = np.flatnonzero(repeat & ~np.concatenate([joined, [False]]))
        own = owner[lo]
        pick = pa.array(own)
        take = lambda c: pa.concat_arrays(c.take(pick).chunks) if len(own) else pa.array([], c.type)
        return pa.RecordBatch.from_arrays([take(doc), take(th), pa.array((start[own] + nth[lo]).astype(np.int32)), pa.array((start[own] + nth[hi] + length).astype(np.int32))],
                                          names=["doc", "th", "start", "end"])

    def run(batches):
        """Rows come sorted by key, document and start; whole anchors are sorted together."""
        held, size = [], 0
        for batch in batches:
            key = batch.column(4).to_numpy()
            cuts = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            if held and len(key) and held[-1].column(4)[-1].as_py() != key[0] and size >= SORT_ROWS:
                yield spans(pa.Table.from_batches(held))
                held, size = [], 0
            lo = 0
            starts = np.cumsum(batch.column(3).to_numpy())
            for hi in cuts[:-1].tolist():
                if size + int(starts[hi - 1] - (starts[lo - 1] if lo else 0)) >= SORT_ROWS:
                    held.append(batch.slice(lo, hi - lo))
                    yield spans(pa.Table.from_batches(held))
                    held, size, lo = [], 0, hi
            if lo < len(key):
                held.append(batch.slice(lo))
                size += int(starts[-1] - (starts[lo - 1] if lo else 0))
        if held:
            yield spans(pa.Table.from_batches(held))

    n = partitions(found.sparkSession)
    found = found.select("doc", "th", "start", "count", "key", "data")  # read by place; a join by name puts the key first
    return found.repartition(n, "key").sortWithinPartitions("key", "doc", "th", "start") \
        .mapInArrow(run, f"doc {kind}, th binary, start int, end int")


def _count_windows(found: DataFrame, kind: str, length: int, keep: str) -> DataFrame:
    """The same for anchors with very many contexts: windows as digests, counted with partial aggregation."""
    def run(batches):
        for batch in batches:
            row, start, digest = [], [], []
            for i, (s, n, data) in enumerate(zip(*(batch.column(j).to_pylist() for j in (2, 3, 4)))):
                row += [i] * n
                start += range(s, s + n)
                digest += [xxhash.xxh3_128_digest(data[x:x + length]) for x in range(n)]
            at = pa.array(row, pa.int64())
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])],
                                             names=["doc", "th", "start", "d1", "d2"])

    windows = found.select("doc", "th", "start", "count", "data").mapInArrow(run, f"doc {kind}, th binary, start int, d1 bigint, d2 bigint")
    first = F.min(F.struct("doc", "th", "start")).alias("first")
    many = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    hit = windows.join(many, ["d1", "d2"])
    if keep == "first":
        hit = hit.where(F.struct("doc", "th", "start") != F.col("first"))
    return hit.select("doc", "th", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "first", hot: int = HOT_CONTEXTS,
                   limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, th, data) of the documents (doc, th, text) that lose bytes; data: packed (start, end) pairs."""
    kind = docs.schema["doc"].dataType.simpleString()
    rows = _anchor_rows(docs, kind, length)  # computed twice: cheaper than keeping every anchor on disk
    place, first = F.struct("doc", "th", "start"), keep == "first"
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"),
                                   *([F.min(place).alias("first")] if first else [])).where("n > 1")
    # staged, so that both sides of the join have an exchange of their own and hot anchors can be split
    keys = stage(held.select("key", (F.col("lo") == F.col("hi")).alias("one"), *(["first"] if first else [])), "keys")
    later = (place != F.col("first")) if first else F.lit(True)
    end = (F.col("start") + F.col("count") + length - 1).alias("end")
    mixed = F.when(~F.col("one"), F.col("key")).alias("key"), F.when(~F.col("one"), F.col("c")).alias("c")
    shared = stage(rows.join(keys, "key").where(~F.col("one") | later).select("doc", "th", "start", "count", *mixed), "shared")
    whole = shared.where("key is null").select("doc", "th", "start", end)
    open_ = shared.where("key is not null")
    classes = stage(open_.groupBy("key", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "th", "start", "count")).alias("x"))
                    .select("key", "c", "copies", "x.*"), "classes")
    copied = stage(classes.where("copies > 1").select("key", "c", place.alias("first")), "copied")
    copies = open_.join(sized(copied, 96), ["key", "c"]).where(later).select("doc", "th", "start", end)
    found = _fetch(docs, classes.select("doc", "th", "key", "start", "count"), kind, length, limit) \
        .dropDuplicates(["key", "doc", "th", "start"])  # a repeated row gives its contexts once
    found = stage(found, "contexts")
    large = stage(classes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("key"), "hot")
    if large.isEmpty():
        inner = _sort_suffixes(found, kind, length, keep)
    else:
        inner = _sort_suffixes(found.join(large, "key", "left_anti"), kind, length, keep).unionByName(
            _count_windows(found.join(large, "key", "left_semi"), kind, length, keep))
    return _per_document(whole.unionByName(copies).unionByName(inner), kind, ["start", "end"], _pack_spans)


def text_digest(doc: Column, text: Column) -> Column:
    """Tells the texts of one id apart: 64 bits, 128 among the rows without an id (they are all one id)."""
    return F.when(doc.isNull(), F.unhex(F.md5(text))).otherwise(F.unhex(F.hex(F.xxhash64(text))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "first",
                   hot: int = HOT_CONTEXTS, with_text: bool = True, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``with_text``, the kept
    text (characters cut in the middle are dropped from it) under ``text``, with the other columns in
    ``row``."""
    other = [c for c in docs.columns if c not in (id_col, text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = docs.select(F.col(id_col).alias("doc"), text_digest(F.col(id_col), text).alias("th"), text.alias("text"),
                        F.struct(F.lit(0).alias("_"), *[column(c) for c in (other if with_text else [])]).alias("row"))
    kind = known.schema["doc"].dataType.simpleString()
    cut = repeated_spans(known.select("doc", "th", "text"), length, keep, hot, limit)
    rows = _meet(known, cut, "left", limit).select("doc", "text", "row", "data")

    def run(batches):
        for batch in batches:
            total, removed, runs, sha, kept = [], [], [], [], []
            for data, spans in zip(_texts(batch.column(1)), batch.column(3).to_pylist()):
                gone = np.frombuffer(spans or b"", "<i4").reshape(-1, 2).tolist()
                parts, at = [], 0
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                left = b"".join(parts)
                total.append(len(data))
                removed.append(len(data) - len(left))
                runs.append(len(gone))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(kept, pa.string()), batch.column(2)],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "row"])

    fields = T.StructType([known.schema["doc"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
                           *[T.StructField(n, T.StringType()) for n in ("kept_sha256", "text")], T.StructField("row", known.schema["row"].dataType)])
    out = rows.mapInArrow(run, fields)
    return out.select(F.col("doc").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text", "row"] if with_text else []))
