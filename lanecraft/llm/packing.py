"""Best-fit packing by exact-complement hashing.

Documents become token ids (a closing id after each), texts longer than one sequence are cut into
sequence-length pieces (the first piece takes the remainder), and pieces are packed into sequences:

1. *Exact complements.*  From the longest length down, the gap it leaves is looked up among the sums of
   single lengths, pairs and triples; a combination that fills the gap exactly is consumed as often as its
   lengths are available.
2. *Best fit.*  What is left goes, longest first, into the open sequence with the least sufficient gap.

Both steps work on the histogram of piece lengths, at most ``seq_len`` numbers whatever the input, and
yield a plan: patterns of lengths with a multiplicity.  Pieces get a rank among those of their length from
counts of (length, hash bucket) groups, so a length that holds a third of all pieces is ranked in many
tasks; rank and plan give sequence and offset without moving texts.

Null text is the empty text (one closing id).  Rows are packed as they come: repeated rows are packed
repeatedly, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lanecraft.llm.common import grouped, stage

SEQ_LEN = 2048
END_ID = 0
RANK_BUCKETS = 512
#: A run of this many characters without a space goes to the library itself (its merge loop is not quadratic).
LONG_RUN = 1000

PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, as ``tokenizers`` gives them for ``path`` without added special tokens.

    Where the folder also holds the vocabulary as ranks (same name, .tiktoken), ordinary texts go through
    the faster ranks; texts that hold a special token's string or a very long run go to ``tokenizers``.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        specials = [t["content"] for t in json.load(f)["added_tokens"]]
    library: list = []  # loaded when a text needs it

    def exact(text: str) -> np.ndarray:
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(path))
        return np.array(library[0].encode(text, add_special_tokens=False).ids, np.uint32)

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return exact
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in specials) or (len(text) >= LONG_RUN and _long_run(text)):
            return exact(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def _long_run(text: str) -> bool:
    """A run of LONG_RUN characters without, or of nothing but, white space."""
    parts = text.split()
    return max(map(len, parts), default=0) >= LONG_RUN or len(text) - sum(map(len, parts)) - len(parts) >= LONG_RUN


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the little-endian 32-bit ids)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer_path)
        for batch in grouped(batches, "text"):
            at, nth, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % seq_len or min(seq_len, len(ids))
                lo, hi, k = 0, first, 0
                while lo < len(ids):
                    at.append(i)
                    nth.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                    lo, hi, k = hi, hi + seq_len, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(nth, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES.format(id=kind))


def plan(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)] for a histogram of piece lengths."""
    left = np.zeros(seq_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                left[x] -= n * k
            out.append((lengths, n))

    def pair(total: int, most: int) -> tuple[int, int] | None:
        """Available a >= b with a + b == total and a <= most; a wide pair first."""
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        b = total - a
        ok = np.flatnonzero((left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1)))
        return (int(a[ok[0]]), int(b[ok[0]])) if len(ok) else None

    if left[seq_len]:
        take((seq_len,))
    for first in range(seq_len - 1, 0, -1):
        while left[first]:
            gap = seq_len - first
            left[first] -= 1  # the piece itself is not available for its own gap
            fill: tuple[int, ...] | None = (gap,) if left[gap] else pair(gap, gap - 1)
            if fill is None:
                for a in np.flatnonzero(left[:gap - 1])[::-1].tolist():
                    left[a] -= 1
                    two = pair(gap - a, a) if gap - a > 1 else None
                    left[a] += 1
                    if two:
                        fill = (a, *two)
                        break
            left[first] += 1
            if fill is None:
                break
            take((first, *fill))
    # best fit of the rest, longest first; open: gap -> patterns with that gap
    open_: dict[int, list[list]] = defaultdict(list)
    gaps = np.zeros(seq_len + 1, bool)
    for length in range(seq_len, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                lengths, many = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
                used = min(n, many)
                if many > used:
                    open_[gap].append([lengths, many - used])
                    gaps[gap] = True
                each = 1
            else:
                gap, lengths = seq_len, ()
                each = min(seq_len // length, n)
                used = max(1, n // each)
            rest = gap - each * length
            open_[rest].append([(*lengths, *(length,) * each), used])
            gaps[rest] = rest > 0
            n -= each * used
    out += [(tuple(x), n) for held in open_.values() for x, n in held]
    return out


def _lookup(patterns: list[tuple[tuple[int, ...], int]]):
    """Per length: sorted first ranks, and for each the first sequence number and the offset there."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    seen: dict[int, int] = defaultdict(int)
    seq = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows[x].append((seen[x], seq, offset))
            seen[x] += n
            offset += x
        seq += n
    return {x: np.array(v, np.int64).T for x, v in rows.items()}


def pack(cut: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Adds sequence_id and offset to the staged pieces (with their bucket)."""
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= seq_len rows
    table = _lookup(plan(total, seq_len))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                firsts, seqs, offsets = table[x]
                k = np.searchsorted(firsts, rank[at], side="right") - 1
                seq[at] = seqs[k] + rank[at] - firsts[k]
                offset[at] = offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, PIECES.format(id=kind) + ", sequence_id bigint, offset bigint")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack; the pieces (numbers only, no text) are staged once and read twice."""
    # the bucket spreads equal lengths, even those of one repeated row; it is fixed once staged
    bucket = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(RANK_BUCKETS))
    return pack(stage(pieces(docs, tokenizer_path, id_col, text_col, seq_len, end_id).withColumn("bucket", bucket), "pieces"), seq_len)
