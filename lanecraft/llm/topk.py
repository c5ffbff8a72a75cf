"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers floor(scale * x) and packed into blocks: per dimension ("term") the
block's posting list of (row, weight).  Every query row walks its own non-zero terms and scatters weight *
posting into a dense array of the block's scores; partition selection keeps the best k of the block (ties
to the smaller id).  Query blocks meet row blocks by a shard number, each row block in one shard; the best
k per shard are merged per query.

Scores are exact integers.  Vectors that are null or hold null or non-finite components take no part.  Vectors
with a quantised component beyond ``MOST`` go to blocks of their own, kept as they came and scored in integers
of any length; a score beyond 64 bits is returned as the nearest long and ranked as such.  Shorter vectors count as
padded with zeros; an empty vector scores 0.  A row is never its own candidate, a repeated row with the same id is.
Rows without an id are candidates too, after all others of the same score.  With fewer candidates than k all
are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanecraft.llm.common import partitions, stage

K = 20
SCALE = 64
BLOCK = 8192
MOST = 2**24


def quantise(vectors: list, scale: int = SCALE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows that take part, their matrix, padded with zeros): integers of the rows whose components stay within
    ``MOST``, and the components themselves (float64) of the others."""
    kinds: tuple = ([], [], np.int64), ([], [], np.float64)
    for i, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if not np.isfinite(x).all():
            continue
        with np.errstate(over="ignore"):
            w = np.floor(x * scale)
        small = (np.abs(w) <= MOST).all()
        at, rows, _ = kinds[0 if small else 1]
        at.append(i)
        rows.append(w if small else x)
    out = []
    for at, rows, kind in kinds:
        matrix = np.zeros((len(rows), max([1, *map(len, rows)])), kind)
        for r, w in enumerate(rows):
            matrix[r, :len(w)] = w
        out.append((np.array(at, np.int64), matrix))
    return out


def integers(matrix: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of any size, exactly."""
    out = np.empty(matrix.shape, object)
    for at, x in np.ndenumerate(matrix):
        out[at] = int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale))
    return out


class Postings:
    """A block's posting lists: a term held by more than half of the rows is one dense weight vector,
    another a list of rows and weights."""

    def __init__(self, matrix: np.ndarray):
        self.rows = len(matrix)
        self.terms = []
        for column in matrix.T:
            at = np.flatnonzero(column)
            self.terms.append((None, np.ascontiguousarray(column)) if 2 * len(at) > self.rows else (at, column[at]))

    def of(self, kind) -> Postings:
        """The same with weights of another type; of the block's query blocks most need the same one."""
        if self.terms and self.terms[0][1].dtype != kind:
            self.terms = [(at, w.astype(kind)) for at, w in self.terms]
        return self

    def scores(self, query: np.ndarray, out: np.ndarray, work: np.ndarray) -> np.ndarray:
        out[:] = 0  # an array of Python integers where 64 bits may not do
        for t in np.flatnonzero(query[:len(self.terms)]).tolist():
            at, weight = self.terms[t]
            if at is None:
                np.multiply(weight, query[t], out=work)
                out += work
            elif len(at):
                out[at] += weight * query[t]
        return out


def best(scores: np.ndarray, ids: np.ndarray, k: int, own: int = -1) -> np.ndarray:
    """Rows of the k highest scores, ties to the smaller id, without row ``own``."""
    n = len(scores)
    take = min(n, k + (own >= 0))
    if take < n:
        least = np.partition(scores, n - take)[n - take]  # numbers of 64 bits at most
        rows = np.flatnonzero(scores >= least)
    else:
        rows = np.arange(n)
    rows = rows[rows != own]
    return rows[np.lexsort((ids[rows], -scores[rows]))][:k]


def _pack(batches, scale: int):
    """(ids, query flags, matrix) of up to BLOCK rows each; weights as 16-bit numbers where they fit."""
    held: list = []
    count = 0

    def blocks():
        rows = pa.Table.from_batches(held).combine_chunks()
        for ok, matrix in quantise(rows.column(1).to_pylist(), scale):
            if len(ok):
                ids = rows.column(0).combine_chunks().take(pa.array(ok))
                gone = np.asarray(ids.is_null()) if ids.null_count else np.zeros(len(ids), bool)
                query = rows.column(2).take(pa.array(ok)).to_numpy().astype(np.uint8)
                small = matrix.dtype == np.int64 and np.abs(matrix).max(initial=0) < 2**15
                yield ids.fill_null(NO_ID).to_numpy().astype(np.int64), query + 2 * gone.astype(np.uint8), matrix.astype(np.int16) if small else matrix

    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            held.append(batch.slice(at, BLOCK))
            count += len(held[-1])
            if count >= BLOCK:
                yield from blocks()
                held, count = [], 0
    if count:
        yield from blocks()


#: Stands for the null id of a row inside a block (the rows' flags tell it from a real one).
NO_ID = 2**63 - 1


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), id, score for every row where ``is_query`` holds, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"),
                          (F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()).alias("q"))

    def pack(batches):
        for ids, query, matrix in _pack(batches, scale):
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([ids.tobytes()], pa.binary()), "query": pa.array([query.tobytes()], pa.binary()),
                "width": pa.array([matrix.shape[1]], pa.int32()), "size": pa.array([matrix.itemsize if matrix.dtype != np.float64 else WIDE], pa.int32()),
                "matrix": pa.array([matrix.tobytes()], pa.binary())})

    blocks = stage(rows.mapInArrow(pack, "ids binary, query binary, width int, size int, matrix binary")
                   .withColumn("block", F.monotonically_increasing_id()), "blocks")
    shards = max(1, min(partitions(spark), blocks.count()))

    def queries(batches):  # of a block only its query rows go to the shards
        for batch in batches:
            for ids, query, width, size, matrix, block in zip(*[c.to_pylist() for c in batch.columns]):
                own = np.flatnonzero(np.frombuffer(query, np.uint8) & 1)
                if len(own):
                    yield pa.RecordBatch.from_pydict({
                        "q_ids": pa.array([np.frombuffer(ids, np.int64)[own].tobytes()], pa.binary()),
                        "q_rows": pa.array([own.astype(np.int64).tobytes()], pa.binary()), "q_width": pa.array([width], pa.int32()),
                        "q_size": pa.array([size], pa.int32()), "q_matrix": pa.array([_matrix(matrix, width, size)[own].tobytes()], pa.binary()),
                        "q_block": pa.array([block], pa.int64())})

    asked = blocks.select("ids", "query", "width", "size", "matrix", "block").mapInArrow(
        queries, "q_ids binary, q_rows binary, q_width int, q_size int, q_matrix binary, q_block bigint") \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    number = Window.orderBy("block")  # one row per block of BLOCK vectors
    numbered = blocks.join(blocks.select("block").withColumn("shard", (F.row_number().over(number) % shards).cast("int")), "block")
    # sorted by shard below the join only: each block streams past the (smaller, spillable) query blocks of its shard once
    pairs = numbered.select("shard", "ids", "query", "width", "size", "matrix", "block").join(asked.hint("merge"), "shard")

    def score(batches):
        held = (None, None)
        for batch in batches:
            for ids, flags, width, size, matrix, block, q_ids, q_rows, q_width, q_size, q_matrix, q_block in zip(*[c.to_pylist() for c in batch.columns]):
                if held[0] != block:
                    w = _whole(matrix, width, size, scale)
                    held = (block, Postings(w), np.abs(w).max(initial=0))
                ids, gone = np.frombuffer(ids, np.int64), np.frombuffer(flags, np.uint8) >= 2
                asking = _whole(q_matrix, q_width, q_size, scale)
                # 32 or 64-bit sums where they provably suffice
                sides = int(held[2]), int(np.abs(asking).max(initial=0))
                most = max(*sides, sides[0] * sides[1] * max(1, width))
                kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
                post = held[1].of(kind)
                out, work = (np.empty(post.rows, kind) for _ in range(2))
                q, got, value, none = [], [], [], []
                for q_id, own, row in zip(np.frombuffer(q_ids, np.int64).tolist(), np.frombuffer(q_rows, np.int64).tolist(), asking.astype(kind)):
                    s = post.scores(row, out, work)
                    if kind is object:
                        s = np.array([max(-2**63, min(2**63 - 1, int(x))) for x in s], np.int64)
                    at = best(s, ids, k, own if q_block == block else -1)
                    q.append(np.full(len(at), q_id))
                    got.append(ids[at])
                    none.append(gone[at])
                    value.append(s[at].astype(np.int64))
                own_row = np.repeat(np.frombuffer(q_rows, np.int64), [len(x) for x in q])
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.concatenate(q), pa.int64()), "q_block": pa.array(np.full(len(own_row), q_block), pa.int64()),
                    "q_row": pa.array(own_row, pa.int64()), "id": pa.array(np.concatenate(got), pa.int64(), mask=np.concatenate(none)),
                    "score": pa.array(np.concatenate(value), pa.int64())})

    found = pairs.select("ids", "query", "width", "size", "matrix", "block", "q_ids", "q_rows", "q_width", "q_size", "q_matrix", "q_block") \
        .mapInArrow(score, "query_id bigint, q_block bigint, q_row bigint, id bigint, score bigint")
    w = Window.partitionBy("query_id", "q_block", "q_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


#: The size that marks a matrix of unquantised components.
WIDE = -8


def _matrix(data: bytes, width: int, size: int) -> np.ndarray:
    kind = {2: np.int16, 8: np.int64, WIDE: np.float64}[size]
    return np.frombuffer(data, kind).reshape(-1, width)


def _whole(data: bytes, width: int, size: int, scale: int) -> np.ndarray:
    """The integer matrix of a block."""
    matrix = _matrix(data, width, size)
    return integers(matrix, scale) if size == WIDE else matrix.astype(np.int64)
