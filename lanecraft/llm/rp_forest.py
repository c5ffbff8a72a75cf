"""Near-duplicate embeddings by a random-projection tree forest.

1. Vectors equal bit for bit collapse into their smallest id with a multiplicity.
2. Trees are fitted on a bounded sample (``SAMPLE`` vectors): a node splits at the median of a random
   projection; vectors within the middle ``SPILL`` share of projections go to both sides.  Splitting ends
   when a node's share of all vectors is at most ``LEAF``.  Nodes the sample can't resolve further are
   split by random signs.  The number of trees follows from the levels of both kinds, so that a pair at the threshold
   shares a leaf of some tree with probability ``RECALL`` by the model below.
3. Every vector is routed through every tree.  Leaves are compared block with block (``BLOCK`` vectors); a
   leaf of any size is spread over many tasks.  Cosines are exact doubles.
4. A pair that meets in several leaves counts in the first of them only, so link counts need no list of
   pairs; each block emits its vectors' counts and one edge a vector to the smallest vector of its local
   component.  Components are joined from those edges.

Vectors that are null, zero, or hold null or non-finite components link with nothing.  Vectors of
different lengths are compared as padded with zeros.  Repeated rows link with each other.  Every link
reported is one with cosine >= the threshold; a pair that shares no leaf is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lanecraft.llm.common import block_pairs, sized, stage
from lanecraft.llm.components import components

SAMPLE = 8192
LEAF = 384
BLOCK = 512
SPILL = 0.10
RECALL = 0.99
THRESHOLD = 0.9
MIN_NODE = 32
SEED = 2


def parse(vectors: list, kind=np.float64) -> tuple[list[int], list[bytes]]:
    """(rows that can link, their components as little-endian bytes without trailing zeros)."""
    ok, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, kind)
        if np.isfinite(x).all() and x.any():
            ok.append(i)
            rows.append(x[:np.flatnonzero(x)[-1] + 1].tobytes())
    return ok, rows


def units(data: list[bytes], kind=np.float64) -> np.ndarray:
    """Unit vectors as doubles, padded with zeros to one width; the same bytes give the same vector
    whatever else is in the list."""
    width = max(map(len, data), default=0)
    x = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), kind).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def separated(threshold: float, spill: float) -> float:
    """Probability that one split parts a pair at the threshold (bivariate normal projections)."""
    z = np.random.Generator(np.random.PCG64(0)).standard_normal((2, 200_000))
    y = threshold * z[0] + math.sqrt(1 - threshold**2) * z[1]
    half = np.quantile(np.abs(z[0]), spill)
    return float((((z[0] > half) & (y < -half)) | ((z[0] < -half) & (y > half))).mean())


class Forest:
    """Trees over unit vectors.  node -> (direction, low, high, left, right) or (leaf number, blind bits)."""

    def __init__(self, sample: np.ndarray, total: int, threshold: float = THRESHOLD, leaf: int = LEAF, spill: float = SPILL,
                 recall: float = RECALL, seed: int = SEED):
        self.width = sample.shape[1]
        self.spill = spill
        depth = max(0, math.ceil(math.log2(max(1.0, total / leaf)) / (1 - math.log2(1 + spill))))
        share, half = total / max(1, len(sample)), (1 + spill) / 2
        fitted = max(0, math.floor(math.log(max(1.0, len(sample) / MIN_NODE)) / -math.log(half)) + 1) if len(sample) >= MIN_NODE else 0
        blind = 0  # levels of random signs below the fitted ones, without spill
        if fitted < depth and min(MIN_NODE - 1, len(sample)) * share > leaf:
            depth, blind = fitted, min(24, math.ceil(math.log2(min(MIN_NODE - 1, len(sample)) * share / leaf)))
        stay = (1 - separated(threshold, spill)) ** depth * (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** blind
        self.count = 1 if stay >= 1 else max(2, math.ceil(math.log(1 - recall) / math.log(1 - stay)))
        rng = np.random.Generator(np.random.PCG64(seed))
        self.blind = rng.standard_normal((self.count, 24, self.width))
        self.trees = [self._grow(sample, total, leaf, rng) for _ in range(self.count)]

    def _grow(self, sample: np.ndarray, total: int, leaf: int, rng) -> list:
        nodes: list = []
        share = total / max(1, len(sample))

        def split(rows: np.ndarray) -> int:
            at = len(nodes)
            nodes.append(None)
            people = len(rows) * share
            if people <= leaf or len(rows) < MIN_NODE:
                bits = max(0, min(24, math.ceil(math.log2(max(1.0, people / leaf))))) if len(rows) else 0
                nodes[at] = (at, bits)
                return at
            direction = rng.standard_normal(self.width)
            p = sample[rows] @ direction
            low, high = np.quantile(p, [0.5 - self.spill / 2, 0.5 + self.spill / 2])
            left, right = rows[p <= high], rows[p > low]
            if max(len(left), len(right)) >= 0.95 * len(rows):  # copies of each other: no use splitting
                nodes[at] = (at, 0)
                return at
            nodes[at] = (direction, low, high, split(left), split(right))
            return at

        split(np.arange(len(sample)))
        return nodes

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf code) for all trees, sorted by row and code."""
        if x.shape[1] != self.width:  # the model sees as many components as the sample had
            fit = np.zeros((len(x), self.width))
            fit[:, :min(self.width, x.shape[1])] = x[:, :self.width]
            x = fit
        rows, codes = [], []
        for t, nodes in enumerate(self.trees):
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, idx = todo.pop()
                node = nodes[at]
                if not len(idx):
                    continue
                if len(node) == 2:
                    number, bits = node
                    code = np.full(len(idx), (t << 44) | (number << 24), np.int64)
                    for b in range(bits):
                        code |= (x[idx] @ self.blind[t, b] > 0).astype(np.int64) << b
                    rows.append(idx)
                    codes.append(code)
                else:
                    direction, low, high, left, right = node
                    p = x[idx] @ direction
                    todo += [(left, idx[p <= high]), (right, idx[p > low])]
        rows, codes = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((codes, rows))
        return rows[order], codes[order]


def local_components(link: np.ndarray) -> np.ndarray:
    """Smallest row index reachable by links inside a block (symmetric boolean matrix)."""
    n = len(link)
    label = np.arange(n)
    if not link.any():
        return label
    a, b = np.nonzero(link)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare(code: int, ids, weights, codes, x, ids2, weights2, codes2, y, same: bool, threshold: float):
    """Link counts of both sides and edges, for one pair of blocks of leaf ``code``."""
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
    near = x @ y.T >= threshold
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return None
    # pairs that share an earlier leaf are counted there
    pool = {c: k for k, c in enumerate(sorted({c for row in codes for c in row if c < code} & {c for row in codes2 for c in row if c < code}))}
    fresh = near
    if pool:
        def held(rows):
            m = np.zeros((len(rows), len(pool)), np.float32)
            for i, row in enumerate(rows):
                m[i, [pool[c] for c in row if c in pool]] = 1
            return m

        fresh = near & ~(held(codes) @ held(codes2).T > 0)
    left, right = fresh @ weights2, (np.zeros(len(ids2), np.int64) if same else weights @ fresh)
    n, m = len(ids), 0 if same else len(ids2)
    whole = np.zeros((n + m, n + m), bool)
    if same:
        whole[:] = near
    else:
        whole[:n, n:], whole[n:, :n] = near, near.T
    label = local_components(whole)
    names = np.concatenate([ids, ids2[:m]])
    low = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(low, label, names)
    root = low[label]
    at = np.flatnonzero(root != names)
    return left, right, names[at], root[at]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.  Ids are integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    number = np.float32 if single else np.float64

    def encode(batches):
        for batch in batches:
            ok, data = parse(batch.column(1).to_pylist(), number)
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int64())), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(data, pa.binary())],
                                             names=["id", "d1", "d2", "x"])

    encoded = stage(rows.where("id is not null").mapInArrow(encode, "id bigint, d1 bigint, d2 bigint, x binary"), "vectors")
    classes = stage(encoded.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x")), "classes")
    total = classes.count()
    # a bounded sample by hash: the `sample` vectors of least digest
    picked = [r["x"] for r in classes.select("d1", "d2", "x").orderBy("d1", "d2").limit(sample).collect()]
    if not picked:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    forest = Forest(units(picked, number), total, threshold, seed=seed)

    def route(batches):
        for batch in batches:
            data = batch.column(2).to_pylist()
            row, code = forest.leaves(units(data, number))
            cut = np.searchsorted(row, np.arange(len(data) + 1))
            codes = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(code))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(0).take(at), batch.column(1).take(at), codes.take(at), batch.column(2).take(at)],
                                             names=["leaf", "id", "weight", "codes", "x"])

    def leaf_codes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.leaves(units(batch.column(0).to_pylist(), number))[1])], names=["leaf"])

    sizes = classes.select("x").mapInArrow(leaf_codes, "leaf bigint").groupBy("leaf").agg(F.count(F.lit(1)).alias("m"))
    people = stage(sizes.where("m > 1"), "leaves")
    dealt = classes.select("id", "weight", "x").mapInArrow(route, "leaf bigint, id bigint, weight bigint, codes array<bigint>, x binary")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    packed = dealt.join(sized(people, 32), "leaf").select("leaf", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("blk"), F.struct("id", "weight", "codes", "x").alias("row")) \
        .groupBy("leaf", "blocks", "blk").agg(F.collect_list("row").alias("rows"))
    packed = stage(packed, "blocks")

    def compare(batches):
        for batch in batches:
            two = batch.num_columns == 3
            for k in range(len(batch)):
                leaf = batch.column(0)[k].as_py()
                left = _unpack(batch.column(1)[k].values, number)
                right = _unpack(batch.column(2)[k].values, number) if two else left
                found = _compare(leaf, *left, *right, not two, threshold)
                if found is None:
                    continue
                n_left, n_right, ends, roots = found
                ids = np.concatenate([left[0], right[0]])
                links = np.concatenate([n_left, n_right])
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(np.concatenate([ids[at], ends]), pa.int64()),
                    "b": pa.array(np.concatenate([ids[at], roots]), pa.int64()),
                    "n": pa.array(np.concatenate([links[at], np.zeros(len(ends), np.int64)]), pa.int64())})

    # every block with itself, and pairs of blocks of the leaves that have several
    schema = "a bigint, b bigint, n bigint"
    inside = packed.select("leaf", "rows").mapInArrow(compare, schema)
    several = packed.where("blocks > 1")
    across = block_pairs(several, ["leaf"], "blk", "blocks", "rows").where("i < j").select("leaf", "x", "y").mapInArrow(compare, schema)
    found = stage(inside.unionByName(across), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    roots = components(found.select("a", "b")).withColumnRenamed("node", "id")
    named = classes.select("d1", "d2", "id", "weight").join(counts, "id", "left").join(roots, "id", "left") \
        .select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    good = encoded.select("id", "d1", "d2").join(named, ["d1", "d2"]).groupBy("id").agg(F.max("n").alias("n"), F.min("root").alias("root"))
    return rows.select("id").join(good, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _unpack(rows: pa.StructArray, number):
    ids, weights, codes, data = (rows.field(k) for k in range(4))
    return ids.to_numpy(), weights.to_numpy(), codes.to_pylist(), units(data.to_pylist(), number)
