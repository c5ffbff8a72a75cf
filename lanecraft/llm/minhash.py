"""Near-duplicate documents by b-bit MinHash over word shingles.

1. Every text gives ``BANDS * ROWS`` minima over its shingle set, a 128-bit fingerprint of the set, a key
   per band of full minima and a packed signature of the minima's low ``BITS`` bits.
2. Documents with equal sets collapse into their smallest id, so exact copies cost one row.
3. Documents that share a band key are candidates.  Each is first compared with the bucket's smallest id:
   the packed signatures estimate the similarity by counting equal groups of bits, corrected for chance
   agreement; pairs clearly below the threshold go, the rest is confirmed on the full sets.
4. Links are joined into components.  Buckets whose other members still lie in several components are
   compared member with member, in blocks, skipping pairs of one component, pairs that an earlier common
   band compares, and pairs the signatures rule out.  Only links come out, not the pairs looked at.

A link of similarity t is missed with probability (1 - t^ROWS)^BANDS (4e-7 at 0.85) or if its estimate is
off by ``MARGIN`` (about 1e-5); every reported link is exact.

An id that repeats with different texts has the links of each of them.  Null text, and text without words, has an empty set and is linked with nothing.  Rows with a null id are
their own component (null).  Repeated rows link with each other.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanecraft.llm.common import block_pairs, grouped, sized, stage
from lanecraft.llm.components import components
from lanecraft.llm.shingles import mix64, shingle_sets

BANDS, ROWS, BITS = 20, 4, 4
WORDS = 5
PERCENT = 80
MARGIN = 0.2
#: Members and bytes of sets of a block of one bucket.
BLOCK_ROWS, BLOCK_BYTES = 128, 1 << 21
_SLICE = 1 << 16
#: Columns of an incidence matrix at once.
_COLUMNS = 1 << 14

_rng = np.random.Generator(np.random.PCG64(10))
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def minima(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x permutations; texts must not be empty."""
    out = np.empty((len(offsets) - 1, len(_MUL)), np.uint64)
    i = 0
    while i < len(offsets) - 1:  # slices that stay in the cache
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1)
        part, at = h[offsets[i]:offsets[j]], offsets[i:j] - offsets[i]
        for p in range(len(_MUL)):
            out[i:j, p] = np.minimum.reduceat((part ^ _XOR[p]) * _MUL[p], at)
        i = j
    return out


def pack_bits(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of (mixed) minima, packed into bytes: texts x (permutations * BITS / 8)."""
    low = (mix64(m) & np.uint64(2**BITS - 1)).astype(np.uint8)
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(m), -1), axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis: bytes), corrected for chance agreement."""
    x = np.bitwise_xor(a, b)
    x = x | (x >> 1)
    x = x | (x >> 2)  # BITS = 4: the low bit of each half byte tells whether the group differs
    differ = np.bitwise_count(x & 0x11).sum(-1)
    chance = 2.0**-BITS
    return ((1 - differ / (BANDS * ROWS)) - chance) / (1 - chance)


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def similar(inter: int, n: int, m: int, percent: int) -> bool:
    return 100 * inter >= percent * (n + m - inter)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """One row per document: id, n, fp1, fp2, bands, sig (bands and sig null for empty sets)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in grouped(batches, "text"):
            with np.errstate(over="ignore"):
                h, offsets = shingle_sets(batch.column(1), k)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                at = offsets[:-1][full]
                fp = np.zeros((2, len(n)), np.uint64)
                bands = [None] * len(n)
                sig = [None] * len(n)
                if len(full):
                    fp[0][full] = np.add.reduceat(mix64(h), at)
                    fp[1][full] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                    m = minima(h, np.append(at, len(h)))
                    keys = np.zeros((len(full), BANDS), np.uint64)
                    for r in range(ROWS):
                        keys = mix64(keys * np.uint64(31) + m[:, r::ROWS] + np.uint64(r))
                    packed = pack_bits(m)
                    for j, i in enumerate(full):
                        bands[i], sig[i] = keys[j].view(np.int64), packed[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "n", "fp1", "fp2", "bands", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n bigint, fp1 bigint, fp2 bigint, bands array<bigint>, sig binary")


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(id, set) of the wanted ids; the set as sorted 64-bit hashes in a binary value."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(sized(wanted, 64), "id", "left_semi")

    def run(batches):
        for batch in grouped(batches, "text"):
            h, offsets = shingle_sets(batch.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["id", "set"])

    return rows.mapInArrow(run, f"id {kind}, set binary")


def _stars(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) among the pairs (a, b), by estimate and then on the full sets."""
    def near(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), -1) for i in (2, 3))
            keep = pa.array(estimate(a, b) >= percent / 100 - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    def confirm(batches):
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            keep = []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                keep.append(similar(common(s, t), len(s), len(t), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    one = lambda t, v, end: t.select(F.col("id").alias(end), F.col(v).alias(f"{v}_{end}"))
    schema = f"a {kind}, b {kind}"
    maybe = pairs.join(one(reps, "sig", "a"), "a").join(one(reps, "sig", "b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(near, schema)
    return maybe.join(one(sets, "set", "a"), "a").join(one(sets, "set", "b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(confirm, schema)


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, as products of incidence matrices."""
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    items = [np.concatenate(x) for x in (a, b)]
    both = np.intersect1d(*[np.unique(x) for x in items], assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), _COLUMNS):
        part = both[lo:lo + _COLUMNS]
        sides = []
        for n, row, item in zip((len(a), len(b)), rows, items):
            at = np.minimum(np.searchsorted(part, item), len(part) - 1)
            hit = part[at] == item
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _unpack(rows: pa.StructArray):
    """ids, roots, bands, signatures, sets of a block."""
    ids, roots, bands, sig, sets = (rows.field(i) for i in range(5))
    return (ids.to_numpy(zero_copy_only=False), roots.to_numpy(zero_copy_only=False), bands.flatten().to_numpy().reshape(-1, BANDS),
            np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(rows), -1), [np.frombuffer(s, np.uint64) for s in sets.to_pylist()])


def _cross_links(band: int, pivot, x, y, same: bool, percent: int):
    """Spanning links between members of different components; pairs with the pivot, and pairs that an
    earlier common band compares, are left out."""
    ids, roots, bands, sig, sets = x
    ids2, roots2, bands2, sig2, sets2 = y
    open_ = roots[:, None] != roots2[None, :]
    open_ &= (ids != pivot)[:, None] & (ids2 != pivot)[None, :]
    if same:
        open_ &= np.triu(np.ones(open_.shape, bool), 1)
    for k in range(band):
        open_ &= bands[:, None, k] != bands2[None, :, k]
    if open_.any():
        open_ &= estimate(sig[:, None, :], sig2[None, :, :]) >= percent / 100 - MARGIN
    p, q = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(p):
        return
    inter = intersections([sets[i] for i in p], [sets2[j] for j in q])
    size, size2 = (np.array([len(s[i]) for i in at]) for s, at in ((sets, p), (sets2, q)))
    link = open_[np.ix_(p, q)] & (100 * inter >= percent * (size[:, None] + size2[None, :] - inter))
    merged: dict = {}

    def find(r):
        while r in merged:
            r = merged[r]
        return r

    for i, j in np.argwhere(link):
        r, s = find(roots[p[i]]), find(roots2[q[j]])
        if r != s:
            merged[max(r, s)] = min(r, s)
            yield ids[p[i]], ids2[q[j]]


def _blocks(members: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links between members (band, key, pivot, id, root, bands, sig, set, blk, blocks) of one bucket that lie in
    different components, block with block."""
    packed = members.groupBy("band", "key", "pivot", "blocks", "blk").agg(
        F.collect_list(F.struct("id", "root", "bands", "sig", "set")).alias("rows"))
    both = block_pairs(packed, ["band", "key", "pivot"], "blk", "blocks", "rows").select("band", "pivot", "i", "j", "x", "y")

    def run(batches):
        for batch in batches:
            found = []
            for n in range(len(batch)):
                band, pivot, i, j = (batch.column(c)[n].as_py() for c in range(4))
                x = _unpack(batch.column(4)[n].values)
                found += _cross_links(band, pivot, x, x if i == j else _unpack(batch.column(5)[n].values), i == j, percent)
            kind_ = batch.schema.field("pivot").type
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], kind_), "b": pa.array([b for _, b in found], kind_)})

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links of
    similarity >= percent / 100), kept (id = component_id)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stage(signatures(docs, id_col, text_col, k), "signatures")
    reps = stage(rows.where("n > 0 and id is not null").groupBy("fp1", "fp2", "n").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    keyed = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    shared = stage(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("pivot"), F.sum("n").alias("total"))
                   .where("m > 1"), "buckets")
    members = stage(keyed.select("id", "band", "key").join(sized(shared, 64), ["band", "key"]), "members")
    wanted = stage(members.select("id").distinct(), "wanted")
    sets = stage(_sets(docs, id_col, text_col, k, wanted).dropDuplicates(["id", "set"]), "sets")
    pairs = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    first = stage(_stars(pairs, reps, sets, percent, kind), "links")
    roots = stage(components(first), "roots")
    named = members.where("m > 2 and id <> pivot").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = stage(named.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "key"), "split")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    open_ = named.join(sized(split, 48), ["band", "key"]).join(reps.select("id", "bands", "sig"), "id").join(sets, "id") \
        .withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    more = _blocks(open_.select("band", "key", "pivot", "id", "root", "bands", "sig", "set", "blk", "blocks"), percent, kind)
    final = components(stage(first.unionByName(more), "links"))
    classes = reps.select("fp1", "fp2", "n", "id").join(final.withColumnRenamed("node", "id"), "id", "left") \
        .select("fp1", "fp2", "n", F.coalesce("root", "id").alias("root"))
    return rows.select("id", "n", "fp1", "fp2").join(classes, ["fp1", "fp2", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
