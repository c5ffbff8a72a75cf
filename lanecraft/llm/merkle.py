"""Merkle manifest of a table: every row is a leaf, every leaf comes with its proof.

Leaves are ordered and numbered within their language, hashed in runs of eight up to one subroot a language, and
the subroots in the same way up to the root.  Every level that is built is written; its rows name their parent and
their place in it.  Proofs come from a recursive query that climbs these rows from the leaves: each step appends the
siblings and folds the leaf's (possibly tampered) digest into the parent's.  The leaves of one run climb together,
since they share all siblings from there on; each folds a digest of its own.

Nodes of the lower levels meet the climbing rows by a shuffle: no node has many runs below it there.  The upper levels
(the crown: at most ``CROWN_ROWS`` nodes, counted before) are broadcast, so that a root with all runs below it is
no hot key.

Defined results: a null column is hashed as ``-``, an empty text as ``0:``.  Null languages come first, null ids first
in their language; equal rows are leaves of their own, in any order (their digests are equal).  A null id is never
tampered with.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanecraft.llm.common import partitions, prepare, sized, stage

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that are broadcast at most (some 350 bytes each).
CROWN_ROWS = 100_000
RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value with its length in bytes before it, so that no two rows run into one."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def run_digest(digests: Column) -> Column:
    """Digest of a run of nodes, an array of digests."""
    return F.unhex(F.sha2(F.concat_ws("", F.transform(digests, hex_text)), 256))


def tampered_text(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def third(id_col: str = "doc_id") -> Column:
    """Rows whose id's checksum three divides."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``nth``, the place of a row in its group from 0, and ``of``, the rows of the group.

    Rows are range-partitioned (a random number splits long runs of equal keys) and written once with their partition;
    places inside a partition and the sizes of partitions both read that table.  ``group`` must hold no nulls."""
    n = partitions(df.sparkSession)
    ranged = df.withColumn("__r", F.rand(7)).repartitionByRange(n, *group, *order, "__r").withColumn("__p", F.spark_partition_id())
    part = stage(ranged.drop("__r"), name)
    sizes = part.groupBy("__p", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__p", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                         F.sum("__n").over(Window.partitionBy(*group)).alias("of"))
    inside = F.row_number().over(Window.partitionBy("__p", *group).orderBy(*order)) - 1
    return part.withColumn("__at", inside).join(sizes, ["__p", *group]).withColumn("nth", F.col("__before") + F.col("__at")).drop("__p", "__at", "__before")


def node_id(tree, level, idx) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


class Manifest:
    """The written levels of a tree: ``runs`` (the leaves, eight a row), ``nodes`` (id, parent, slot, kids, digest),
    ``subroots`` (tree, lang, subroot) and ``root`` (bytes; None for an empty table)."""

    def __init__(self, docs: DataFrame, tampered: Column | None = None, fields=FIELDS, crown_rows: int = CROWN_ROWS):
        spark = self.spark = docs.sparkSession
        prepare(spark)
        self.crown_rows = crown_rows
        values = [F.col(c) for c in fields]
        changed = [tampered_text(v) if c == "text" else v for c, v in zip(fields, values)]
        other = F.when(tampered, leaf_digest(changed)) if tampered is not None else F.lit(None).cast("binary")
        hashed = stage(docs.select(F.col("lang"), F.col("doc_id"), leaf_digest(values).alias("leaf"), other.alias("tampered")), "leaves")
        langs = stage(hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("leaves")), "langs")
        self.langs = stage(numbered(langs.withColumn("all", F.lit(0)), ["all"], ["lang"], "langs-ranged").select("lang", "leaves", F.col("nth").alias("tree")), "trees")
        self.trees, most = self.langs.agg(F.count(F.lit(1)), F.max("leaves")).first()
        self.root, self.id_type = None, docs.schema["doc_id"].dataType
        if not self.trees:
            return
        side = sized(self.langs.select(F.col("lang").alias("__lang"), "tree"), 32, "__lang")
        placed = hashed.join(side, F.col("lang").eqNullSafe(F.col("__lang"))).select("tree", "doc_id", "leaf", "tampered")
        placed = numbered(placed, ["tree"], ["doc_id", "leaf"], "leaves-ranged")
        runs = placed.groupBy("tree", F.floor(F.col("nth") / FAN).alias("idx"), "of").agg(
            F.sort_array(F.collect_list(F.struct("nth", "doc_id", "leaf", "tampered"))).alias("members"))
        own = F.when(F.col("of") > 1, run_digest(F.col("members.leaf"))).otherwise(F.col("members.leaf")[0])
        self.runs = stage(runs.select("tree", "idx", F.when(F.col("of") > 1, 1).otherwise(0).alias("level"),
                                      F.floor((F.col("of") + FAN - 1) / FAN).alias("n"), own.alias("digest"), "members"), "runs")
        levels, ends = self._levels(self.runs.select("tree", "level", "idx", "n", "digest"), -(-most // FAN), 1)
        self.subroots = stage(ends.join(self.langs, "tree").select("tree", "lang", F.col("digest").alias("subroot")), "subroots")
        top, ends = self._levels(self.subroots.select(F.lit(-1).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"),
                                                      F.lit(self.trees).cast("long").alias("n"), F.col("subroot").alias("digest")), self.trees, 0)
        self.root = bytes(ends.select("digest").first()[0])
        self.levels, self.top = levels, top

    def _levels(self, nodes: DataFrame, n: int, level: int) -> tuple[list[DataFrame], DataFrame]:
        """The levels above ``nodes`` (n: the most nodes of a tree), written one by one, and the last node of each tree."""
        levels, ends, now = [], nodes.where("n = 1"), nodes
        while n > 1:
            kids = now.where("n > 1").groupBy("tree", F.floor(F.col("idx") / FAN).alias("idx"), "n").agg(
                F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
            n, level = -(-n // FAN), level + 1
            now = stage(kids.select("tree", F.lit(level).alias("level"), "idx", F.floor((F.col("n") + FAN - 1) / FAN).alias("n"),
                                    run_digest(F.col("kids.digest")).alias("digest"), F.col("kids.digest").alias("kids")), "level")
            levels.append(now)
            ends = ends.unionByName(now.where("n = 1").select("tree", "level", "idx", "n", "digest"))
        return levels, ends

    def _linked(self, nodes: DataFrame) -> DataFrame:
        """Rows with the id of their parent (null: the root) and their slot in it; subroots hang in the upper tree."""
        tree, level, idx = F.col("tree"), F.col("level"), F.col("idx")
        inner = F.col("n") > 1
        under = F.lit(self.trees > 1) & (tree >= 0) & ~inner
        return nodes.withColumn("id", node_id(tree, level, idx)) \
            .withColumn("parent", F.when(inner, node_id(tree, level + 1, F.floor(idx / FAN)))
                        .when(under, node_id(F.lit(-1), F.lit(1), F.floor(tree / FAN)))) \
            .withColumn("slot", F.when(inner, idx % FAN).when(under, tree % FAN).cast("int"))

    def nodes(self) -> DataFrame:
        """All inner nodes above the first runs: id, parent, slot, kids, digest."""
        out = None
        for x in [*self.levels, *self.top]:
            x = self._linked(x).select("id", "parent", "slot", "kids", "digest")
            out = x if out is None else out.unionByName(x)
        return out

    def proofs(self) -> DataFrame:
        """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
        spark = self.spark
        if self.root is None:
            return spark.createDataFrame([], f"doc_id {self.id_type.simpleString()}, {RESULT}")
        kids = F.col("members.leaf")
        own = F.transform("members", lambda m: F.coalesce(m["tampered"], m["leaf"]))
        folded = F.when(F.col("level") == 0, own).otherwise(F.transform(own, lambda x, i: run_digest(
            F.transform(kids, lambda k, j: F.when(i == j, x).otherwise(k)))))
        state = self._linked(self.runs).select("tree", "idx", "parent", "slot", folded.alias("folded"), F.unhex(F.lit("")).alias("siblings"))
        inner = self.nodes()
        if inner is not None:
            lower = self._lower()
            inner = stage(inner, "nodes")
            if lower:
                below = (F.col("id.tree") >= 0) & (F.col("id.level") < lower)
                state = self._climb(state, inner.where(below), f"parent IS NULL OR parent.tree < 0 OR parent.level >= {lower}")
                inner = inner.where(~below)
            state = self._climb(state, sized(inner, 400), "parent IS NULL")
        leaves = state.join(self.runs.select("tree", "idx", "members"), ["tree", "idx"]).join(sized(self.subroots.select("tree", "subroot"), 48), "tree")
        one = leaves.select("subroot", "siblings", "members", "folded", F.posexplode("members").alias("at", "leaf"))
        beside = F.concat_ws("", F.transform(F.filter(F.col("members"), lambda m, i: i != F.col("at")), lambda m: hex_text(m["leaf"])))
        last = F.col("folded")[F.col("at")]
        root = F.lit(self.root)
        return one.select(F.col("leaf.doc_id").alias("doc_id"), hex_text(F.col("leaf.leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
                          hex_text(root).alias("root"), F.sha2(F.concat(beside, hex_text(F.col("siblings"))), 256).alias("proof_sha256"),
                          hex_text(last).alias("folded_root"), (last == root).alias("verified"))

    def _lower(self) -> int:
        """The first level of the crown, or 0 if the crown holds all nodes."""
        top = len(self.levels) + 1
        counts = self.langs.agg(*[F.sum(F.when(F.col("leaves") > FAN ** (k - 1), F.ceil(F.col("leaves") / FAN ** k)).otherwise(0)) for k in range(2, top + 1)] or [F.lit(0)]).first()
        held, first = -(-self.trees // (FAN - 1)), top + 1
        while first > 2 and held + (counts[first - 3] or 0) <= self.crown_rows:
            first -= 1
            held += counts[first - 2] or 0
        return 0 if first <= 2 else first

    def _climb(self, state: DataFrame, nodes: DataFrame, until: str) -> DataFrame:
        """Rows climb from node to parent until ``until`` holds; the query is run and written here, under limits of its own."""
        spark, name = self.spark, uuid.uuid4().hex[:12]
        state.createOrReplaceTempView(f"start_{name}")
        nodes.createOrReplaceTempView(f"nodes_{name}")
        query = f"""
            WITH RECURSIVE climb(tree, idx, parent, slot, folded, siblings) AS (
              SELECT tree, idx, parent, slot, folded, siblings FROM start_{name}
              UNION ALL
              SELECT c.tree, c.idx, n.parent, n.slot,
                     transform(c.folded, f -> unhex(sha2(concat_ws('', transform(n.kids, (k, i) -> lower(hex(if(i = c.slot, f, k))))), 256))),
                     aggregate(filter(n.kids, (k, i) -> i <> c.slot), c.siblings, (a, k) -> concat(a, k))
              FROM climb c JOIN nodes_{name} n ON c.parent = n.id)
            SELECT * FROM climb WHERE {until}"""
        limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "100"}
        before = {k: spark.conf.get(k, None) for k in limits}
        try:
            for k, v in limits.items():
                spark.conf.set(k, v)
            return stage(spark.sql(query), "climb")
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
            spark.catalog.dropTempView(f"start_{name}")
            spark.catalog.dropTempView(f"nodes_{name}")


def manifest(docs: DataFrame, tampered: Column | None = None, **options) -> DataFrame:
    """Leaf, roots, proof and the root that the (where ``tampered`` holds: changed) row folds to, per row of ``docs``."""
    return Manifest(docs, tampered, **options).proofs()
