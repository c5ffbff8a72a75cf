"""Connected components by alternating large-star / small-star rounds over a staged edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanecraft.llm.common import stage

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node reachable.

    Each half round joins every edge with the least neighbour of its end: a minimum with map-side
    combination and a join that Spark may split where a node is hot.  Rounds end when the edges are stars.
    Self-loops only name their node; null ends are ignored.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: a > b throughout, so every neighbour of a is smaller
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links = stage(small, "edges")
        # stars: no node is both an end and a centre
        mark = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not converge in {MAX_ROUNDS} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("root"))
    alone = loops.select("node", F.col("node").alias("root"))
    return roots.unionByName(centres).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
