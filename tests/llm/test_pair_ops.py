"""Similarity operators against all-pairs brute force: MinHash, embedding forest, top-k, repeated passages."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanecraft.llm import components, minhash, rp_forest, suffix_dedup, topk
from lanecraft.llm import queries as Q
from lanecraft.llm.common import block_pairs, prepare
from tests.llm.util import DOCS, near_pairs, repeats, roots, shingles, table

SF = "/root/testdata/sf0.01"
VECS = "vec_id long, embedding array<float>, label int"


def frame(spark, texts, first=0):
    prepare(spark)
    return spark.createDataFrame([(first + i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


# ── components ───────────────────────────────────────────────────────────────

def test_components_of_chains_stars_and_random_graphs(spark):
    prepare(spark)
    rng = random.Random(1)
    chain = [(i + 1, i) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    loose = [(rng.randrange(200, 320), rng.randrange(200, 320)) for _ in range(70)]
    links = chain + star + loose + [(400, 400)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = sorted({x for e in links for x in e})
    at = {x: i for i, x in enumerate(ids)}
    assert got == dict(zip(ids, roots(ids, [(at[a], at[b]) for a, b in links])))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ── MinHash ──────────────────────────────────────────────────────────────────

def check_minhash(got, ids, texts, percent):
    got = got.set_index("doc_id").loc[ids]
    assert got.n_shingles.tolist() == [len(shingles(t)) for t in texts]
    assert got.component_id.tolist() == roots(ids, list(near_pairs(texts, percent)))
    assert got.kept.tolist() == [a == b for a, b in zip(got.component_id, ids)]


def test_minhash_equals_all_pairs(spark):
    docs = table(SF, "documents")
    got = Q.op10_minhash_dedup(spark, SF).toPandas()
    assert len(got) == len(docs)
    check_minhash(got, docs.doc_id.tolist(), docs.text.tolist(), 85)


def family(rng, words, n, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


def test_minhash_families_with_few_links_to_one_member(spark, monkeypatch):
    """Members linked to each other but not to the bucket's smallest id; blocks of a few rows."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rng = random.Random(2)
    texts = [t for _ in range(6) for t in family(rng, 120, 40, 9)] + ["a b c", "A  B\tc", "a b", "", None, "  ", "a b c d e", "a b c d f"]
    rng.shuffle(texts)
    for percent in (85, 80):
        got = minhash.near_duplicates(frame(spark, texts, 10), percent=percent).toPandas()
        check_minhash(got, list(range(10, 10 + len(texts))), texts, percent)


def test_pairs_of_a_hot_key_spread_over_tasks(spark):
    """200 blocks under one key, a few under others: every pair once, no task with more than its share."""
    wide = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        number = {1: 200, 2: 1, 3: 2, 4: 17}
        df = spark.createDataFrame([(k, i, n, f"{k}/{i}") for k, n in number.items() for i in range(n)], "k long, i int, n int, x string")
        got = block_pairs(df, ["k"], "i", "n", "x").withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(k, i, j) for k, n in number.items() for i in range(n) for j in range(i, n)}
    assert len(got) == len(want) and set(zip(got.k, got.i, got.j)) == want
    assert (got.x == got.k.astype(str) + "/" + got.i.astype(str)).all() and (got.y == got.k.astype(str) + "/" + got.j.astype(str)).all()
    hot = got[got.k == 1].groupby("task").size()
    assert len(hot) >= 8 and hot.max() <= len(got) * 0.4


def test_minhash_edge_rows(spark):
    assert minhash.near_duplicates(frame(spark, []).limit(0)).count() == 0
    only_empty = minhash.near_duplicates(frame(spark, ["", None])).toPandas()
    assert only_empty.component_id.tolist() == only_empty.doc_id.tolist() and only_empty.kept.all()
    rows = [(5, "x y z", 1), (5, "x y z", 2), (3, "X Y Z", 3), (None, "x y z", 4), (9, "long " * 50_000, 5), (8, "long " * 50_001, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "'q' as id", "'q' as fp1", "'q' as bands", "'q' as root")
    got = minhash.near_duplicates(df).toPandas()
    assert len(got) == 6 and got[got.doc_id == 5].component_id.tolist() == [3, 3]
    assert got[got.doc_id == 8].component_id.tolist() == [8] and got[got.doc_id == 9].component_id.tolist() == [8]


def test_intersections_of_blocks(monkeypatch):
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[12:]] for a in sets[:12]]
    for columns in (1 << 14, 7):
        monkeypatch.setattr(minhash, "_COLUMNS", columns)
        assert minhash.intersections(sets[:12], sets[12:]).tolist() == want
    assert minhash.intersections([sets[0][:0]], sets[:2]).tolist() == [[0, 0]]


def test_signature_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.9, 1.0):
        est = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
            n = int(share * 200)
            a, b = np.sort(pool[:200]), np.sort(np.concatenate([pool[:n], pool[200:400 - n]]))
            with np.errstate(over="ignore"):
                m = minhash.minima(np.concatenate([a, b]), np.array([0, 200, 400]))
                sig = minhash.pack_bits(m)
            est.append(minhash.estimate(sig[:1], sig[1:])[0])
        assert abs(np.mean(est) - n / (400 - n)) < 0.04


# ── embedding forest ─────────────────────────────────────────────────────────

def links_of(x, threshold=0.9):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T >= threshold
    np.fill_diagonal(s, False)
    return s


def test_forest_recall_on_pairs_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.93 only: the hardest links.  Recall >= 0.9, no false link."""
    prepare(spark)
    rng = np.random.default_rng(5)
    n, d = 3000, 64
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    noise = rng.standard_normal((n, d))
    noise -= (noise * a).sum(1)[:, None] * a
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cos = rng.uniform(0.902, 0.93, n)[:, None]
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * noise]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(2 * n), "embedding": [v.tolist() for v in x], "label": 0}), VECS)
    got = rp_forest.near_duplicates(df).toPandas().sort_values("vec_id")
    want = links_of(x.astype(np.float64)).sum(1)
    assert (got.n_links.to_numpy() <= want).all()
    recall = got.n_links.sum() / want.sum()
    assert recall >= 0.9, recall


def test_forest_equals_brute_force_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "LEAF", 32)
    monkeypatch.setattr(rp_forest, "BLOCK", 16)
    prepare(spark)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((4, 16))
    x = np.concatenate([centre[k] + 0.08 * rng.standard_normal((m, 16)) for k, m in enumerate((150, 40, 3, 2))] + [rng.standard_normal((200, 16))])
    x = np.concatenate([x, np.repeat(x[:1], 60, 0)]).astype(np.float32)  # exact copies
    ids = np.arange(len(x))
    rng.shuffle(ids)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": [v.tolist() for v in x], "label": 1}), VECS)
    got = rp_forest.near_duplicates(df).toPandas().set_index("vec_id").loc[ids]
    s = links_of(x.astype(np.float64))
    assert (got.n_links.to_numpy() <= s.sum(1)).all() and got.n_links.sum() >= 0.97 * s.sum()
    if (got.n_links.to_numpy() == s.sum(1)).all():
        assert got.component_id.tolist() == roots(ids.tolist(), np.argwhere(s).tolist())


def test_forest_on_the_table(spark):
    vecs = table("/root/testdata/sf0.1", "embeddings")
    got = Q.op2_rp_forest(spark, "/root/testdata/sf0.1").toPandas().set_index("vec_id").loc[vecs.vec_id]
    s = links_of(np.stack(vecs.embedding).astype(np.float64))
    assert (got.n_links.to_numpy() <= s.sum(1)).all() and got.n_links.sum() >= 0.9 * s.sum()


ODD_VECS = [(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0),
            (6, [float("inf"), 0.0], 0), (7, [], 0), (8, [1.0, 0.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [0.0, 1.0], None), (20, [3e38, 1.0], 0), (None, [1.0, 0.0], 0)]


def test_forest_edge_rows(spark):
    prepare(spark)
    df = spark.createDataFrame(ODD_VECS, VECS).selectExpr("*", "1 as id", "2 as x", "3 as weight", "4 as n")
    got = rp_forest.near_duplicates(df).toPandas()
    assert len(got) == len(ODD_VECS)
    by = got.dropna(subset=["vec_id"]).drop_duplicates().set_index("vec_id")
    for i in (2, 3, 4, 5, 6, 7, 9):
        assert by.n_links[i] == 0 and by.component_id[i] == i and by.kept[i]
    assert by.n_links[0] == by.n_links[1] == by.n_links[8] == by.n_links[20] == 4
    assert {by.component_id[i] for i in (0, 1, 8, 20)} == {0}
    assert rp_forest.near_duplicates(df.limit(0)).count() == 0
    assert rp_forest.near_duplicates(df.where("vec_id = 2")).count() == 1


# ── top-k ────────────────────────────────────────────────────────────────────

def floor64(x):
    return int(x) * 64 if abs(x) >= 2.0**53 else int(np.floor(64 * float(x)))


def brute_top(rows, k=20, every=20):
    vecs = [(i, [floor64(x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(vecs):
        if q is not None and q % every == 0:
            found = []
            for b, (i, y) in enumerate(vecs):
                if a != b:
                    score = sum(s * t for s, t in zip(x, y))
                    found.append((-max(-2**63, min(2**63 - 1, score)), i is None, i or 0, i))
            out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=lambda r: (r[0], r[1]))


def test_top_k_with_ties_and_small_blocks(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(topk, "BLOCK", 50)
    rng = np.random.default_rng(7)
    x = np.where(rng.random((400, 12)) < 0.6, 0, rng.integers(-3, 4, (400, 12)) / 64).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECS).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=lambda r: r[:2]) == brute_top(rows)


def test_top_k_edge_rows(spark):
    prepare(spark)
    df = spark.createDataFrame(ODD_VECS, VECS).selectExpr("*", "1 as id", "2 as rank", "3 as score", "4 as block")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()), key=lambda r: r[:2])
    assert got == brute_top(ODD_VECS)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_components_of_any_size(spark, monkeypatch):
    """Components around and beyond 2^24 quantised, scores around 2^63, and the largest doubles; ids may be null."""
    prepare(spark)
    monkeypatch.setattr(topk, "BLOCK", 20)
    rng = np.random.default_rng(11)
    sizes = [1e-9, 0.3, 2.0**18, 2.0**18 + 1 / 64, 300_000.5, 2.0**28, 1e9, 5e15, 1e17]
    rows = [(None if i % 17 == 3 else i, [float(rng.choice([-1, 0, 1]) * rng.choice(sizes) * (1 + rng.random() * (i % 3))) for _ in range(6)], 0) for i in range(120)]
    rows += [(200, [1.7e308, 0.0], 0), (220, [0.0, 1.0, 1.7e308], 0), (221, [0.0, 3.0], 0), (222, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute_top(rows)


def test_top_k_streams_blocks_without_sorting_them(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(50)], VECS)
    plan = topk.top_k(df, F.col("vec_id") % 20 == 0)._jdf.queryExecution().sparkPlan().toString()
    above = plan[:plan.index("SortMergeJoin")]
    assert "Sort [" not in above.split("MapInArrow")[-1]


# ── repeated passages ────────────────────────────────────────────────────────

def passages(rng):
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60), text(90), text(45)]
    out = ["", None, "short", "é" * 150, "a" * 900, "ab" * 300]
    for _ in range(60):
        parts = [text(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4))]
        for s in shared:
            if rng.random() < 0.4:
                lo = rng.randrange(0, len(s) // 3)
                parts.insert(rng.randrange(len(parts) + 1), s[lo:len(s) - rng.randrange(0, len(s) // 3)])
        out.append(" ".join(parts))
    return out + [out[10], out[11], out[12][:230]]


@pytest.mark.parametrize("length, hot, limit", [(200, 4096, 1 << 20), (200, 1, 0), (40, 4096, 0), (40, 1, 1 << 20)])
def test_repeats_equal_brute_force(spark, length, hot, limit):
    texts = passages(random.Random(8))
    df = frame(spark, texts)
    for keep in ("none", "first"):
        got = suffix_dedup.remove_repeats(df, length=length, keep=keep, hot=hot, limit=limit).toPandas().set_index("doc_id").loc[range(len(texts))]
        want = repeats(texts, length, keep)
        assert got.n_bytes.tolist() == [w[0] for w in want]
        if keep == "none":
            assert list(zip(got.n_removed, got.n_spans, got.kept_sha256)) == [w[1:4] for w in want]
            assert got.text.tolist() == [w[4].decode("utf-8", "ignore") for w in want]
        else:  # one copy of everything stays, and nothing that isn't repeated goes
            assert all(g <= repeats(texts, length, "none")[i][1] for i, g in enumerate(got.n_removed))
            assert got.n_removed.tolist() == [w[1] for w in want]


def test_repeats_with_some_hot_anchors(spark):
    """Anchors beyond the bound and others in one table: each way gets its own."""
    texts = passages(random.Random(8))
    for keep in ("none", "first"):
        got = suffix_dedup.remove_repeats(frame(spark, texts), hot=3, keep=keep).toPandas().set_index("doc_id").loc[range(len(texts))]
        assert got.n_removed.tolist() == [w[1] for w in repeats(texts, 200, keep)]


def test_repeats_on_the_table(spark):
    docs = table("/root/testdata/sf0.001", "documents")
    got = Q.op8_suffix_dedup(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id").loc[docs.doc_id]
    want = repeats(docs.text)
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)) == [w[:4] for w in want]


def test_factors_equal_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(60):
        w = rng.integers(97, 99, (rng.integers(1, 30), 5)).astype(np.uint8)
        previous, following = suffix_dedup.factors(w)
        for i in range(len(w)):
            common = [int(np.argmin(np.append(w[i] == w[j], False))) for j in range(len(w))]
            assert (previous[i] == 5) == any(common[j] == 5 for j in range(i))
            assert (following[i] == 5) == any(common[j] == 5 for j in range(i + 1, len(w)))
            assert previous[i] <= max([0, *common[:i]]) and following[i] <= max([0, *common[i + 1:]])


def test_repeats_edge_rows(spark):
    assert suffix_dedup.remove_repeats(frame(spark, []).limit(0)).count() == 0
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long, "s"), (1, long, "s"), (2, None, "t"), (None, "y" * 100, "u"), (3, long[1000:1400] + "tail", "v"), (3, "another text of the same id", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").selectExpr("*", "'k' as key", "'k' as doc", "'k' as th", "'k' as spans", "'k' as row")
    got = suffix_dedup.remove_repeats(df, keep="none").toPandas()
    assert len(got) == 6
    assert got[got.doc_id == 1].n_removed.tolist() == [300_000, 300_000]
    assert sorted(got[got.doc_id == 3].n_removed) == [0, 400]
    assert {r["start"] for r in got.row} == {"s", "t", "u", "v", "w"}


def test_forest_recall_with_blind_splits():
    """A sample so small that most levels are random signs: pairs at the threshold still share a leaf."""
    rng = np.random.default_rng(5)
    for sample, total in ((256, 10**6), (20, 10**5), (2048, 10**7)):
        forest = rp_forest.Forest(rp_forest.units([v.tobytes() for v in rng.standard_normal((sample, 32))]), total)
        assert any(len(n) == 2 and n[1] > 0 for n in forest.trees[0])
        x, z = rng.standard_normal((2, 3000, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
        z -= (z * x).sum(1)[:, None] * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
        a, b = (set(zip(*(v.tolist() for v in forest.leaves(m)))) for m in (x, y))
        assert len({row for row, _ in a & b}) >= 0.985 * 3000, (sample, total, forest.count)


def test_texts_without_ids_are_told_apart(spark):
    """Two texts whose 32-bit digests are equal, one of which repeats elsewhere: the other loses nothing."""
    prepare(spark)
    text = F.concat(F.lit("x"), F.md5(F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512))
    many = spark.range(400_000).select(text.alias("text"), F.hash(text).alias("h"))
    a, b = many.groupBy("h").agg(F.collect_list("text").alias("t"), F.count("*").alias("n")).where("n > 1").first()["t"][:2]
    df = frame(spark, [])
    df = spark.createDataFrame([(None, a), (None, b), (7, "before " + a + " after")], df.select("doc_id", "text").schema)
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_repeats(df.withColumn("i", F.lit(1)), keep="none").where("doc_id is null").collect()}
    texts = sorted((r.text, r.n_removed) for r in suffix_dedup.remove_repeats(df, keep="none").where("doc_id is null").collect())
    assert texts == sorted([("", len(a)), (b, 0)]) and len(got) >= 1
