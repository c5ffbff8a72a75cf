"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources.  They are aggregated by membership pattern (the sorted set of
their sources); a flow network routes word capacity

    start -> pattern (one arc per repetition, dearer with each) -> source (its quota) -> end

so quotas are met with the fewest repetitions.  Each pattern's flow is then turned into documents: all
documents are taken floor(flow / size) times, and for the remainder a seeded hash picks documents.
Documents of over 1 / ``LONG`` of a pattern's words (fewer than ``LONG``) are settled first, so that the
others can fill what is left.  These are taken in hash order; one that overshoots is skipped and the order
goes on behind it with those that still fit, until none does.  Each cut in hash order comes from two levels
of hash histograms (no ordered pass over a source).

The network has one node per pattern and source, not per document.  Null text has size 0 and is never
taken; a null source is a source of its own, last in order.  Rows of one id and text are taken together and
count each; rows without an id are told apart by their text; an empty table gives an empty result.  Reruns
agree: the choice depends on ids, texts and the seed alone.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lanecraft.llm.common import column, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TAKE_SHARE = 1.5
MAX_REPEATS = 2
#: Text of a plan (patterns, cuts, long documents) that is broadcast at most.
PLAN_BYTES = 8 << 20
SEED = 20_240_607
LONG = 1024
CELLS = 4096
KEY = "struct<h:bigint,t:bigint,size:bigint>"
MEMBERSHIP = "array<struct<source:string,source_size:bigint,target:double,quota:bigint>>"


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white-space (ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_code_point(names: list[str | None]) -> list[str | None]:
    return sorted((x for x in names if x is not None)) + [None] * (None in names)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = TAKE_SHARE, most: float = MAX_REPEATS,
            total: int | None = None) -> dict[str | None, float]:
    """Split share * all words by repeating weights; no source above ``most`` times its size, the excess is
    reshared by weight among the others until none is above.  ``total``: all words, where sources overlap."""
    order = by_code_point(list(sizes))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = min(share, most) * float(sum(sizes.values()) if total is None else total)
    out: dict[str | None, float] = {}
    free = list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not full:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in full]
    return {s: out.get(s, 0.0) for s in order}


def min_cost_flow(supply: dict[tuple, int], quota: dict[str | None, int], repeats: int = MAX_REPEATS) -> dict[tuple[tuple, str | None], int]:
    """Words routed from each pattern to each of its sources (successive shortest paths, integer).

    A pattern offers its size once per repetition; repetition k costs k a word (convex, so the first
    copies of all patterns are used before any second one).  Patterns that share no source, not even by way
    of others, are networks of their own."""
    group = {s: s for s in quota}

    def root(s):
        while group[s] != s:
            group[s] = s = group[group[s]]
        return s

    for p in supply:
        known = [root(s) for s in p if s in quota]
        for s in known[1:]:
            group[root(s)] = root(known[0])
    networks: dict = {root(s): ({}, {}) for s in quota}
    for s, n in quota.items():
        networks[root(s)][1][s] = n
    for p, n in supply.items():
        if known := [s for s in p if s in quota]:
            networks[root(known[0])][0][p] = n
    out: dict = {}
    for part, goals in networks.values():
        out |= _cheapest(part, goals, repeats)
    return out


def _cheapest(supply: dict[tuple, int], quota: dict[str | None, int], repeats: int) -> dict[tuple[tuple, str | None], int]:
    patterns, sources = list(supply), list(quota)
    nodes = {"start": 0, "end": 1} | {("p", p): i + 2 for i, p in enumerate(patterns)}
    nodes |= {("s", s): len(nodes) + i for i, s in enumerate(sources)}
    head: list[list[int]] = [[] for _ in nodes]
    to, cap, cost = [], [], []

    def arc(a, b, c, w):
        for x, y, c_, w_ in ((a, b, c, w), (b, a, 0, -w)):
            head[nodes[x]].append(len(to))
            to.append(nodes[y])
            cap.append(c_)
            cost.append(w_)
        return len(to) - 2

    for p in patterns:
        for k in range(repeats):
            arc("start", ("p", p), supply[p], k)
    routed = {(p, s): arc(("p", p), ("s", s), supply[p] * repeats, 0) for p in patterns for s in p if s in quota}
    for s in sources:
        arc(("s", s), "end", quota[s], 0)
    while True:
        far = [float("inf")] * len(nodes)
        far[0], via, queue, queued = 0, [-1] * len(nodes), deque([0]), {0}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in head[a]:
                if cap[e] > 0 and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[a] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if via[1] < 0:
            return {k: cap[e ^ 1] for k, e in routed.items()}
        path, at = [], 1
        while at:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def choose_long(units: list[tuple], goal: int, rest: int) -> list[tuple]:
    """Units (h, t, size, words) of at most ``goal`` words in all, as many that ``rest`` words of shorter documents can
    fill what is left, if some order gives them; beyond that in proportion to the pattern."""
    total = sum(u[3] for u in units)
    share = goal * total / max(1, total + rest)
    best: tuple[int, list] = (-1, [])
    for order in (sorted(units), sorted(units, key=lambda u: (-u[3], u))):
        n, out = 0, []
        for u in order:
            if n + u[3] <= goal and (n < goal - rest or n + u[3] / 2 <= share):
                n += u[3]
                out.append(u)
        if n > best[0]:
            best = n, out
        if n >= goal - rest:
            break
    return best[1]


def _table(rows: list[dict], schema: str, spark) -> DataFrame:
    """Rows of a plan, built by the JVM: no Python workers.  Broadcast up to ``PLAN_BYTES`` of text, else written."""
    text = json.dumps(rows)
    made = spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))
    return F.broadcast(made) if len(text) <= PLAN_BYTES else stage(made, "plan")


def _cells(rows: DataFrame, goal: DataFrame, cell: str) -> dict:
    """Per pattern the hash cell in which the running size reaches the goal, the words before it, and all words."""
    sums = rows.groupBy("pattern", cell).agg(F.sum("size").alias("n"))
    w = Window.partitionBy("pattern").orderBy(cell)
    run = sums.withColumn("end", F.sum("n").over(w)).withColumn("begin", F.col("end") - F.col("n"))
    found = run.join(goal.select("pattern", "missing"), "pattern").groupBy("pattern").agg(
        F.max(F.when(F.col("begin") <= F.col("missing"), F.struct("begin", cell))).alias("x"), F.max("end").alias("all"))
    return {r["pattern"]: (r["x"][cell], r["x"]["begin"], r["all"]) for r in found.collect()}


def _cut(rows: DataFrame, open_: list[dict], spark) -> None:
    """One cut in hash order for every open pattern: adds the stretch taken to its ``cuts``, up to the first document
    that overshoots; the next cut goes on behind that one with documents of at most the words still missing."""
    plan = {p["pattern"]: p for p in open_}
    schema = f"pattern:string,missing:bigint,long:bigint,behind:{KEY}"
    goal = _table([{"pattern": k, "missing": p["missing"], "long": p["long_from"], "behind": p["behind"]} for k, p in plan.items()], schema, spark)
    fit = rows.join(goal, "pattern").where((F.col("size") > 0) & (F.col("size") <= F.col("missing")) & (F.col("size") < F.col("long"))
                                           & (F.col("behind").isNull() | (F.struct("h", "t", "size") > F.col("behind")))).select(*rows.columns)
    c1 = _cells(fit, goal, "c1")
    for k, p in plan.items():
        if k not in c1 or c1[k][2] <= p["missing"]:  # nothing left, or all of it
            p["cuts"].append({"behind": p["behind"], "upto": None, "most": p["missing"]})
            p["missing"], p["done"] = p["missing"] - (c1[k][2] if k in c1 else 0), True
    at = [{"pattern": k, "c1": c1[k][0], "missing": p["missing"] - c1[k][1]} for k, p in plan.items() if not p.get("done")]
    if not at:
        return
    goal1 = _table(at, "pattern:string,c1:int,missing:bigint", spark)
    inner = fit.join(goal1.drop("missing"), ["pattern", "c1"])
    c2 = _cells(inner, goal1, "c2")
    last = _table([x | {"c2": c2[x["pattern"]][0], "missing": x["missing"] - c2[x["pattern"]][1]} for x in at],
                  "pattern:string,c1:int,c2:int,missing:bigint", spark)
    # documents of the last cell (one in CELLS^2 of a pattern) are ordered one by one, equal rows as one
    units = fit.join(last.drop("missing"), ["pattern", "c1", "c2"]).groupBy("pattern", "h", "t", "size").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("pattern").orderBy("h", "t", "size")
    over = units.withColumn("begin", F.sum("words").over(w) - F.col("words")).join(last.select("pattern", "missing"), "pattern") \
        .where(F.col("begin") + F.col("words") > F.col("missing"))
    first = over.groupBy("pattern").agg(F.min(F.struct("h", "t", "size", "begin")).alias("x"))
    for r in first.collect():
        p, x = plan[r["pattern"]], r["x"]
        upto = {"h": x["h"], "t": x["t"], "size": x["size"]}
        p["cuts"].append({"behind": p["behind"], "upto": upto, "most": p["missing"]})
        p["missing"] -= c1[r["pattern"]][1] + c2[r["pattern"]][1] + x["begin"]
        p["behind"] = upto


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = TAKE_SHARE, repeats: int = MAX_REPEATS, seed: int = SEED, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, size, copies (0..repeats) and its sources, each with the source's
    size and target and the words that the document's pattern gives it.

    ``source_col`` holds one source (string) or several (array of strings).  ``whole``: with the row itself
    as struct ``row``.
    """
    many = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    pattern = F.coalesce(F.sort_array(F.array_distinct(source_col)), F.array().cast("array<string>")) if many else F.array(F.col(source_col))
    pattern = F.when(F.size(pattern) == 0, F.array(F.lit(None).cast("string"))).otherwise(pattern)
    name = F.col(id_col).cast("string")
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(name, F.col(text_col)), F.lit(seed)), 1)

    def measured(*first: Column) -> DataFrame:
        return docs.select(*first, F.to_json(pattern).alias("pattern"), word_count(F.col(text_col)).alias("size"), h.alias("h"),
                           F.xxhash64(name, F.col(text_col)).alias("t"))

    rows = stage(measured(F.col(id_col).alias("id")), "sizes")
    spark = docs.sparkSession
    # patterns are named by Spark's own text of them, whatever way it writes control characters
    supply, name_of = {}, {}
    for r in rows.groupBy("pattern").agg(F.sum("size").alias("n")).collect():
        own = tuple(json.loads(r["pattern"]))
        supply[own], name_of[own] = r["n"], r["pattern"]
    # whole rows are measured again: cheaper than keeping their texts on disk
    every = measured(F.col(id_col).alias("id"), F.struct(*map(column, docs.columns)).alias("row")) if whole else rows
    row = ["row"] if whole else []
    if not supply:
        return every.select(F.col("id").alias(id_col), "size", F.lit(0).alias("copies"), F.lit(None).cast(MEMBERSHIP).alias("sources"), *row)
    sizes: dict[str | None, int] = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goals = targets(sizes, weights, share, repeats, sum(supply.values()))
    flow = min_cost_flow(supply, {s: round(t) for s, t in goals.items()}, repeats)
    taken = dict.fromkeys(supply, 0)
    for (p, _), n in flow.items():
        taken[p] += n
    base = {p: taken[p] // n if n else 0 for p, n in supply.items()}
    plan = {name_of[p]: {"pattern": name_of[p], "base": base[p], "missing": taken[p] - base[p] * n, "long_from": n // LONG + 1, "behind": None, "cuts": [], "long": [],
                      "sources": [{"source": s, "source_size": sizes[s], "target": goals[s], "quota": flow[p, s]} for s in p]} for p, n in supply.items()}
    edge = _table([{"pattern": k, "long": p["long_from"]} for k, p in plan.items()], "pattern:string,long:bigint", spark)
    long: dict[str, list] = {k: [] for k in plan}
    for r in rows.join(edge, "pattern").where("size >= long").groupBy("pattern", "h", "t", "size").agg(F.sum("size").alias("words")).collect():
        long[r["pattern"]].append((r["h"], r["t"], r["size"], r["words"]))
    for p, n in supply.items():
        own = plan[name_of[p]]
        picked = choose_long(long[name_of[p]], own["missing"], n - sum(u[3] for u in long[name_of[p]]))
        own["long"] = [{"h": u[0], "t": u[1], "size": u[2]} for u in picked]
        own["missing"] -= sum(u[3] for u in picked)
    cells = rows.withColumn("c1", F.shiftright("h", 51).cast("int")).withColumn("c2", F.shiftright("h", 39).bitwiseAND(CELLS - 1).cast("int"))
    while open_ := [p for p in plan.values() if p["missing"] > 0 and not p.get("done")]:
        _cut(cells, open_, spark)
    fields = f"pattern:string,base:int,long_from:bigint,long:array<{KEY}>,cuts:array<struct<behind:{KEY},upto:{KEY},most:bigint>>,sources:{MEMBERSHIP}"
    state = _table(list(plan.values()), fields, spark)
    copies = F.col("base") + _taken().cast("int")
    return every.join(state, "pattern").select(
        F.col("id").alias(id_col), "size", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), "sources", *row)


def _taken() -> Column:
    """Taken for the remainder: a long document that was chosen, or one in a stretch of hash order that fits there."""
    key = F.struct("h", "t", "size")
    cut = F.exists("cuts", lambda c: (F.col("size") <= c["most"]) & (c["behind"].isNull() | (key > c["behind"])) & (c["upto"].isNull() | (key < c["upto"])))
    return F.when(F.col("size") >= F.col("long_from"), F.array_contains("long", key)).otherwise(cut)
