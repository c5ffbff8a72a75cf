"""Exact quantiles without a single-task buffer.

Spark's ``percentile`` keeps a map of every distinct value of a group in one
task; on a high-cardinality column of a very large table that map does not
fit.  ``exact_quantiles`` computes the same linear-interpolation quantile
(position = (n − 1)·p, result = (hi − pos)·v_lo + (pos − lo)·v_hi) in one
distributed way at every size, all columns in one pass:

1. the columns are unpivoted to (column, value) and counted — duplicates
   collapse map-side, so a value that holds a third of all rows is one row;
2. a global running count over the distinct values, range-partitioned by
   (column, value) (:func:`lanecraft.functions.windows.running_total`);
3. the (at most two) distinct values whose cumulative-count interval contains
   the target ranks are selected by a filter and interpolated.

Null and NaN values are missing.  The result is a one-row DataFrame, meant to
be crossed into a plan.

``group_quantiles`` does the same per group, with the groups spread over the
same range partitions: a group that holds half of all rows (and values) is
many partitions, not one buffer.  ``group_median`` picks the way by the type
of the column: whole numbers (days, units) repeat, so their ``median`` buffer
is as small as their range; fractional ones take the distributed way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lanecraft.functions.windows import running_total
from lanecraft.plans.materialize import materialize


def column_quantiles(df: DataFrame, probs: dict[str, list[float]], prefix: str = "q") -> DataFrame:
    """One row with columns ``{prefix}{i}_{j}`` for the j-th probability of the i-th column (null when the
    column has no values)."""
    cols = list(probs)
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    long = df.select(F.explode(pairs).alias("x")).select("x.k", "x.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    cum = running_total(counts, [F.col("k").asc(), F.col("v").asc()], "c", "cum")
    # rows per column, and rows of the columns before it: one row per column
    sizes = cum.groupBy("k").agg(F.sum("c").alias("n"), F.max("cum").alias("last"))
    ranked = cum.join(sizes, "k").withColumn("cum", F.col("cum") - (F.col("last") - F.col("n")))
    at = lambda r: (F.col("cum") - F.col("c") <= r) & (r < F.col("cum"))
    aggs, outs = [], []
    for i, c in enumerate(cols):
        for j, p in enumerate(probs[c]):
            own = F.col("k") == i
            pos = (F.col("n") - 1) * F.lit(float(p))
            t = f"{i}_{j}"
            aggs += [F.max(F.when(own & at(F.floor(pos)), F.col("v"))).alias(f"__a{t}"),
                     F.max(F.when(own & at(F.ceil(pos)), F.col("v"))).alias(f"__b{t}"),
                     F.max(F.when(own, pos)).alias(f"__p{t}")]
            pos, a, b = F.col(f"__p{t}"), F.col(f"__a{t}"), F.col(f"__b{t}")
            lo, hi = F.floor(pos), F.ceil(pos)
            outs.append(F.when(lo == hi, a).otherwise((hi - pos) * a + (pos - lo) * b).alias(f"{prefix}{t}"))
    return ranked.agg(*aggs).select(*outs)  # a global aggregate: one row even without values


def exact_quantiles(df: DataFrame, col: str, probs: list[float], prefix: str = "q") -> DataFrame:
    """One row with columns ``{prefix}0, {prefix}1, …`` (null when no values)."""
    out = column_quantiles(df, {col: probs}, "__x")
    return out.select(*[F.col(f"__x0_{j}").alias(f"{prefix}{j}") for j in range(len(probs))])


def exact_medians(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row of medians, all columns in one pass; ``names`` maps a column to its output name."""
    out = column_quantiles(df, {c: [0.5] for c in names}, "__x")
    return out.select(*[F.col(f"__x{i}_0").alias(name) for i, name in enumerate(names.values())])


def exact_median(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    return exact_medians(df, {col: name or f"median_{col}"})


def group_quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """One row per group (rows with a null key are left out): the keys and a column per name of ``probs``, null for
    a group without values."""
    known = df
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    value = F.col(col).cast("double")
    rows = known.select(*keys, F.when(~F.isnan(value), value).alias("__v"))
    counts = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = counts.repartitionByRange(n, *keys, "__v").withColumn("__pid", F.spark_partition_id())
    part = materialize(part, "ranged-groups")
    held = F.when(F.col("__v").isNotNull(), F.col("__c")).otherwise(F.lit(0))
    sizes = part.groupBy(*keys, "__pid").agg(F.sum(held).alias("__own"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__pid", F.coalesce(F.sum("__own").over(before), F.lit(0)).alias("__before"),
                         F.sum("__own").over(Window.partitionBy(*keys)).alias("__n"))
    inside = Window.partitionBy(*keys, "__pid").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = part.withColumn("__cum", F.sum(held).over(inside)).join(sizes, [*keys, "__pid"])
    cum = F.col("__cum") + F.col("__before")
    at = lambda r: F.max(F.when(F.col("__v").isNotNull() & (cum - F.col("__c") <= r) & (r < cum), F.col("__v")))
    aggs, outs = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("__n") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"__a{i}"), at(F.ceil(pos)).alias(f"__b{i}"), F.max(pos).alias(f"__p{i}")]
        pos, a, b = F.col(f"__p{i}"), F.col(f"__a{i}"), F.col(f"__b{i}")
        lo, hi = F.floor(pos), F.ceil(pos)
        outs.append(F.when(lo == hi, a).otherwise((hi - pos) * a + (pos - lo) * b).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def whole(df: DataFrame, col: str) -> bool:
    """True for a column of whole numbers."""
    return isinstance(df.schema[col].dataType, T.IntegralType)


def group_median(df: DataFrame, keys: dict[str, str] | list[str], col: str, name: str) -> tuple[list[Column], Callable]:
    """(columns to aggregate by the keys, a function that completes the aggregated table) for a median per group.

    ``keys``: key columns of ``df``, mapped to their names in the aggregated table if these differ."""
    keys = keys if isinstance(keys, dict) else {k: k for k in keys}
    if whole(df, col):
        return [F.median(col).alias(name)], lambda out: out

    def complete(out: DataFrame) -> DataFrame:
        side = group_quantiles(df, list(keys), col, {name: 0.5})
        side = side.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], name)
        on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys.values())]
        return out.join(side, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])

    return [], complete
