"""Distributed ordered computations.

``running_total`` computes a global running sum in a fixed order without an
un-partitioned window (which would move every row into one task): rows are
range-partitioned on the ordering and written once with their partition
number; sums within each partition and the partition totals (one row per
partition) both read that table, so they agree on the partition bounds
whatever the optimizer does to either branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanecraft.plans.materialize import materialize


def running_total(df: DataFrame, order: list[Column], value: str, out: str = "running_total",
                  partitions: int | None = None) -> DataFrame:
    """Global running sum of ``value`` along ``order`` (which must be a total order)."""
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a range partitioning samples its own bounds: it must run exactly once
    part = materialize(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()), "ranged")
    local_w = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = part.withColumn("__local", F.sum(value).over(local_w))
    totals = part.groupBy("__pid").agg(F.sum(value).alias("__ptotal"))
    # one row per partition: the prefix sum is tiny
    offs = totals.withColumn(
        "__offset", F.coalesce(F.sum("__ptotal").over(
            Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(totals.schema["__ptotal"].dataType)))
    return (local.join(offs.select("__pid", "__offset"), "__pid")
                 .withColumn(out, F.col("__local") + F.col("__offset"))
                 .drop("__pid", "__local", "__offset"))
