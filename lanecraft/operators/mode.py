"""Ship-mode analytics: summary with shares, lead distribution and box
statistics, monthly trend, factory / region pivots, cost–time trade-off,
mode × region delay, on-time vs delayed (wide and long), best / worst mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import delay_mean, margin_pct, money_mean, rintn
from lanecraft.functions.quantiles import group_median, group_quantiles, whole
from lanecraft.operators.kpi import with_mode_order
from lanecraft.plans.materialize import join_back


def mode_summary(df: DataFrame, mode_order: DataFrame) -> DataFrame:
    lead = F.col(S.LEAD_TIME)
    median, complete = group_median(df, [S.SHIP_MODE], S.LEAD_TIME, "__med")
    agg = (df.filter(F.col(S.SHIP_MODE).isNotNull()).groupBy(S.SHIP_MODE)
             .agg(F.count(S.ROW_ID).alias("shipments"),
                  F.sum(S.SALES).alias("__sales"), F.sum(S.GROSS_PROFIT).alias("__profit"),
                  F.sum(S.UNITS).cast("long").alias("total_units"),
                  rintn(F.avg(lead), 2).alias("avg_lead_time"),
                  *median,
                  rintn(F.stddev_samp(lead), 2).alias("std_lead_time"),
                  F.min(lead).alias("min_lead_time"), F.max(lead).alias("max_lead_time"),
                  delay_mean(S.DELAY_FLAG).alias("delay_rate"),
                  rintn(money_mean(S.COST), 2).alias("avg_cost"),
                  F.round(F.sum(S.COST), 2).cast("double").alias("total_cost")))
    # shares: window over the aggregated (one row per mode) table
    w = Window.partitionBy()
    out = (complete(agg).withColumn("median_lead_time", rintn("__med", 2))
              .withColumn("total_sales", F.col("__sales").cast("double"))
              .withColumn("total_profit", F.col("__profit").cast("double"))
              .withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2))
              .withColumn("profit_per_shipment", rintn(F.col("total_profit") / F.col("shipments"), 2))
              .withColumn("sales_per_shipment", rintn(F.col("total_sales") / F.col("shipments"), 2))
              .withColumn("profit_margin_pct", margin_pct(F.col("__profit"), F.col("__sales")))
              .withColumn("volume_share_pct",
                          rintn(F.col("shipments") / F.sum("shipments").over(w) * 100.0, 2))
              .withColumn("sales_share_pct",
                          rintn(F.col("total_sales") / F.sum("__sales").over(w).cast("double") * 100.0, 2))
              .drop("__sales", "__profit", "__med"))
    return with_mode_order(out, mode_order)


def lead_distribution(df: DataFrame) -> DataFrame:
    return df.select(S.SHIP_MODE, S.LEAD_TIME)


def box_stats(df: DataFrame, group_col: str = S.SHIP_MODE, value_col: str = S.LEAD_TIME) -> DataFrame:
    """Quartiles (linear), 1.5·IQR whiskers clamped to the data, outlier count.

    Quartiles of whole numbers are one aggregate per group, those of fractional
    values are found by a distributed running count; the fences are joined back
    (small, size-checked) to find whisker ends and count outliers in a second
    pass.  NaN is missing, like null."""
    d = df.filter(F.col(group_col).isNotNull() & F.col(value_col).isNotNull())
    if whole(df, value_col):
        q = (d.groupBy(group_col)
              .agg(F.percentile(value_col, [0.25, 0.5, 0.75]).alias("__q"), F.count(value_col).alias("n"))
              .select(group_col, "n", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q3")))
    else:
        d = d.filter(~F.isnan(F.col(value_col).cast("double")))
        q = group_quantiles(d, [group_col], value_col, {"q1": 0.25, "median": 0.5, "q3": 0.75}).join(
            d.groupBy(group_col).agg(F.count(value_col).alias("n")), group_col)
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
          .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    fences = q.select(F.col(group_col).alias("__g"), "lower_fence", "upper_fence")
    j = join_back(d, fences, F.col(group_col) == F.col("__g"), "inner", "box_fences")
    v = F.col(value_col)
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    w = (j.groupBy(group_col)
          .agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
               F.count_if(~inside).alias("outliers")))
    return q.join(w, group_col)


def monthly_mode_trend(df: DataFrame) -> DataFrame:
    keys = ["ship_year", "ship_month", S.SHIP_MODE]
    agg = (df.filter(F.col("ship_year").isNotNull() & F.col(S.SHIP_MODE).isNotNull()).groupBy(*keys)
             .agg(F.count(S.ROW_ID).alias("shipments"), F.sum(S.SALES).cast("double").alias("total_sales"),
                  rintn(F.avg(S.LEAD_TIME), 2).alias("avg_lead_time"), delay_mean(S.DELAY_FLAG).alias("delay_rate")))
    return agg.withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2)).orderBy(*keys)


def mode_pivot(df: DataFrame, row_col: str, modes: list[str]) -> DataFrame:
    """row_col × ship-mode shipment counts; ``modes`` names the columns (missing → 0), any other mode is
    counted under ``other``."""
    mode = F.when(F.col(S.SHIP_MODE).isin(modes), F.col(S.SHIP_MODE)).otherwise("other")
    known = df.filter(F.col(row_col).isNotNull())
    counts = known.withColumn("__mode", F.when(F.col(S.SHIP_MODE).isNotNull(), mode)).groupBy(row_col)
    return counts.pivot("__mode", [*modes, "other"]).agg(F.count(S.ROW_ID)).fillna(0)


def cost_time_tradeoff(summary: DataFrame) -> DataFrame:
    return summary.select(S.SHIP_MODE, "avg_cost", "avg_lead_time", "delay_rate_pct", "profit_margin_pct",
                          "shipments", "volume_share_pct", "sales_share_pct", "mode_order")


def delay_by_mode_region(df: DataFrame) -> DataFrame:
    agg = (df.filter(F.col(S.SHIP_MODE).isNotNull() & F.col(S.REGION).isNotNull())
             .groupBy(S.SHIP_MODE, S.REGION)
             .agg(F.count(S.ROW_ID).alias("shipments"), delay_mean(S.DELAY_FLAG).alias("delay_rate")))
    return (agg.withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2))
               .orderBy(F.col(S.SHIP_MODE).asc(), F.col("delay_rate_pct").desc(), S.REGION))


def on_time_vs_delayed(df: DataFrame, mode_order: DataFrame) -> DataFrame:
    flag = F.col(S.DELAY_FLAG)
    agg = (df.filter(F.col(S.SHIP_MODE).isNotNull() & flag.isNotNull()).groupBy(S.SHIP_MODE)
             .agg(F.count_if(~flag).alias("on_time"), F.count_if(flag).alias("delayed"))
             .withColumn("total", F.col("on_time") + F.col("delayed")))
    return with_mode_order(agg, mode_order)


def status_long(wide: DataFrame) -> DataFrame:
    """(ship_mode, status, count) with labels On Time / Delayed."""
    return wide.selectExpr(S.SHIP_MODE, "stack(2, 'On Time', on_time, 'Delayed', delayed) as (status, count)")


def best_worst_mode(summary: DataFrame) -> DataFrame:
    """Mode with the lowest and highest delay % (ties → first in speed order)."""
    return summary.agg(
        F.min_by(S.SHIP_MODE, F.struct("delay_rate_pct", "mode_order")).alias("best_mode"),
        F.min("delay_rate_pct").alias("best_delay_rate_pct"),
        F.min_by(S.SHIP_MODE, F.struct(-F.col("delay_rate_pct"), F.col("mode_order"))).alias("worst_mode"),
        F.max("delay_rate_pct").alias("worst_delay_rate_pct"))
