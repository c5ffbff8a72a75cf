"""Monthly series, Holt double exponential smoothing and forecasts.

A series is one row per (keys, month).  The smoothing recursion runs inside
Catalyst with ``aggregate`` over the month-sorted array of one series; the
array length is the number of months in the series (bounded by the time span,
not by the data volume), so any number of series (per factory, product, …)
scale out across tasks.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from lanecraft import schema as S

ALPHA = 0.4
BETA = 0.2
Z95 = 1.96
STD_SHRINK = 0.4


def monthly(df: DataFrame, keys: list[str] | None = None, date_col: str = S.ORDER_DATE) -> DataFrame:
    """Order month → order lines, sales, profit, mean lead (empty months absent)."""
    keys = keys or []
    period = F.date_trunc("month", F.col(date_col)).cast("date").alias("period")
    return (df.filter(F.col(date_col).isNotNull()).groupBy(*keys, period)
              .agg(F.count(S.ORDER_ID).alias("orders"), F.sum(S.SALES).cast("double").alias("sales"),
                   F.sum(S.GROSS_PROFIT).cast("double").alias("profit"),
                   F.avg(S.LEAD_TIME).alias("avg_lead_time")))


def holt_state(series: DataFrame, value_col: str = "orders", keys: list[str] | None = None,
               alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Final (level, trend) per series; level₀ = x₀, trend₀ = x₁ − x₀; needs > 3 points.

    Also returns the point count, last period and population std of the series."""
    keys = keys or []
    pts = F.array_sort(F.collect_list(F.struct(F.col("period"), F.col(value_col).cast("double").alias("x"))))
    g = series.groupBy(*keys).agg(pts.alias("__pts"), F.count(F.lit(1)).alias("points"),
                                  F.max("period").alias("last_period"),
                                  F.stddev_pop(F.col(value_col).cast("double")).alias("std_pop"))
    xs = F.transform("__pts", lambda p: p["x"])
    a, b = F.lit(float(alpha)), F.lit(float(beta))
    one = F.lit(1.0)

    def step(acc, v):
        level = a * v + (one - a) * (acc["level"] + acc["trend"])
        trend = b * (level - acc["level"]) + (one - b) * acc["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"))

    init = F.struct(xs[0].alias("level"), (xs[1] - xs[0]).alias("trend"))
    final = F.aggregate(F.slice(xs, 2, F.size(xs) - 1), init, step)
    return (g.filter(F.col("points") > 3)
             .select(*keys, "points", "last_period", "std_pop",
                     final["level"].alias("level"), final["trend"].alias("trend")))


def z_for(confidence: float) -> float:
    return NormalDist().inv_cdf((1.0 + confidence) / 2.0)


def forecast(state: DataFrame, horizon: int = 6, z: float = Z95, keys: list[str] | None = None,
             digits: int = 4) -> DataFrame:
    """h future months: max(0, level + k·trend) ± z·(0.4·std)·√k, lower ≥ 0."""
    keys = keys or []
    k = F.col("step")
    pred = F.greatest(F.lit(0.0), F.col("level") + k * F.col("trend"))
    half = F.lit(float(z)) * (F.col("std_pop") * STD_SHRINK) * F.sqrt(k.cast("double"))
    r = lambda c: F.rint(c * float(10 ** digits)) / float(10 ** digits)
    return (state.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
                 .select(*keys, "step", F.add_months(F.col("last_period"), k).alias("period"),
                         r(pred).alias("forecast"), r(pred + half).alias("upper"),
                         r(F.greatest(F.lit(0.0), pred - half)).alias("lower")))


def forecast_from_config(state: DataFrame, config: dict, keys: list[str] | None = None) -> DataFrame:
    fs = config.get("forecast_settings", {})
    return forecast(state, int(fs.get("default_horizon_months", 6)), z_for(float(fs.get("confidence_level", 0.95))),
                    keys)
