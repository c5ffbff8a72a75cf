"""Route analytics (state- or region-level): summary, top/worst, consistency,
volume, heat map, delay breakdown, bottlenecks, leaderboard bands, cards.

All outputs are aggregates over the fact; the only windows (rank, ordering)
run on the aggregated route table (≈ factories × destinations rows).
Ordering ties are broken by route name so top-n cuts are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import band, money_sum, rintn
from lanecraft.functions.quantiles import group_median


def _route_cols(level: str):
    if level == "state":
        return S.STATE_ROUTE, S.STATE
    if level == "region":
        return S.REGION_ROUTE, S.REGION
    raise ValueError(f"level must be 'state' or 'region', got {level!r}")


def route_summary(df: DataFrame, level: str = "state") -> DataFrame:
    """One row per route with volume, money, lead statistics, delay %, CV,
    mean score (all 2 dp) and ``rank`` = min-rank of the rounded score, desc."""
    route_col, dest = _route_cols(level)
    keys = [F.col(route_col), F.col(S.FACTORY), F.col(dest)]
    d = df.filter(keys[0].isNotNull() & keys[1].isNotNull() & keys[2].isNotNull())
    lead = F.col(S.LEAD_TIME)
    median, complete = group_median(d, {route_col: "route", S.FACTORY: "factory", dest: "destination"}, S.LEAD_TIME, "__med")
    agg = (d.groupBy(F.col(route_col).alias("route"), F.col(S.FACTORY).alias("factory"),
                     F.col(dest).alias("destination"))
             .agg(F.count(S.ROW_ID).alias("shipments"),
                  money_sum(S.SALES).alias("total_sales"),
                  money_sum(S.GROSS_PROFIT).alias("total_profit"),
                  F.sum(S.UNITS).alias("total_units"),
                  F.avg(lead).alias("__avg"),
                  *median,
                  F.stddev_samp(lead).alias("__std"),
                  F.min(lead).alias("min_lead_time"),
                  F.max(lead).alias("max_lead_time"),
                  F.avg(F.col(S.DELAY_FLAG).cast("int")).alias("delay_rate"),
                  F.avg(S.SCORE).alias("__score")))
    cv = F.coalesce(F.try_divide(F.col("__std"), F.col("__avg")), F.lit(0.0))
    out = complete(agg).select(
        "route", "factory", "destination", "shipments", "total_sales", "total_profit", "total_units",
        rintn("__avg", 2).alias("avg_lead_time"), rintn("__med", 2).alias("median_lead_time"),
        rintn("__std", 2).alias("std_lead_time"), "min_lead_time", "max_lead_time", "delay_rate",
        rintn(F.col("delay_rate") * 100.0, 2).alias("delay_rate_pct"),
        rintn(cv, 2).alias("lead_time_cv"),
        rintn("__score", 2).alias("avg_efficiency_score"))
    return with_score_rank(out)


def with_score_rank(summary: DataFrame, score_col: str = "avg_efficiency_score") -> DataFrame:
    """rank(method='min', descending) of the score; null score → null rank.

    The window has no partition key: it runs on the aggregated route table."""
    w = Window.orderBy(F.col(score_col).desc_nulls_last())
    return summary.withColumn("rank", F.when(F.col(score_col).isNotNull(), F.rank().over(w)))


def top_routes(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy(F.col("avg_efficiency_score").desc_nulls_last(), F.col("route")).limit(n)


def worst_routes(summary: DataFrame, n: int = 10) -> DataFrame:
    """Last n by score (reference: tail of the descending list), ascending."""
    return summary.orderBy(F.col("avg_efficiency_score").asc_nulls_first(), F.col("route").desc()).limit(n)


def most_consistent_routes(summary: DataFrame, n: int = 10, min_shipments: int = 5) -> DataFrame:
    return (summary.filter(F.col("shipments") >= min_shipments)
                   .orderBy(F.col("lead_time_cv").asc(), F.col("route")).limit(n))


def most_variable_routes(summary: DataFrame, n: int = 10, min_shipments: int = 5) -> DataFrame:
    return (summary.filter(F.col("shipments") >= min_shipments)
                   .orderBy(F.col("lead_time_cv").desc(), F.col("route")).limit(n))


def high_volume_routes(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy(F.col("shipments").desc(), F.col("route")).limit(n)


def route_heatmap(summary: DataFrame, metric: str = "avg_lead_time") -> DataFrame:
    """Mean of ``metric`` for every factory × destination seen (missing → 0), one row per cell.

    Long form: no list of destinations is collected to name columns."""
    cells = summary.groupBy("factory", "destination").agg(F.avg(metric).alias(metric))
    grid = summary.select("factory").distinct().crossJoin(summary.select("destination").distinct())
    return grid.join(cells, ["factory", "destination"], "left").withColumn(metric, F.coalesce(metric, F.lit(0.0)))


def route_delay_breakdown(df: DataFrame, level: str = "state") -> DataFrame:
    """Per route: delayed, on-time and total counts."""
    route_col, _ = _route_cols(level)
    flag = F.col(S.DELAY_FLAG)
    return (df.filter(F.col(route_col).isNotNull() & flag.isNotNull())
              .groupBy(F.col(route_col).alias("route"))
              .agg(F.count_if(flag).alias("delayed"), F.count_if(~flag).alias("on_time"))
              .withColumn("total", F.col("delayed") + F.col("on_time")))


def bottleneck_routes(summary: DataFrame, delay_threshold: float = 50.0, min_shipments: int = 10) -> DataFrame:
    return (summary.filter((F.col("delay_rate_pct") >= delay_threshold) & (F.col("shipments") >= min_shipments))
                   .orderBy(F.col("delay_rate_pct").desc(), F.col("route")))


def route_leaderboard(summary: DataFrame, n: int = 10, ascending: bool = False) -> DataFrame:
    """Top-n by score with a colour band (≥0.6 good, ≥0.4 warn, else bad)."""
    order = F.col("avg_efficiency_score").asc() if ascending else F.col("avg_efficiency_score").desc()
    return (summary.select("route", "avg_efficiency_score")
                   .orderBy(order, F.col("route")).limit(n)
                   .withColumn("band", band("avg_efficiency_score", 0.6, 0.4)))


def route_cards(summary: DataFrame) -> DataFrame:
    """Distinct routes and means over routes of score, delay % and lead."""
    return summary.agg(F.count("route").alias("routes"),
                       rintn(F.avg("avg_efficiency_score"), 4).alias("mean_route_score"),
                       rintn(F.avg("delay_rate_pct"), 2).alias("mean_route_delay_pct"),
                       rintn(F.avg("avg_lead_time"), 2).alias("mean_route_lead_time"))


def slowest_routes(summary: DataFrame, n: int = 3) -> DataFrame:
    return summary.orderBy(F.col("avg_lead_time").desc(), F.col("route")).limit(n)


def fastest_routes(summary: DataFrame, n: int = 3) -> DataFrame:
    return summary.orderBy(F.col("avg_lead_time").asc(), F.col("route")).limit(n)
