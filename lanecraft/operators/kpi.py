"""KPI operators: the 20-scalar summary, factory / route / ship-mode
performance, monthly trend, top and bottom products.

Distinct counts are computed as separate one-column aggregates and crossed
in (each reads only its column; no ``Expand`` that multiplies the fact by the
number of distinct aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import (delay_mean, margin_pct, money_avg, money_mean, money_sum, money_total,
                                       rintn)
from lanecraft.functions.quantiles import exact_median, group_median, whole


def summary(df: DataFrame) -> DataFrame:
    """All headline KPIs in one row."""
    lead = F.col(S.LEAD_TIME)
    main = df.agg(
        F.count(F.lit(1)).alias("total_shipments"),
        F.sum(S.UNITS).cast("long").alias("total_units"),
        rintn(F.avg(S.UNITS), 2).alias("avg_units_per_order"),
        money_sum(S.SALES).alias("total_sales"),
        money_sum(S.GROSS_PROFIT).alias("total_profit"),
        money_sum(S.COST).alias("total_cost"),
        money_avg(S.SALES).alias("avg_sales"),
        money_avg(S.GROSS_PROFIT).alias("avg_profit"),
        money_avg(S.COST).alias("avg_cost"),
        margin_pct(F.sum(S.GROSS_PROFIT), F.sum(S.SALES)).alias("profit_margin_pct"),
        rintn(F.avg(lead), 2).alias("avg_lead_time"),
        *([rintn(F.median(lead), 2).alias("median_lead_time")] if whole(df, S.LEAD_TIME) else []),
        F.min(lead).alias("min_lead_time"),
        F.max(lead).alias("max_lead_time"),
        F.coalesce(rintn(delay_mean(S.DELAY_FLAG) * 100.0, 2), F.lit(0.0)).alias("delay_rate_pct"),
        F.count_if(F.col(S.DELAY_FLAG)).alias("total_delayed"),
    ).withColumn("on_time_rate_pct", rintn(F.lit(100.0) - F.col("delay_rate_pct"), 2))
    orders = df.agg(F.count_distinct(S.ORDER_ID).alias("total_orders"))
    states = df.agg(F.count_distinct(S.STATE).alias("unique_states"))
    if not whole(df, S.LEAD_TIME):
        main = main.crossJoin(exact_median(df, S.LEAD_TIME, "__med")).withColumn("median_lead_time", rintn("__med", 2)).drop("__med")
    route = S.STATE_ROUTE if S.STATE_ROUTE in df.columns else None
    route_expr = F.col(route) if route else F.concat(F.col(S.FACTORY), F.lit(S.ROUTE_ARROW), F.col(S.STATE))
    routes = df.agg(F.count_distinct(route_expr).alias("unique_routes"))
    return main.crossJoin(orders).crossJoin(states).crossJoin(routes)


def factory_performance(df: DataFrame) -> DataFrame:
    lead = F.col(S.LEAD_TIME)
    median, complete = group_median(df, [S.FACTORY], S.LEAD_TIME, "__med")
    agg = (df.filter(F.col(S.FACTORY).isNotNull()).groupBy(S.FACTORY)
             .agg(F.count(S.ROW_ID).alias("shipments"),
                  money_total(S.SALES).alias("total_sales"),
                  money_total(S.GROSS_PROFIT).alias("total_profit"),
                  F.sum(S.UNITS).cast("long").alias("total_units"),
                  rintn(F.avg(lead), 2).alias("avg_lead_time"),
                  *median,
                  delay_mean(S.DELAY_FLAG).alias("delay_rate"),
                  rintn(F.avg(S.SCORE), 4).alias("avg_efficiency_score"),
                  margin_pct(F.sum(S.GROSS_PROFIT), F.sum(S.SALES)).alias("profit_margin_pct")))
    return (complete(agg).withColumn("median_lead_time", rintn("__med", 2)).drop("__med")
               .withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2))
               .orderBy(F.col("shipments").desc(), F.col(S.FACTORY)))


def route_performance(df: DataFrame, route_col: str = S.STATE_ROUTE) -> DataFrame:
    lead = F.col(S.LEAD_TIME)
    median, complete = group_median(df, {route_col: "route"}, S.LEAD_TIME, "__med")
    agg = (df.filter(F.col(route_col).isNotNull()).groupBy(F.col(route_col).alias("route"))
             .agg(F.count(S.ROW_ID).alias("shipments"),
                  money_total(S.SALES).alias("total_sales"),
                  money_total(S.GROSS_PROFIT).alias("total_profit"),
                  F.avg(lead).alias("__avg"), *median, F.stddev_samp(lead).alias("__std"),
                  F.min(lead).alias("min_lead_time"), F.max(lead).alias("max_lead_time"),
                  delay_mean(S.DELAY_FLAG).alias("delay_rate"),
                  F.avg(S.SCORE).alias("__score")))
    cv = F.coalesce(F.try_divide(F.col("__std"), F.col("__avg")), F.lit(0.0))
    out = complete(agg).select("route", "shipments", "total_sales", "total_profit",
                     rintn("__avg", 2).alias("avg_lead_time"), rintn("__med", 2).alias("median_lead_time"),
                     rintn("__std", 2).alias("std_lead_time"), "min_lead_time", "max_lead_time", "delay_rate",
                     rintn(F.col("delay_rate") * 100.0, 2).alias("delay_rate_pct"),
                     rintn(cv, 4).alias("lead_time_cv"), rintn("__score", 2).alias("avg_efficiency_score"))
    w = Window.orderBy(F.col("avg_efficiency_score").desc_nulls_last())
    return (out.withColumn("rank", F.when(F.col("avg_efficiency_score").isNotNull(), F.rank().over(w)))
               .orderBy(F.col("avg_efficiency_score").desc_nulls_last(), "route"))


def with_mode_order(agg: DataFrame, mode_order: DataFrame) -> DataFrame:
    """Attach the speed rank of each mode (unknown → 99) and sort by it."""
    dim = mode_order.select(F.col(S.SHIP_MODE).alias("__m"), F.col("mode_order").alias("__o"))
    out = agg.join(dim, F.col(S.SHIP_MODE) == F.col("__m"), "left")
    return (out.withColumn("mode_order", F.coalesce(F.col("__o"), F.lit(99))).drop("__m", "__o")
               .orderBy("mode_order", S.SHIP_MODE))


def ship_mode_performance(df: DataFrame, mode_order: DataFrame) -> DataFrame:
    lead = F.col(S.LEAD_TIME)
    median, complete = group_median(df, [S.SHIP_MODE], S.LEAD_TIME, "median_lead_time")
    agg = (df.filter(F.col(S.SHIP_MODE).isNotNull()).groupBy(S.SHIP_MODE)
             .agg(F.count(S.ROW_ID).alias("shipments"),
                  money_total(S.SALES).alias("total_sales"),
                  money_total(S.GROSS_PROFIT).alias("total_profit"),
                  F.sum(S.UNITS).cast("long").alias("total_units"),
                  rintn(F.avg(lead), 2).alias("avg_lead_time"),
                  *median,
                  delay_mean(S.DELAY_FLAG).alias("delay_rate"),
                  money_mean(S.COST).alias("avg_cost")))
    agg = (complete(agg).withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2))
              .withColumn("profit_per_shipment", rintn(F.col("total_profit") / F.col("shipments"), 2)))
    return with_mode_order(agg, mode_order)


def monthly_trend(df: DataFrame) -> DataFrame:
    keys = ["ship_year", "ship_month", "ship_month_name"]
    agg = (df.filter(F.col("ship_year").isNotNull()).groupBy(*keys)
             .agg(F.count(S.ROW_ID).alias("shipments"),
                  money_total(S.SALES).alias("sales"),
                  money_total(S.GROSS_PROFIT).alias("profit"),
                  rintn(F.avg(S.LEAD_TIME), 2).alias("avg_lead_time"),
                  delay_mean(S.DELAY_FLAG).alias("delay_rate")))
    return agg.withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2)).orderBy("ship_year", "ship_month")


_METRICS = {"sales", "profit", "units", "shipments"}


def product_totals(df: DataFrame) -> DataFrame:
    return (df.filter(F.col(S.PRODUCT_NAME).isNotNull() & F.col(S.FACTORY).isNotNull())
              .groupBy(S.PRODUCT_NAME, S.FACTORY)
              .agg(F.count(S.ROW_ID).alias("shipments"), money_total(S.SALES).alias("sales"),
                   money_total(S.GROSS_PROFIT).alias("profit"), F.sum(S.UNITS).cast("long").alias("units")))


def top_products(df: DataFrame, n: int = 10, metric: str = "sales") -> DataFrame:
    if metric not in _METRICS:
        raise ValueError(f"metric must be one of {sorted(_METRICS)}")
    return product_totals(df).orderBy(F.col(metric).desc(), S.PRODUCT_NAME, S.FACTORY).limit(n)


def bottom_products(df: DataFrame, n: int = 10, metric: str = "sales") -> DataFrame:
    if metric not in _METRICS:
        raise ValueError(f"metric must be one of {sorted(_METRICS)}")
    return product_totals(df).orderBy(F.col(metric).asc(), S.PRODUCT_NAME, S.FACTORY).limit(n)
