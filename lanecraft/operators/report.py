"""Report aggregates drawn on the dashboard pages: splits, period labels,
health index and gauge bands, worst state / mode, profit waterfall, factory
drill-downs, customer and product analysis (ABC), tree-map roll-up, order
views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import band, delay_mean, margin_pct, rintn
from lanecraft.functions.windows import running_total
from lanecraft.operators import route as R


def _share(df: DataFrame, col: str) -> DataFrame:
    # window over the aggregated (one row per category) table
    return df.withColumn(f"{col}_share_pct", rintn(F.col(col) / F.sum(col).over(Window.partitionBy()) * 100.0, 2))


def division_split(df: DataFrame) -> DataFrame:
    g = (df.filter(F.col(S.DIVISION).isNotNull()).groupBy(S.DIVISION)
           .agg(F.count(S.ROW_ID).alias("shipments"), F.sum(S.SALES).cast("double").alias("sales")))
    return _share(g, "shipments")


def region_split(df: DataFrame) -> DataFrame:
    g = df.filter(F.col(S.REGION).isNotNull()).groupBy(S.REGION).agg(F.count(S.ROW_ID).alias("shipments"))
    return _share(g, "shipments")


def period_label(df: DataFrame, year_col: str = "ship_year", month_col: str = "ship_month") -> DataFrame:
    """``yyyy-MM`` label from year and month columns."""
    return df.withColumn("period", F.concat(F.col(year_col).cast("string"), F.lit("-"),
                                            F.lpad(F.col(month_col).cast("string"), 2, "0")))


def health_index(kpis: DataFrame) -> DataFrame:
    """clamp(trunc(100 − 0.6·delay % + 0.2·margin %), 0, 100) and its band (75 / 50)."""
    raw = (F.lit(100.0) - F.col("delay_rate_pct") * 0.6 + F.col("profit_margin_pct") * 0.2).cast("int")
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    return (kpis.select(score.alias("health_score"))
                .withColumn("health_band", band("health_score", 75, 50)))


def gauge_band(df: DataFrame, col: str, good: float = 70.0, warn: float = 40.0) -> DataFrame:
    return df.withColumn("gauge_band", band(col, good, warn))


def worst_state_mode(df: DataFrame) -> DataFrame:
    """State and ship mode with the highest mean delay % (ties → alphabetical)."""
    st = (df.filter(F.col(S.STATE).isNotNull()).groupBy(S.STATE)
            .agg((delay_mean(S.DELAY_FLAG) * 100.0).alias("p")))
    md = (df.filter(F.col(S.SHIP_MODE).isNotNull()).groupBy(S.SHIP_MODE)
            .agg((delay_mean(S.DELAY_FLAG) * 100.0).alias("p")))
    a = st.agg(F.min_by(S.STATE, F.struct(-F.col("p"), F.col(S.STATE))).alias("worst_state"),
               rintn(F.max("p"), 2).alias("worst_state_pct"))
    b = md.agg(F.min_by(S.SHIP_MODE, F.struct(-F.col("p"), F.col(S.SHIP_MODE))).alias("highest_delay_mode"),
               rintn(F.max("p"), 2).alias("mode_delay_pct"))
    return a.crossJoin(b)


def profit_waterfall(kpis: DataFrame, overhead_rate: float = 0.08) -> DataFrame:
    """Sales, −cost, −overhead (8 % of sales), retained margin, as 4 rows."""
    s, c = F.col("total_sales"), F.col("total_cost")
    oh = s * overhead_rate
    return kpis.select(F.explode(F.array(
        F.struct(F.lit(0).alias("step"), F.lit("Gross Revenue").alias("category"), s.alias("amount")),
        F.struct(F.lit(1).alias("step"), F.lit("COGS & Mfg Cost").alias("category"), (-c).alias("amount")),
        F.struct(F.lit(2).alias("step"), F.lit("Logistics Overhead").alias("category"), (-oh).alias("amount")),
        F.struct(F.lit(3).alias("step"), F.lit("Net Retained Margin").alias("category"),
                 (s - c - oh).alias("amount")))).alias("w")).select("w.*")


def best_worst_factory(factory_perf: DataFrame) -> DataFrame:
    """Factory with the max and min average score (ties → most shipments, then name)."""
    return factory_perf.agg(
        F.min_by(S.FACTORY, F.struct(-F.col("avg_efficiency_score"), -F.col("shipments"), F.col(S.FACTORY))).alias("best_factory"),
        F.max("avg_efficiency_score").alias("best_score"),
        F.min_by(S.FACTORY, F.struct(F.col("avg_efficiency_score"), -F.col("shipments"), F.col(S.FACTORY))).alias("worst_factory"),
        F.min("avg_efficiency_score").alias("worst_score"))


def factory_deep_dive(df: DataFrame, factory: str) -> DataFrame:
    f = df.filter(F.col(S.FACTORY) == factory)
    return f.agg(F.lit(factory).alias(S.FACTORY), F.count(F.lit(1)).alias("shipments"),
                 rintn(F.avg(S.LEAD_TIME), 2).alias("avg_lead_time"),
                 rintn(delay_mean(S.DELAY_FLAG) * 100.0, 2).alias("delay_rate_pct"))


def factory_product_mix(df: DataFrame, factory: str) -> DataFrame:
    return (df.filter((F.col(S.FACTORY) == factory) & F.col(S.PRODUCT_NAME).isNotNull()).groupBy(S.PRODUCT_NAME)
              .agg(F.count(S.ROW_ID).alias("shipments"), F.sum(S.SALES).cast("double").alias("sales")))


def factory_routes(df: DataFrame, factory: str, n: int = 10) -> DataFrame:
    return R.top_routes(R.route_summary(df.filter(F.col(S.FACTORY) == factory), "state"), n)


def factory_catalog(name_dim: DataFrame) -> DataFrame:
    """Factory → products, long form (factory, product_name), distinct."""
    return name_dim.select(S.FACTORY, S.PRODUCT_NAME).filter(F.col(S.FACTORY).isNotNull()).distinct()


# ── customers ────────────────────────────────────────────────────────────────

def customer_summary(df: DataFrame) -> DataFrame:
    g = (df.filter(F.col(S.CUSTOMER_ID).isNotNull()).groupBy(S.CUSTOMER_ID)
           .agg(F.count_distinct(S.ORDER_ID).alias("orders"),
                F.sum(S.SALES).alias("__s"), F.sum(S.GROSS_PROFIT).alias("__p"),
                F.avg(S.LEAD_TIME).alias("avg_lead_time"),
                F.count_if(F.col(S.DELAY_FLAG)).alias("delays")))
    return (g.withColumn("total_sales", F.col("__s").cast("double"))
             .withColumn("total_profit", F.col("__p").cast("double"))
             .withColumn("margin_pct", F.coalesce(F.try_divide(F.col("total_profit"), F.col("total_sales")) * 100.0,
                                                  F.lit(0.0)))
             .withColumn("repeat_buyer", F.col("orders") > 1))


def customer_cards(cust: DataFrame, top: int = 10) -> DataFrame:
    """Customers, repeat buyers, repeat %, mean revenue, top-10 share of sales.

    The top-10 is a distributed top-k (``orderBy.limit``), not a window."""
    a = cust.agg(F.count(F.lit(1)).alias("customers"), F.count_if("repeat_buyer").alias("repeat_customers"),
                 F.sum("__s").alias("__tot"))
    topk = cust.orderBy(F.col("__s").desc(), S.CUSTOMER_ID).limit(top).agg(F.sum("__s").alias("__top"))
    return (a.crossJoin(topk).select(
        "customers", "repeat_customers",
        F.coalesce(rintn(F.try_divide(F.col("repeat_customers"), F.col("customers")) * 100.0, 2), F.lit(0.0)).alias("repeat_pct"),
        F.coalesce(rintn(F.col("__tot").cast("double") / F.col("customers"), 2), F.lit(0.0)).alias("avg_revenue_per_customer"),
        rintn(F.try_divide(F.col("__top").cast("double"), F.col("__tot").cast("double")) * 100.0, 2).alias("top10_share_pct")))


def top_customers(cust: DataFrame, n: int = 10) -> DataFrame:
    return (cust.orderBy(F.col("__s").desc(), S.CUSTOMER_ID).limit(n)
                .select(S.CUSTOMER_ID, "orders", "total_sales", "total_profit", "margin_pct", "avg_lead_time",
                        "delays", "repeat_buyer"))


# ── products ─────────────────────────────────────────────────────────────────

def product_detail(df: DataFrame) -> DataFrame:
    keys = [S.PRODUCT_NAME, S.DIVISION, S.FACTORY]
    cond = F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull() & F.col(keys[2]).isNotNull()
    return (df.filter(cond).groupBy(*keys)
              .agg(F.sum(S.SALES).cast("double").alias("total_sales"),
                   F.sum(S.GROSS_PROFIT).cast("double").alias("total_profit"),
                   F.sum(S.UNITS).cast("long").alias("units_sold"), F.count(S.ORDER_ID).alias("orders"),
                   F.avg(S.LEAD_TIME).alias("avg_lead_time")))


def product_summary(df: DataFrame) -> DataFrame:
    g = (df.filter(F.col(S.PRODUCT_NAME).isNotNull()).groupBy(S.PRODUCT_NAME)
           .agg(F.sum(S.SALES).alias("__s"), F.sum(S.GROSS_PROFIT).alias("__p"),
                F.sum(S.UNITS).cast("long").alias("units_sold"), F.count(S.ORDER_ID).alias("orders")))
    return (g.withColumn("total_sales", F.col("__s").cast("double"))
             .withColumn("total_profit", F.col("__p").cast("double"))
             .withColumn("margin_pct", rintn(F.try_divide(F.col("total_profit"), F.col("total_sales")) * 100.0, 1)))


ABC_LABELS = ("A (Core 70%)", "B (Secondary 20%)", "C (Long-Tail 10%)")


def product_abc(summary: DataFrame, a_cut: float = 70.0, b_cut: float = 90.0) -> DataFrame:
    """Running share of sales (largest first) → A ≤ 70 %, B ≤ 90 %, C ≤ 100 %.

    The running sum is exact (decimal) and distributed (see
    :func:`lanecraft.functions.windows.running_total`); the grand total is a
    1-row aggregate crossed in."""
    order = [F.col("__s").desc(), F.col(S.PRODUCT_NAME).asc()]
    rt = running_total(summary, order, "__s", "__cum")
    tot = summary.agg(F.sum("__s").alias("__tot"))
    cum_pct = F.least(F.col("__cum").cast("double") / F.col("__tot").cast("double") * 100.0, F.lit(100.0))
    cls = (F.when(cum_pct <= a_cut, ABC_LABELS[0]).when(cum_pct <= b_cut, ABC_LABELS[1])
            .when(cum_pct <= 100.0, ABC_LABELS[2]))
    return (rt.crossJoin(F.broadcast(tot))
              .withColumn("cum_sales", F.col("__cum").cast("double"))
              .withColumn("cum_pct", cum_pct)
              .withColumn("abc_class", cls)
              .drop("__s", "__p", "__cum", "__tot"))


def abc_counts(abc: DataFrame) -> DataFrame:
    return abc.groupBy(F.col("abc_class").alias("class")).agg(F.count(F.lit(1)).alias("count"))


def product_cards(summary: DataFrame, abc: DataFrame, df: DataFrame) -> DataFrame:
    a = summary.agg(F.count(F.lit(1)).alias("skus"),
                    F.min_by(S.PRODUCT_NAME, F.struct(-F.col("__s"), F.col(S.PRODUCT_NAME))).alias("top_sku"),
                    F.max("__s").cast("double").alias("top_sku_sales"))
    b = abc.agg(F.count_if(F.col("abc_class") == ABC_LABELS[0]).alias("a_items"))
    c = df.agg(rintn(F.try_divide(F.sum(S.GROSS_PROFIT).cast("double"), F.sum(S.SALES).cast("double")) * 100.0, 1)
               .alias("portfolio_margin_pct"))
    return a.crossJoin(b).crossJoin(c)


def treemap_rollup(df: DataFrame, top: str = S.DIVISION, leaf: str = S.PRODUCT_NAME,
                   value: str = S.SALES) -> DataFrame:
    """Σ value at every level of top → leaf, with percent of the parent node."""
    d = df.filter(F.col(top).isNotNull() & F.col(leaf).isNotNull())
    r = d.rollup(top, leaf).agg(F.sum(value).alias("__v"), F.grouping_id().alias("level_id"))
    parents = r.filter(F.col("level_id") == 1).select(F.col(top).alias("__pt"), F.col("__v").alias("__pv"))
    root = r.filter(F.col("level_id") == 3).select(F.col("__v").alias("__rv"))
    out = (r.join(parents, (F.col("level_id") == 0) & (F.col(top) == F.col("__pt")), "left")
            .crossJoin(F.broadcast(root)))
    parent_v = F.when(F.col("level_id") == 0, F.col("__pv")).when(F.col("level_id") == 1, F.col("__rv"))
    return out.select(
        top, leaf, F.when(F.col("level_id") == 0, "leaf").when(F.col("level_id") == 1, "branch")
        .otherwise("root").alias("level"),
        F.col("__v").cast("double").alias("value"), parent_v.cast("double").alias("parent_value"),
        rintn(F.try_divide(F.col("__v").cast("double"), parent_v.cast("double")) * 100.0, 4).alias("pct_of_parent"))


# ── orders page ──────────────────────────────────────────────────────────────

def order_year_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("order_year").isNotNull()).groupBy("order_year").agg(F.count(F.lit(1)).alias("rows"))


def order_strip(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records"), F.sum(S.SALES).cast("double").alias("sales"),
                  F.sum(S.GROSS_PROFIT).cast("double").alias("profit"),
                  rintn(F.avg(S.LEAD_TIME), 2).alias("avg_lead_time"),
                  rintn(delay_mean(S.DELAY_FLAG) * 100.0, 2).alias("delay_rate_pct"))


def order_display(df: DataFrame) -> DataFrame:
    """The 20-column orders table: ISO dates, status label, score 3 dp, ASCII arrow."""
    return df.select(
        S.ORDER_ID, F.date_format(S.ORDER_DATE, "yyyy-MM-dd").alias("order_date"),
        F.date_format(S.SHIP_DATE, "yyyy-MM-dd").alias("ship_date"), F.col("order_year").alias("year"),
        S.SHIP_MODE, S.CUSTOMER_ID, S.CITY, F.col(S.STATE).alias("state"), S.REGION, S.PRODUCT_NAME, S.FACTORY,
        S.DIVISION, F.col(S.SALES).cast("double").alias("sales"), S.UNITS,
        F.col(S.GROSS_PROFIT).cast("double").alias("profit"), F.col(S.COST).cast("double").alias("cost"),
        F.col(S.LEAD_TIME).alias("lead_days"),
        F.when(F.col(S.DELAY_FLAG), "Delayed").when(~F.col(S.DELAY_FLAG), "On Time").alias("status"),
        rintn(S.SCORE, 3).alias("efficiency"),
        F.replace(F.col(S.STATE_ROUTE), F.lit("→"), F.lit("->")).alias("route"))


def order_detail(df: DataFrame, order_id: int) -> DataFrame:
    """Line items of one order plus the order's total sales and profit."""
    o = df.filter(F.col(S.ORDER_ID) == order_id)
    tot = o.agg(F.sum(S.SALES).cast("double").alias("order_total_sales"),
                F.sum(S.GROSS_PROFIT).cast("double").alias("order_total_profit"))
    return (o.select(S.ROW_ID, S.ORDER_ID, S.PRODUCT_NAME, S.UNITS, F.col(S.SALES).cast("double").alias("sales"),
                     F.col(S.GROSS_PROFIT).cast("double").alias("gross_profit"),
                     F.col(S.COST).cast("double").alias("cost"))
             .crossJoin(F.broadcast(tot)))
