"""Geography: domestic scope, state / region performance, factory coverage,
density, bottleneck states, high-delay regions, route lines, map scope,
cards and Sankey links.

Per-factory distinct counts are computed from a pre-aggregate at the finest
key (factory, state, region), so the distinct step runs on the small
pre-aggregated table instead of expanding the fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanecraft import schema as S
from lanecraft.functions.windows import running_total
from lanecraft.functions.exprs import band, delay_mean, margin_pct, money_total, rintn
from lanecraft.functions.quantiles import group_median


def us_scope(df: DataFrame, allow: DataFrame) -> DataFrame:
    """Rows whose state is in the allow-list (left-semi join; the list is a
    dimension, joined without a hint so Spark sizes it)."""
    a = allow.select(F.col(allow.columns[0]).alias("__state"))
    return df.join(a, F.col(S.STATE) == F.col("__state"), "left_semi")


def state_performance(df: DataFrame, state_dim: DataFrame) -> DataFrame:
    lead = F.col(S.LEAD_TIME)
    median, complete = group_median(df, {S.STATE: "state"}, S.LEAD_TIME, "median_lead_time")
    agg = (df.filter(F.col(S.STATE).isNotNull()).groupBy(F.col(S.STATE).alias("state"))
             .agg(F.count(S.ROW_ID).alias("shipments"),
                  money_total(S.SALES).alias("total_sales"),
                  money_total(S.GROSS_PROFIT).alias("total_profit"),
                  F.sum(S.UNITS).cast("long").alias("total_units"),
                  rintn(F.avg(lead), 2).alias("avg_lead_time"),
                  *median,
                  delay_mean(S.DELAY_FLAG).alias("delay_rate"),
                  rintn(F.avg(S.SCORE), 4).alias("avg_efficiency_score"),
                  margin_pct(F.sum(S.GROSS_PROFIT), F.sum(S.SALES)).alias("profit_margin_pct")))
    dim = state_dim.select(F.col(S.STATE).alias("__s"), "state_abbrev", F.col("state_lat").alias("lat"),
                           F.col("state_lon").alias("lon"))
    return (complete(agg).withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2))
               .join(dim, F.col("state") == F.col("__s"), "left").drop("__s")
               .orderBy(F.col("shipments").desc(), "state"))


def region_performance(df: DataFrame) -> DataFrame:
    lead = F.col(S.LEAD_TIME)
    # pre-aggregate at (region, state): the distinct state count then runs on the small table
    pre = (df.filter(F.col(S.REGION).isNotNull()).groupBy(S.REGION, S.STATE)
             .agg(F.count(S.ROW_ID).alias("n"), F.sum(S.SALES).alias("s"), F.sum(S.GROSS_PROFIT).alias("p"),
                  F.sum(S.UNITS).alias("u"), F.sum(lead).alias("ls"), F.count(lead).alias("lc"),
                  F.count_if(F.col(S.DELAY_FLAG)).alias("dl"), F.count(S.DELAY_FLAG).alias("dc"),
                  F.sum(S.SCORE).alias("ss"), F.count(S.SCORE).alias("sc")))
    known = df.filter(F.col(S.REGION).isNotNull())
    median, complete = group_median(known, [S.REGION], S.LEAD_TIME, "median_lead_time")
    med = complete(known.groupBy(S.REGION).agg(F.count(F.lit(1)).alias("__rows"), *median)).drop("__rows")
    agg = (pre.groupBy(S.REGION)
              .agg(F.sum("n").alias("shipments"), F.sum("s").cast("double").alias("total_sales"),
                   F.sum("p").cast("double").alias("total_profit"), F.sum("u").cast("long").alias("total_units"),
                   rintn(F.sum("ls") / F.sum("lc"), 2).alias("avg_lead_time"),
                   (F.sum("dl") / F.sum("dc")).alias("delay_rate"),
                   F.count_distinct(S.STATE).alias("unique_states"),
                   rintn(F.sum("ss") / F.sum("sc"), 4).alias("avg_efficiency_score"),
                   margin_pct(F.sum("p"), F.sum("s")).alias("profit_margin_pct")))
    return (agg.join(med, S.REGION).withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2))
               .orderBy(F.col("shipments").desc(), S.REGION))


def factory_coverage(df: DataFrame, coords_dim: DataFrame) -> DataFrame:
    lead = F.col(S.LEAD_TIME)
    pre = (df.filter(F.col(S.FACTORY).isNotNull()).groupBy(S.FACTORY, S.STATE, S.REGION)
             .agg(F.count(S.ROW_ID).alias("n"), F.sum(S.SALES).alias("s"), F.sum(lead).alias("ls"),
                  F.count(lead).alias("lc"), F.count_if(F.col(S.DELAY_FLAG)).alias("dl"),
                  F.count(S.DELAY_FLAG).alias("dc")))
    agg = (pre.groupBy(S.FACTORY)
              .agg(F.sum("n").alias("shipments"), F.count_distinct(S.STATE).alias("states_served"),
                   F.count_distinct(S.REGION).alias("regions_served"),
                   F.sum("s").cast("double").alias("total_sales"),
                   rintn(F.sum("ls") / F.sum("lc"), 2).alias("avg_lead_time"),
                   (F.sum("dl") / F.sum("dc")).alias("delay_rate")))
    dim = coords_dim.select(F.col(S.FACTORY).alias("__f"), F.col(S.FACTORY_LAT).alias("lat"),
                            F.col(S.FACTORY_LON).alias("lon"))
    return (agg.withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2))
               .join(dim, F.col(S.FACTORY) == F.col("__f"), "left").drop("__f")
               .orderBy(F.col("shipments").desc(), S.FACTORY))


def shipping_density(state_perf: DataFrame, top_n: int = 20) -> DataFrame:
    return state_perf.orderBy(F.col("shipments").desc(), "state").limit(top_n)


def bottleneck_states(state_perf: DataFrame, delay_threshold: float = 50.0, min_shipments: int = 10) -> DataFrame:
    return (state_perf.filter((F.col("delay_rate_pct") >= delay_threshold) & (F.col("shipments") >= min_shipments))
                      .orderBy(F.col("delay_rate_pct").desc(), "state"))


def high_delay_regions(region_perf: DataFrame, delay_threshold: float = 45.0) -> DataFrame:
    return region_perf.filter(F.col("delay_rate_pct") >= delay_threshold).orderBy(F.col("delay_rate_pct").desc())


def route_lines(df: DataFrame, state_dim: DataFrame, min_shipments: int = 5) -> DataFrame:
    """One line per (factory, state) with both end coordinates.

    Null keys (e.g. unknown-factory coordinates) drop out of the grouping, and
    destinations without a centroid are dropped by the inner join."""
    keys = [S.FACTORY, S.STATE, S.FACTORY_LAT, S.FACTORY_LON]
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    agg = (df.filter(cond).groupBy(*keys)
             .agg(F.count(S.ROW_ID).alias("shipments"), rintn(F.avg(S.LEAD_TIME), 2).alias("avg_lead_time"),
                  delay_mean(S.DELAY_FLAG).alias("delay_rate"), rintn(F.avg(S.SCORE), 4).alias("avg_efficiency_score"))
             .filter(F.col("shipments") >= min_shipments)
             .withColumn("delay_rate_pct", rintn(F.col("delay_rate") * 100.0, 2)))
    dim = state_dim.select(F.col(S.STATE).alias("__s"), "state_lat", "state_lon").filter(
        F.col("state_lat").isNotNull() & F.col("state_lon").isNotNull())
    return agg.join(dim, F.col(S.STATE) == F.col("__s"), "inner").drop("__s")


def line_band(lines: DataFrame) -> DataFrame:
    """Line class by score (≥ 0.5 good) and opacity 0.3 + 0.5·s (good) or 0.3 + 0.5·(1 − s)."""
    s = F.coalesce(F.col("avg_efficiency_score"), F.lit(0.5))
    good = s >= 0.5
    return lines.select(S.FACTORY, S.STATE, "avg_efficiency_score",
                        F.when(good, "good").otherwise("bad").alias("line_class"),
                        rintn(F.when(good, 0.3 + s * 0.5).otherwise(0.3 + (1 - s) * 0.5), 4).alias("opacity"))


def map_scope(state_perf: DataFrame) -> DataFrame:
    return state_perf.filter(F.col("state_abbrev").isNotNull())


def geo_cards(state_perf: DataFrame, coverage: DataFrame) -> DataFrame:
    """#states, peak state volume, mean state delay %, peak factory reach,
    top-volume state and worst-delay state (ties → alphabetical)."""
    sp = state_perf.agg(
        F.count("state").alias("states"), F.max("shipments").alias("peak_state_volume"),
        rintn(F.avg("delay_rate_pct"), 2).alias("mean_state_delay_pct"),
        F.min_by("state", F.struct(-F.col("shipments"), F.col("state"))).alias("top_volume_state"),
        F.min_by("state", F.struct(-F.col("delay_rate_pct"), F.col("state"))).alias("worst_delay_state"))
    cov = coverage.agg(F.max("states_served").alias("peak_states_served"))
    return sp.crossJoin(cov)


def sankey_links(df: DataFrame, source_col: str = S.FACTORY, target_col: str = S.REGION,
                 value_col: str = S.SALES) -> DataFrame:
    """(source, target, value, source_id, target_id): grouped flows plus dense
    node ids over the union of both ends (sources first, in sorted order)."""
    g = (df.filter(F.col(source_col).isNotNull() & F.col(target_col).isNotNull())
           .groupBy(F.col(source_col).alias("source"), F.col(target_col).alias("target"))
           .agg(F.sum(value_col).cast("double").alias("value")))
    ends = (g.select(F.col("source").alias("node"), F.lit(0).alias("side"))
             .unionByName(g.select(F.col("target").alias("node"), F.lit(1).alias("side"))))
    first = ends.groupBy("node").agg(F.min("side").alias("side"))
    # the columns may be any: ids come from a distributed running count, not from one task
    nodes = running_total(first.withColumn("__one", F.lit(1)), [F.col("side").asc(), F.col("node").asc()], "__one", "__n") \
        .withColumn("node_id", (F.col("__n") - 1).cast("int"))
    src = nodes.select(F.col("node").alias("__sn"), F.col("node_id").alias("source_id"))
    tgt = nodes.select(F.col("node").alias("__tn"), F.col("node_id").alias("target_id"))
    return (g.join(src, F.col("source") == F.col("__sn")).join(tgt, F.col("target") == F.col("__tn"))
             .drop("__sn", "__tn"))
