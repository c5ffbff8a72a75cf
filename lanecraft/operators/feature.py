"""Feature operators: factory lookup, coordinates, lead time, delay flag,
route ids, calendar parts and the route efficiency score.

Two dialects exist (see the build notes): the *batch* features (integer
lead days, median delay policy, null coordinates for unknown factories) and
the *recalculation* features (fractional lead clipped at 0.5 days, SLA/auto
policy, default coordinates, score rounded to 4 places with null → 0.5).

Aggregate-then-join-back steps (per-mode median, per-route score) aggregate
with map-side partial aggregation, then join the small written result back by
its size — never a window partitioned by a low-cardinality key, which would
put a whole mode into one task.  :func:`add_delay_and_score` takes medians,
policy and scores from one (route, mode, lead) histogram, in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import rintn, slug
from lanecraft.functions.quantiles import exact_median
from lanecraft.plans.materialize import join_back, materialize


# ── factory & coordinates ────────────────────────────────────────────────────

def add_factory(df: DataFrame, factory_dim: DataFrame, key: str = S.PRODUCT_ID,
                default: str = S.UNKNOWN_FACTORY) -> DataFrame:
    """Left lookup ``key → factory``; unmatched (or null key) → ``default``.

    The dimension grows with the product table, so it is joined without a
    broadcast hint: Spark broadcasts it when its estimated size is under the
    threshold and shuffle-joins it otherwise.
    """
    dim = factory_dim.select(F.col(key).alias("__fk"), F.col(S.FACTORY).alias("__factory"))
    out = df.drop(S.FACTORY).join(dim, F.col(key) == F.col("__fk"), "left")
    return out.withColumn(S.FACTORY, F.coalesce(F.col("__factory"), F.lit(default))).drop("__fk", "__factory")


def factory_distribution(df: DataFrame) -> DataFrame:
    """Rows per factory (the distribution the reference logs)."""
    return df.groupBy(S.FACTORY).agg(F.count(F.lit(1)).alias("shipments"))


def add_factory_coords(df: DataFrame, coords_dim: DataFrame, default: tuple | None = None) -> DataFrame:
    """factory → (lat, lon).  ``default`` fills unknown factories (recalc dialect).

    ``coords_dim`` comes from configuration, one row per factory; Spark sizes the join.
    """
    dim = coords_dim.select(F.col(S.FACTORY).alias("__f"), F.col(S.FACTORY_LAT).alias("__lat"),
                            F.col(S.FACTORY_LON).alias("__lon"))
    out = df.drop(S.FACTORY_LAT, S.FACTORY_LON).join(dim, F.col(S.FACTORY) == F.col("__f"), "left")
    lat, lon = F.col("__lat"), F.col("__lon")
    if default is not None:
        lat, lon = F.coalesce(lat, F.lit(float(default[0]))), F.coalesce(lon, F.lit(float(default[1])))
    return out.withColumn(S.FACTORY_LAT, lat).withColumn(S.FACTORY_LON, lon).drop("__f", "__lat", "__lon")


# ── lead time ────────────────────────────────────────────────────────────────

def lead_days(order_col=S.ORDER_DATE, ship_col=S.SHIP_DATE) -> Column:
    return F.datediff(F.col(ship_col), F.col(order_col))


def add_lead_days(df: DataFrame) -> DataFrame:
    """Integer days ship − order (batch dialect)."""
    return df.withColumn(S.LEAD_TIME, lead_days())


def add_lead_days_clipped(df: DataFrame, floor: float = S.MIN_LEAD_DAYS) -> DataFrame:
    """Fractional days, floored at 0.5, rounded to 2 places (recalc dialect).

    A null date keeps a null lead (``greatest`` would otherwise skip it)."""
    # time-zone free: both ends as timestamp_ntz
    secs = F.timestamp_diff("SECOND", F.col(S.ORDER_DATE).cast("timestamp_ntz"), F.col(S.SHIP_DATE).cast("timestamp_ntz"))
    days = secs.cast("double") / 86400.0
    clipped = F.when(days.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(days, F.lit(floor)))
    return df.withColumn(S.LEAD_TIME, rintn(clipped, 2))


def lead_stats(df: DataFrame) -> DataFrame:
    """min / median / max lead (what the batch step logs), one row."""
    return df.agg(F.min(S.LEAD_TIME).alias("min_lead_time"), F.median(S.LEAD_TIME).alias("median_lead_time"),
                  F.max(S.LEAD_TIME).alias("max_lead_time"))


# ── delay flag ───────────────────────────────────────────────────────────────

def mode_medians(df: DataFrame) -> DataFrame:
    """Exact median lead per ship mode (null modes excluded, as pandas does)."""
    return (df.filter(F.col(S.SHIP_MODE).isNotNull())
              .groupBy(S.SHIP_MODE).agg(F.median(S.LEAD_TIME).alias("mode_median")))


def add_delay_flag_median(df: DataFrame) -> DataFrame:
    """Delayed iff lead > median lead of its mode; unseen mode / null lead → False."""
    med = mode_medians(df).withColumnRenamed(S.SHIP_MODE, "__mode")
    out = join_back(df.drop(S.DELAY_FLAG), med, F.col(S.SHIP_MODE) == F.col("__mode"), "left", "mode_medians")
    flag = F.coalesce(F.col(S.LEAD_TIME) > F.col("mode_median"), F.lit(False))
    return out.withColumn(S.DELAY_FLAG, flag).drop("__mode", "mode_median")


def add_delay_flag_sla(df: DataFrame, sla_dim: DataFrame, default_days: float = S.DEFAULT_SLA_DAYS) -> DataFrame:
    """Delayed iff lead > SLA days of its mode (unknown mode → ``default_days``).

    ``sla_dim`` (ship_mode, sla_days) comes from configuration, one row per mode."""
    dim = sla_dim.select(F.col(S.SHIP_MODE).alias("__mode"), F.col("sla_days").alias("__sla"))
    out = df.drop(S.DELAY_FLAG).join(dim, F.col(S.SHIP_MODE) == F.col("__mode"), "left")
    thr = F.coalesce(F.col("__sla"), F.lit(float(default_days)))
    return out.withColumn(S.DELAY_FLAG, F.coalesce(F.col(S.LEAD_TIME) > thr, F.lit(False))).drop("__mode", "__sla")


def choose_policy(df: DataFrame, switch_days: float = S.AUTO_POLICY_MEDIAN_DAYS) -> str:
    """'median' when the global median lead exceeds ``switch_days``, else 'sla'.

    One small action: the exact median (distributed, see
    :mod:`lanecraft.functions.quantiles`) is a single row."""
    m = exact_median(df, S.LEAD_TIME, "__gmed").first()["__gmed"]
    return "median" if (m if m is not None else 0.0) > switch_days else "sla"


def add_delay_flag_auto(df: DataFrame, sla_dim: DataFrame, switch_days: float = S.AUTO_POLICY_MEDIAN_DAYS,
                        default_days: float = S.DEFAULT_SLA_DAYS) -> DataFrame:
    """Global median lead > ``switch_days`` → median policy, else SLA policy.

    The policy is decided once on the 1-row global median, so the plan
    carries only the chosen branch."""
    if choose_policy(df, switch_days) == "median":
        return add_delay_flag_median(df)
    return add_delay_flag_sla(df, sla_dim, default_days)


# ── routes & calendar ────────────────────────────────────────────────────────

def add_route_ids(df: DataFrame) -> DataFrame:
    """``factory → state``, ``factory → region`` and a URL-safe slug id."""
    arrow = F.lit(S.ROUTE_ARROW)
    return (df.withColumn(S.STATE_ROUTE, F.concat(F.col(S.FACTORY), arrow, F.col(S.STATE)))
              .withColumn(S.REGION_ROUTE, F.concat(F.col(S.FACTORY), arrow, F.col(S.REGION)))
              .withColumn(S.ROUTE_ID, F.concat(slug(S.FACTORY), F.lit("_to_"), slug(S.STATE))))


def add_temporal(df: DataFrame, day_name: bool = False) -> DataFrame:
    """Calendar parts of ship and order date (ISO week, Monday = 0)."""
    sd, od = F.col(S.SHIP_DATE), F.col(S.ORDER_DATE)
    cols = {
        "ship_year": F.year(sd), "ship_month": F.month(sd), "ship_month_name": F.date_format(sd, "MMM"),
        "ship_quarter": F.quarter(sd), "ship_week": F.weekofyear(sd), "ship_day": F.dayofmonth(sd),
        "ship_dow": F.weekday(sd),
        "order_year": F.year(od), "order_month": F.month(od), "order_month_name": F.date_format(od, "MMM"),
        "order_day": F.dayofmonth(od), "order_dow": F.weekday(od),
    }
    if day_name:
        cols["ship_day_name"] = F.date_format(sd, "EEEE")
    return df.withColumns(cols)


# ── efficiency score ─────────────────────────────────────────────────────────

def efficiency_score(delay_rate, norm_lead, delay_weight=S.DELAY_WEIGHT, lead_weight=S.LEAD_TIME_WEIGHT) -> Column:
    """clip(1 − (w_d·delay + w_l·norm_lead), 0, 1); null stays null."""
    raw = F.lit(1.0) - (F.lit(float(delay_weight)) * delay_rate + F.lit(float(lead_weight)) * norm_lead)
    return F.when(raw.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def route_scores(df: DataFrame, route_col: str = S.STATE_ROUTE, delay_weight=S.DELAY_WEIGHT,
                 lead_weight=S.LEAD_TIME_WEIGHT) -> DataFrame:
    """Per-route delay rate, mean lead, min-max normalised lead and score.

    Runs on the aggregated (one row per route) table: the global min/max is
    a 1-row aggregate crossed in, never a window over the fact."""
    stats = (df.filter(F.col(route_col).isNotNull())
               .groupBy(route_col)
               .agg(F.avg(F.col(S.DELAY_FLAG).cast("int")).alias("delay_rate"),
                    F.avg(S.LEAD_TIME).alias("avg_lead_time")))
    return scored(stats, delay_weight, lead_weight)


def scored(stats: DataFrame, delay_weight=S.DELAY_WEIGHT, lead_weight=S.LEAD_TIME_WEIGHT) -> DataFrame:
    """Adds the normalised lead and the score to per-route statistics."""
    mm = stats.agg(F.min("avg_lead_time").alias("__lo"), F.max("avg_lead_time").alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    norm = F.when(span > 0, (F.col("avg_lead_time") - F.col("__lo")) / span).otherwise(
        F.when(F.col("avg_lead_time").isNotNull(), F.lit(0.0)))
    return (stats.crossJoin(mm).withColumn("norm_lead_time", norm)
                 .withColumn(S.SCORE, efficiency_score(F.col("delay_rate"), F.col("norm_lead_time"),
                                                       delay_weight, lead_weight))
                 .drop("__lo", "__hi"))


def add_efficiency(df: DataFrame, route_col: str = S.STATE_ROUTE, delay_weight=S.DELAY_WEIGHT,
                   lead_weight=S.LEAD_TIME_WEIGHT, fill: float | None = None, digits: int | None = None) -> DataFrame:
    """Join the per-route score back onto every row.

    Batch dialect: ``fill=None, digits=None``.  Recalc dialect: ``fill=0.5,
    digits=4``."""
    scores = route_scores(df, route_col, delay_weight, lead_weight).select(
        F.col(route_col).alias("__route"), F.col(S.SCORE).alias("__score"))
    out = join_back(df.drop(S.SCORE), scores, F.col(route_col) == F.col("__route"), "left", "route_scores")
    return out.withColumn(S.SCORE, finished(F.col("__score"), fill, digits)).drop("__route", "__score")


def finished(score: Column, fill: float | None, digits: int | None) -> Column:
    if fill is not None:
        score = F.coalesce(score, F.lit(float(fill)))
    return rintn(score, digits) if digits is not None else score


# ── delay flag and score in one pass over the fact ───────────────────────────

def lead_histogram(df: DataFrame, route_col: str = S.STATE_ROUTE) -> DataFrame:
    """Rows per (route, mode, lead): all that medians, policy and route scores need."""
    return df.groupBy(route_col, S.SHIP_MODE, S.LEAD_TIME).agg(F.count(F.lit(1)).alias("n"))


def add_delay_and_score(df: DataFrame, policy: str = "median", sla_dim: DataFrame | None = None, route_col: str = S.STATE_ROUTE,
                        switch_days: float = S.AUTO_POLICY_MEDIAN_DAYS, default_days: float = S.DEFAULT_SLA_DAYS,
                        delay_weight=S.DELAY_WEIGHT, lead_weight=S.LEAD_TIME_WEIGHT, fill: float | None = None,
                        digits: int | None = None, histogram: DataFrame | None = None) -> DataFrame:
    """Delay flag under ``policy`` (median, sla, auto) and route score.

    Same result as the single operators above, but the fact is read once for
    the histogram and once for the rows; with a written ``histogram`` (see
    ``lead_histogram``) only for the rows."""
    if policy not in ("median", "sla", "auto"):
        raise ValueError(f"unknown delay policy {policy!r}")
    h = histogram if histogram is not None else materialize(lead_histogram(df, route_col), "lead-histogram")
    if policy == "auto":
        # few distinct leads (days): the histogram itself is the value table
        m = h.agg(F.percentile(S.LEAD_TIME, 0.5, F.col("n")).alias("m")).first()["m"]
        policy = "median" if (m if m is not None else 0.0) > switch_days else "sla"
    if policy == "median":
        limits = h.filter(F.col(S.SHIP_MODE).isNotNull()).groupBy(F.col(S.SHIP_MODE).alias("__mode")).agg(
            F.percentile(S.LEAD_TIME, 0.5, F.col("n")).alias("__limit"))
        limit = F.col("__limit")
    else:
        limits = sla_dim.select(F.col(S.SHIP_MODE).alias("__mode"), F.col("sla_days").alias("__limit"))
        limit = F.coalesce(F.col("__limit"), F.lit(float(default_days)))
    limits = materialize(limits, "delay-limits")
    flag = F.coalesce(F.col(S.LEAD_TIME) > limit, F.lit(False))
    flagged = lambda x: x.join(limits, F.col(S.SHIP_MODE) == F.col("__mode"), "left").withColumn(S.DELAY_FLAG, flag).drop("__mode", "__limit")
    n = F.col("n")
    stats = flagged(h).filter(F.col(route_col).isNotNull()).groupBy(route_col).agg(
        (F.sum(F.col(S.DELAY_FLAG).cast("int") * n) / F.sum(n)).alias("delay_rate"),
        F.try_divide(F.sum(F.col(S.LEAD_TIME) * n), F.sum(F.when(F.col(S.LEAD_TIME).isNotNull(), n))).alias("avg_lead_time"))
    scores = scored(stats, delay_weight, lead_weight).select(F.col(route_col).alias("__route"), F.col(S.SCORE).alias("__score"))
    out = join_back(flagged(df.drop(S.DELAY_FLAG, S.SCORE)), scores, F.col(route_col) == F.col("__route"), "left", "route-scores")
    return out.withColumn(S.SCORE, finished(F.col("__score"), fill, digits)).drop("__route", "__score")
