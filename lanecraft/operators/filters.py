"""Filters, search and facets.

``apply_filters`` turns one filter dict into one conjunctive predicate, so
Catalyst pushes the IN-lists and null checks into the Parquet scan.  It keeps
the reference's default semantics: a dimension absent from the dict defaults
to "all non-null values" — rows with a null there drop even when unfiltered —
and an absent lead range defaults to the int-truncated min/max of the full
table (a 1-row aggregate crossed in, never collected).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanecraft import schema as S
from lanecraft.functions.windows import running_total
from lanecraft.functions.exprs import rintn, search_predicate

DIMENSIONS = {
    "years": "ship_year", "factories": S.FACTORY, "regions": S.REGION, "states": S.STATE,
    "ship_modes": S.SHIP_MODE, "divisions": S.DIVISION,
}
SEARCH_COLUMNS = [S.ORDER_ID, S.PRODUCT_NAME, S.CITY, S.CUSTOMER_ID]
ALL_MONTHS = list(range(1, 13))


def dimension_predicate(filters: dict) -> Column:
    """Everything except the default lead range, as one Column."""
    cond = F.lit(True)
    text = filters.get("search_text")
    if text:
        cond = cond & search_predicate(SEARCH_COLUMNS, text)
    for key, col in DIMENSIONS.items():
        if key in filters:
            vals = filters[key]
            if vals:
                cond = cond & F.col(col).isin(list(vals))
        else:
            cond = cond & F.col(col).isNotNull()
    months = filters.get("months", ALL_MONTHS)
    if months:
        cond = cond & F.col("ship_month").isin(list(months))
    prods = filters.get("products") or []
    if prods:
        cond = cond & F.col(S.PRODUCT_NAME).isin(list(prods))
    rng = filters.get("lead_time_range")
    if rng:
        cond = cond & F.col(S.LEAD_TIME).between(rng[0], rng[1])
    if filters.get("delay_only"):
        cond = cond & (F.col(S.DELAY_FLAG) == F.lit(True))
    return cond


def lead_bounds(full: DataFrame) -> DataFrame:
    """Default lead range: int-truncated min and max of the full table (1 row)."""
    return full.agg(F.min(S.LEAD_TIME).cast("long").alias("__lo"), F.max(S.LEAD_TIME).cast("long").alias("__hi"))


def apply_filters(df: DataFrame, filters: dict, full: DataFrame | None = None) -> DataFrame:
    out = df.filter(dimension_predicate(filters))
    if "lead_time_range" not in filters:
        b = lead_bounds(full if full is not None else df)
        out = (out.crossJoin(F.broadcast(b))
                  .filter(F.col(S.LEAD_TIME).between(F.col("__lo"), F.col("__hi")))
                  .drop("__lo", "__hi"))
    return out


def preset_scopes(df: DataFrame, presets: dict[str, dict]) -> DataFrame:
    """Rows kept and sales per named preset: conditional aggregates in one scan."""
    rows = df.crossJoin(lead_bounds(df))
    default = F.col(S.LEAD_TIME).between(F.col("__lo"), F.col("__hi"))
    aggs = []
    for i, flt in enumerate(presets.values()):
        keep = dimension_predicate(flt)
        if "lead_time_range" not in flt:
            keep = keep & default
        aggs += [F.count_if(keep).alias(f"n{i}"), F.coalesce(F.sum(F.when(keep, F.col(S.SALES))).cast("double"), F.lit(0.0)).alias(f"s{i}")]
    cells = F.array(*[F.struct(F.lit(name).alias("preset"), F.lit(i).alias("preset_order"), F.col(f"n{i}").alias("rows_kept"), F.col(f"s{i}").alias("sales"))
                      for i, name in enumerate(presets)])
    return rows.agg(*aggs).select(F.inline(cells))


def active_filter_count(filters: dict, full: DataFrame) -> DataFrame:
    """How many dimensions are constrained below their full domain (1 row).

    Domain sizes come from one pre-aggregation over the distinct combinations
    of the listed dimensions (map-side combined), then distinct counts on
    that small table."""
    dims = [k for k in DIMENSIONS if filters.get(k)]
    terms = []
    if filters.get("search_text"):
        terms.append(F.lit(1))
    if dims:
        cols = [DIMENSIONS[k] for k in dims]
        combos = full.select(*cols).distinct()
        counts = combos.agg(*[F.count_distinct(F.col(DIMENSIONS[k])).alias(f"n_{k}") for k in dims])
    else:
        counts = full.sparkSession.range(1).select(F.lit(0).alias("__none"))
    for k in dims:
        terms.append(F.when(F.lit(len(set(filters[k]))) < F.col(f"n_{k}"), 1).otherwise(0))
    if filters.get("products"):
        terms.append(F.lit(1))
    if filters.get("delay_only"):
        terms.append(F.lit(1))
    rng = filters.get("lead_time_range")
    if rng:
        b = lead_bounds(full)
        counts = counts.crossJoin(b)
        terms.append(F.when((F.col("__lo") == F.lit(rng[0])) & (F.col("__hi") == F.lit(rng[1])), 0).otherwise(1))
    total = F.lit(0)
    for t in terms:
        total = total + t
    return counts.select(total.cast("int").alias("active_filters"))


def quick_stats(scope: DataFrame, full: DataFrame) -> DataFrame:
    s = scope.agg(F.count(F.lit(1)).alias("filtered_records"),
                  F.coalesce(F.sum(S.SALES).cast("double"), F.lit(0.0)).alias("total_sales"),
                  F.coalesce(rintn(F.avg(S.LEAD_TIME), 6), F.lit(0.0)).alias("avg_lead_time"),
                  F.coalesce((F.lit(1.0) - F.avg(F.col(S.DELAY_FLAG).cast("int"))) * 100.0,
                             F.lit(100.0)).alias("on_time_pct"))
    t = full.agg(F.count(F.lit(1)).alias("total_records"))
    return (s.crossJoin(t).withColumn(
        "pct_retained", F.coalesce(F.try_divide(F.col("filtered_records"), F.col("total_records")) * 100.0,
                                   F.lit(0.0))))


def facets(df: DataFrame, mode_order: DataFrame) -> DataFrame:
    """(facet, value, position): sorted distinct non-null values per
    dimension; ship modes in speed order.

    One scan unpivots the dimensions and keeps distinct values; positions come
    from a distributed running count, as a facet may have very many values."""
    spec = [("years", "ship_year"), ("factories", S.FACTORY), ("regions", S.REGION), ("states", S.STATE),
            ("divisions", S.DIVISION), ("products", S.PRODUCT_NAME), ("ship_modes", S.SHIP_MODE)]
    cells = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(col).cast("string").alias("value"),
                               (F.col(col) if col == "ship_year" else F.lit(None)).cast("long").alias("__num")) for name, col in spec])
    values = df.select(F.inline(cells)).filter(F.col("value").isNotNull()).distinct()
    order = mode_order.select(F.lit("ship_modes").alias("facet"), F.col(S.SHIP_MODE).alias("value"), "mode_order")
    ranked = values.join(order, ["facet", "value"], "left").select(
        "facet", "value", F.coalesce("__num", F.lit(0)).alias("__num"),
        F.when(F.col("facet") == "ship_modes", F.coalesce("mode_order", F.lit(99))).otherwise(0).alias("__ord"), F.lit(1).alias("__one"))
    run = running_total(ranked, [F.col("facet").asc(), F.col("__ord").asc(), F.col("__num").asc(), F.col("value").asc()], "__one", "__n")
    first = run.groupBy("facet").agg(F.min("__n").alias("__first"))
    return run.join(first, "facet").select("facet", "value", (F.col("__n") - F.col("__first")).cast("int").alias("position"))


def order_search(df: DataFrame, text: str = "", status: str = "All", year: int | None = None,
                 sort_by: str = S.SALES, ascending: bool = False) -> DataFrame:
    """Orders table: lower-case regex search over 6 columns, status, order year, sort."""
    out = df
    if year is not None:
        out = out.filter(F.col("order_year") == year)
    t = (text or "").strip().lower()
    if t:
        cols = [S.ORDER_ID, S.CUSTOMER_ID, S.CITY, S.STATE, S.PRODUCT_NAME, S.FACTORY]
        cond = None
        for c in cols:
            term = F.coalesce(F.lower(F.col(c).cast("string")).rlike(t), F.lit(False))
            cond = term if cond is None else cond | term
        out = out.filter(cond)
    if status == "Delayed Only":
        out = out.filter(F.col(S.DELAY_FLAG) == True)  # noqa: E712
    elif status == "On Time Only":
        out = out.filter(F.col(S.DELAY_FLAG) == False)  # noqa: E712
    return out.orderBy(F.col(sort_by).asc() if ascending else F.col(sort_by).desc(), S.ROW_ID)


def grid_filter(df: DataFrame, text: str = "", factory: str = "All", mode: str = "All",
                delay: str = "All") -> DataFrame:
    out = df
    t = (text or "").strip().lower()
    if t:
        cond = None
        for c in (S.ORDER_ID, S.PRODUCT_NAME, S.CITY):
            term = F.coalesce(F.lower(F.col(c).cast("string")).rlike(t), F.lit(False))
            cond = term if cond is None else cond | term
        out = out.filter(cond)
    if factory != "All":
        out = out.filter(F.col(S.FACTORY) == factory)
    if mode != "All":
        out = out.filter(F.col(S.SHIP_MODE) == mode)
    if delay == "Delayed Only (True)":
        out = out.filter(F.col(S.DELAY_FLAG) == True)  # noqa: E712
    elif delay == "On Time (False)":
        out = out.filter(F.col(S.DELAY_FLAG) == False)  # noqa: E712
    return out
