"""Data-quality counts, score, rules and completeness; dataset health checks.

Every check is an aggregate over the table (one pass where possible); the
(order, product) duplicate count is Σ(n − 1) over a grouped count, which
partially aggregates map-side even when one key is very hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import literal_table, rintn
from lanecraft.functions.quantiles import exact_quantiles

CORE_COLUMNS = [S.ORDER_ID, S.ORDER_DATE, S.SHIP_DATE, S.SHIP_MODE, S.CUSTOMER_ID, S.COUNTRY, S.CITY, S.STATE,
                S.DIVISION, S.REGION, S.PRODUCT_ID, S.PRODUCT_NAME, S.SALES, S.UNITS, S.GROSS_PROFIT, S.COST]
DUP_KEYS = [S.ORDER_ID, S.PRODUCT_ID]


def _nulls_total(df: DataFrame):
    total = F.lit(0).cast("long")
    for c in df.columns:
        total = total + F.count_if(F.col(f"`{c}`").isNull())
    return total


def duplicate_count(df: DataFrame, keys=DUP_KEYS) -> DataFrame:
    """Rows beyond the first per key (nulls compare equal, as in pandas)."""
    keys = [k for k in keys if k in df.columns] or df.columns
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
              .agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def dq_counts(df: DataFrame) -> DataFrame:
    main = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        _nulls_total(df).alias("total_nulls"),
        F.count_if(F.col(S.LEAD_TIME) < 0).alias("negative_lead_time"),
        F.count_if(F.col(S.SHIP_DATE) < F.col(S.ORDER_DATE)).alias("invalid_dates"),
        F.count_if(F.col(S.FACTORY_LAT).isNull() | F.col(S.FACTORY_LON).isNull()).alias("missing_coords"))
    return main.crossJoin(duplicate_count(df))


def dq_score(counts: DataFrame) -> DataFrame:
    penalty = (F.col("total_nulls") * 0.1 + F.col("duplicate_rows") * 0.5 + F.col("negative_lead_time") * 2.0
               + F.col("invalid_dates") * 2.0 + F.col("missing_coords") * 1.0)
    return counts.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - penalty)))


def dq_rules(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Five audit rules, all computed: (rule, violations, status)."""
    bal = F.abs(F.col(S.SALES).cast("double") - F.col(S.COST).cast("double") - F.col(S.GROSS_PROFIT).cast("double"))
    counts = df.agg(
        F.count_if(F.col(S.SHIP_DATE) < F.col(S.ORDER_DATE)).alias("r0"),
        F.count_if(F.col(S.LEAD_TIME) < 0).alias("r1"),
        F.count_if(F.col(S.FACTORY_LAT).isNull() | F.col(S.FACTORY_LON).isNull()).alias("r2"),
        F.count_if(bal > tolerance).alias("r4"))
    # product → division integrity: products seen with a null or more than one division
    integ = (df.filter(F.col(S.PRODUCT_ID).isNotNull()).groupBy(S.PRODUCT_ID)
               .agg(F.count_distinct(S.DIVISION).alias("__d"), F.count_if(F.col(S.DIVISION).isNull()).alias("__n"))
               .agg(F.count_if((F.col("__d") != 1) | (F.col("__n") > 0)).alias("r3")))
    stacked = counts.crossJoin(integ).selectExpr(
        "stack(5, 'Order & Ship Date Chronology', r0, 'Non-Negative Transit Days', r1, "
        "'Factory Coordinate Mapping', r2, 'Division & Product Integrity', r3, "
        "'Financial Balance (Sales = Cost + Profit)', r4) as (rule, violations)")
    return stacked.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def dq_completeness(df: DataFrame) -> DataFrame:
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    long = agg.selectExpr("__rows", f"stack({len(cols)}, {stack}) as (`column`, missing_values)")
    return long.select("column", "missing_values",
                       rintn((F.lit(1.0) - F.col("missing_values") / F.col("__rows")) * 100.0, 2).alias("completeness_pct"))


# ── health checks: each returns one row (check, count, deduction, severity) ──

def _row(df: DataFrame, check: str, count, deduction, severity) -> DataFrame:
    return df.select(F.lit(check).alias("check"), count.cast("long").alias("count"),
                     deduction.cast("int").alias("deduction"), severity.alias("severity"))


def hl_schema(df: DataFrame, core=CORE_COLUMNS) -> DataFrame:
    missing = [c for c in core if c not in df.columns]
    spark = df.sparkSession
    return literal_table(spark, [("schema", len(missing), min(30, 8 * len(missing)) if missing else 0,
                                  "High" if missing else None, ",".join(missing))],
                         ["check", "count", "deduction", "severity", "missing_columns"],
                         ["string", "long", "int", "string", "string"])


def _nulls_row(a: DataFrame) -> DataFrame:
    n, rows = F.col("nulls"), F.col("rows")
    ded = F.when(n > 0, F.least(F.lit(20), (n / rows * 100.0).cast("int"))).otherwise(0)
    return _row(a, "nulls", n, ded, F.when(n > 0, F.when(n < rows * 0.05, "Medium").otherwise("High")))


def _flat_row(a: DataFrame, check: str, n, deduction: int) -> DataFrame:
    return _row(a, check, n, F.when(n > 0, deduction).otherwise(0), F.when(n > 0, F.lit("High")))


def _inversions():
    return F.count_if(F.col(S.SHIP_DATE) < F.col(S.ORDER_DATE)).alias("inv")


def _nonpositive():
    return F.count_if(F.col(S.LEAD_TIME) <= 0).alias("nonpos")


def hl_nulls(df: DataFrame) -> DataFrame:
    return _nulls_row(df.agg(_nulls_total(df).alias("nulls"), F.count(F.lit(1)).alias("rows")))


def hl_duplicates(df: DataFrame) -> DataFrame:
    a = duplicate_count(df).crossJoin(df.agg(F.count(F.lit(1)).alias("rows")))
    d, rows = F.col("duplicate_rows"), F.col("rows")
    ded = F.when(d > 0, F.least(F.lit(15), (d / rows * 100.0).cast("int") + 5)).otherwise(0)
    return _row(a, "duplicates", d, ded, F.when(d > 0, F.lit("Medium")))


def hl_chronology(df: DataFrame) -> DataFrame:
    return _flat_row(df.agg(_inversions()), "chronology", F.col("inv"), 15)


def hl_nonpositive_lead(df: DataFrame) -> DataFrame:
    return _flat_row(df.agg(_nonpositive()), "nonpositive_lead", F.col("nonpos"), 10)


def hl_outliers(df: DataFrame, k: float = 4.0) -> DataFrame:
    """Sales above Q3 + k·IQR (reported, no deduction)."""
    s = F.col(S.SALES).cast("double")
    q = exact_quantiles(df, S.SALES, [0.25, 0.75], "__q")
    a = (df.crossJoin(q)
           .agg(F.count_if(s > F.col("__q1") + F.lit(float(k)) * (F.col("__q1") - F.col("__q0"))).alias("n")))
    n = F.col("n")
    return _row(a, "outliers", n, F.lit(0), F.when(n > 0, F.lit("Low")))


def unmapped_products(df: DataFrame, name_dim: DataFrame) -> DataFrame:
    """Distinct product names with no factory in the name → factory map."""
    names = df.select(F.col(S.PRODUCT_NAME).alias("n")).filter(F.col("n").isNotNull()).distinct()
    return names.join(name_dim.select(F.col(S.PRODUCT_NAME).alias("n")), "n", "left_anti").withColumnRenamed(
        "n", S.PRODUCT_NAME)


def hl_unmapped(df: DataFrame, name_dim: DataFrame) -> DataFrame:
    a = unmapped_products(df, name_dim).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return _row(a, "unmapped_products", n, F.when(n > 0, F.least(F.lit(15), n * 5)).otherwise(0),
                F.when(n > 0, F.lit("Medium")))


def health_checks(df: DataFrame, name_dim: DataFrame) -> DataFrame:
    """All checks as a long table (check order = recommendation order).

    The row-level counts (nulls, inverted dates, non-positive leads, rows)
    come from one shared aggregate, so the table is scanned once for them."""
    has = set(df.columns)
    chron = {S.ORDER_DATE, S.SHIP_DATE} <= has
    shared = df.agg(
        F.count(F.lit(1)).alias("rows"), _nulls_total(df).alias("nulls"),
        _inversions() if chron else F.lit(0).alias("inv"),
        _nonpositive() if S.LEAD_TIME in has else F.lit(0).alias("nonpos"))
    nulls = _nulls_row(shared)
    chronology = _flat_row(shared, "chronology", F.col("inv"), 15)
    nonpos = _flat_row(shared, "nonpositive_lead", F.col("nonpos"), 10)
    parts = [hl_schema(df).drop("missing_columns"), nulls, hl_duplicates(df),
             chronology if chron else None,
             nonpos if S.LEAD_TIME in has else None,
             hl_outliers(df) if S.SALES in has else None,
             hl_unmapped(df, name_dim) if S.PRODUCT_NAME in has else None]
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def hl_report(df: DataFrame, name_dim: DataFrame) -> DataFrame:
    """Summary row: score = max(5, 100 − Σ deductions); an empty table scores 0."""
    of = lambda name: F.coalesce(F.max(F.when(F.col("check") == name, F.col("count"))), F.lit(0).cast("long"))
    # one aggregate over the (≤ 7) check rows, so every check is planned once
    a = health_checks(df, name_dim).agg(
        F.sum("deduction").alias("__ded"), of("nulls").alias("total_nulls"), of("duplicates").alias("duplicate_count"),
        of("chronology").alias("date_inversions"), of("schema").alias("missing_columns_count"), of("unmapped_products").alias("unmapped_products"))
    return df.agg(F.count(F.lit(1)).alias("total_records")).crossJoin(a).select(
        F.when(F.col("total_records") == 0, F.lit(0))
         .otherwise(F.greatest(F.lit(5), F.lit(100) - F.col("__ded"))).cast("int").alias("health_score"),
        "total_records", F.lit(len(df.columns)).alias("total_columns"), "total_nulls", "duplicate_count", "date_inversions",
        "missing_columns_count", "unmapped_products")


def recommendations(checks: DataFrame) -> DataFrame:
    """Fix ids recommended by the checks (check order)."""
    ids = F.create_map(*[F.lit(x) for kv in [("schema", "fix_missing_cols"), ("nulls", "clean_nulls"),
                                             ("duplicates", "drop_duplicates"), ("chronology", "fix_dates"),
                                             ("nonpositive_lead", "fix_negative_lead_times"),
                                             ("outliers", "cap_sales_outliers"),
                                             ("unmapped_products", "map_default_factory")] for x in kv])
    return checks.filter(F.col("count") > 0).select("check", ids[F.col("check")].alias("fix"))
