"""Automatic repairs recommended by the health checks, and ``fix_all``.

De-duplication keeps the first row per (order, product) by a stable order
(the row id) with ``row_number() = 1``: Spark's window group limit keeps one
row per key and task before the shuffle, so even a key holding a third of the
table never lands whole in one task.

What repairs fill in (default plant, default ship mode) is configuration
(``repair_defaults`` of :data:`lanecraft.schema.DEFAULT_CONFIG`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from lanecraft import schema as S
from lanecraft.functions.exprs import rintn
from lanecraft.functions.quantiles import exact_quantiles
from lanecraft.functions.repeats import parted
from lanecraft.operators import clean as C
from lanecraft.operators import quality as Q

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def drop_duplicates(df: DataFrame, keys=Q.DUP_KEYS, order_col: str = S.ROW_ID) -> DataFrame:
    """Keep one row per key: the one with the smallest ``order_col``."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return C.dedup_full(df)
    parts = parted(df, keys)  # a key's only row stays where it is
    if parts:
        return parts[0].unionByName(_first_rows(parts[1], keys, order_col))
    return _first_rows(df, keys, order_col)


def _first_rows(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys and c != order_col]
    order = ([order_col] if order_col in df.columns else []) + [f"`{c}`" for c in others]  # ties: the smallest row
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def clean_nulls(df: DataFrame) -> DataFrame:
    """Numeric nulls → column median (0 when all null); string nulls → Unknown.
    Dates and booleans are left as they are."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    num = C.null_columns(df, num)            # only columns that need a fill get a median
    out = df
    if num:
        out = out.crossJoin(C._medians(df, num))
        fills = {c: F.coalesce(F.col(f"`{c}`"), F.coalesce(F.col(f"__med_{c}"), F.lit(0.0)).cast(df.schema[c].dataType))
                 for c in num}
        out = out.withColumns(fills).drop(*[f"__med_{c}" for c in num])
    return out.fillna(S.UNKNOWN, subset=strs) if strs else out


def fix_dates(df: DataFrame) -> DataFrame:
    """Swap order and ship date where ship < order."""
    o, s = F.col(S.ORDER_DATE), F.col(S.SHIP_DATE)
    inv = F.coalesce(s < o, F.lit(False))
    return df.withColumns({S.ORDER_DATE: F.when(inv, s).otherwise(o), S.SHIP_DATE: F.when(inv, o).otherwise(s)})


def fix_nonpositive_lead(df: DataFrame, floor: float = S.MIN_LEAD_DAYS) -> DataFrame:
    lt = F.col(S.LEAD_TIME).cast("double")
    return df.withColumn(S.LEAD_TIME, rintn(F.when(lt.isNull(), lt).otherwise(F.greatest(lt, F.lit(floor))), 2))


def cap_sales(df: DataFrame, q: float = 0.99) -> DataFrame:
    """Winsorize sales at the q-quantile (exact, linear interpolation)."""
    s = F.col(S.SALES).cast("double")
    p = exact_quantiles(df, S.SALES, [q], "__p").withColumnRenamed("__p0", "__p")
    return (df.crossJoin(p)
              .withColumn(S.SALES, F.when(s.isNull(), s).otherwise(F.least(s, F.col("__p")))).drop("__p"))


def default_factory(df: DataFrame, name_dim: DataFrame | None = None, default: str = S.REPAIR_FACTORY) -> DataFrame:
    """Null factory → ``default``; without a factory column, look the name up first."""
    if S.FACTORY in df.columns:
        return df.withColumn(S.FACTORY, F.coalesce(F.col(S.FACTORY), F.lit(default)))
    dim = name_dim.select(F.col(S.PRODUCT_NAME).alias("__n"), F.col(S.FACTORY).alias("__f"))
    return (df.join(dim, F.col(S.PRODUCT_NAME) == F.col("__n"), "left")
              .withColumn(S.FACTORY, F.coalesce(F.col("__f"), F.lit(default))).drop("__n", "__f"))


def missing_cols(df: DataFrame, core=Q.CORE_COLUMNS, default_mode: str = S.REPAIR_SHIP_MODE) -> DataFrame:
    """Add absent core columns: money 0.0, units 1, ship mode default, else 'Unassigned'."""
    add = {}
    for c in core:
        if c in df.columns:
            continue
        if c in (S.SALES, S.GROSS_PROFIT, S.COST):
            add[c] = F.lit(0.0)
        elif c == S.UNITS:
            add[c] = F.lit(1)
        elif c == S.SHIP_MODE:
            add[c] = F.lit(default_mode)
        else:
            add[c] = F.lit("Unassigned")
    return df.withColumns(add) if add else df


FIXES = {
    "fix_missing_cols": lambda df, ctx: missing_cols(df, default_mode=ctx["ship_mode"]),
    "clean_nulls": lambda df, ctx: clean_nulls(df),
    "drop_duplicates": lambda df, ctx: drop_duplicates(df),
    "fix_dates": lambda df, ctx: fix_dates(df),
    "fix_negative_lead_times": lambda df, ctx: fix_nonpositive_lead(df),
    "cap_sales_outliers": lambda df, ctx: cap_sales(df),
    "map_default_factory": lambda df, ctx: default_factory(df, ctx["name_dim"], ctx["factory"]),
}


def fix_all(df: DataFrame, name_dim: DataFrame, factory: str = S.REPAIR_FACTORY, ship_mode: str = S.REPAIR_SHIP_MODE) -> tuple[DataFrame, list[str]]:
    """Diagnose once, then apply the recommended fixes in check order.

    The diagnosis is one small action (≤ 7 rows of check results); the fixes
    themselves stay lazy."""
    found = {r["fix"] for r in Q.recommendations(Q.health_checks(df, name_dim)).collect()}
    recs = [f for f in FIXES if f in found]
    out = df
    for fix in recs:
        out = FIXES[fix](out, {"name_dim": name_dim, "factory": factory, "ship_mode": ship_mode})
    return out, recs
