"""Cleaning operators: schema check, date parsing, numeric casts and repair,
missing-value profile and fills, de-duplication, trimming, domain checks,
name fixes, invalid-lead removal, final types and a cleaning report.

Scalar statistics (medians) are 1-row aggregates crossed into the plan, so a
fill is one extra aggregate pass, never a driver round-trip.  Parsing uses the
``try_*`` functions: a bad value becomes null instead of failing the job
under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from lanecraft import schema as S
from lanecraft.functions.exprs import literal_table
from lanecraft.functions.quantiles import exact_medians
from lanecraft.functions.repeats import parted
from lanecraft.plans.materialize import materialize

DAY_FIRST = "dd-MM-yyyy"
ISO = "yyyy-MM-dd"
DATE_COLUMNS = [S.ORDER_DATE, S.SHIP_DATE]
MONEY_COLUMNS = [S.SALES, S.GROSS_PROFIT, S.COST]


# ── schema ───────────────────────────────────────────────────────────────────

def schema_report(df: DataFrame, expected: list[str] = S.BASE_COLUMNS) -> DataFrame:
    """(column, status) for every expected and extra column: ok / missing / extra."""
    spark = df.sparkSession
    have = set(df.columns)
    rows = [(c, "ok" if c in have else "missing") for c in expected]
    rows += [(c, "extra") for c in df.columns if c not in set(expected)]
    return literal_table(spark, rows, ["column", "status"], ["string", "string"])


def check_schema(df: DataFrame, expected: list[str] = S.BASE_COLUMNS) -> DataFrame:
    """Raise on missing expected columns; extra columns are kept."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {len(missing)} expected column(s): {', '.join(missing)}")
    return df


# ── dates ────────────────────────────────────────────────────────────────────

def parse_date(c, fmt: str = DAY_FIRST):
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(fmt)).cast("date")


def parse_dates(df: DataFrame, cols=DATE_COLUMNS, fmt: str = DAY_FIRST) -> DataFrame:
    """Text → date with one format; unparsable → null."""
    return df.withColumns({c: parse_date(c, fmt) for c in cols})


def parse_dates_multi(df: DataFrame, cols=DATE_COLUMNS, formats=(DAY_FIRST, ISO)) -> DataFrame:
    """First format that parses wins (day-first, then ISO)."""
    return df.withColumns({c: F.coalesce(*[parse_date(c, f) for f in formats]) for c in cols})


def date_parse_failures(raw: DataFrame, cols=DATE_COLUMNS, fmt: str = DAY_FIRST) -> DataFrame:
    """Per date column: values that were present but did not parse (one row)."""
    return raw.agg(*[F.count_if(F.col(c).isNotNull() & parse_date(c, fmt).isNull()).alias(f"{c}_unparsed")
                     for c in cols])


# ── numerics ─────────────────────────────────────────────────────────────────

def cast_numeric(df: DataFrame, money_cols=MONEY_COLUMNS, int_cols=(S.UNITS,)) -> DataFrame:
    """Coerce text to numbers; anything unparsable, ``NaN`` and infinities included, becomes null.

    All columns become doubles (``3.0`` units are 3); :func:`enforce_types` makes units integers."""
    return df.withColumns({c: number(F.col(c)) for c in [*money_cols, *int_cols] if c in df.columns})


def number(c):
    """Text → finite double or null."""
    v = F.trim(c.cast("string")).try_cast(T.DoubleType())
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def postal_pad(df: DataFrame, col: str = S.POSTAL_CODE, width: int = 5) -> DataFrame:
    """Trim and left-pad with zeros to ``width``; longer codes are kept whole."""
    t = F.trim(F.col(col))
    return df.withColumn(col, F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0")))


def null_columns(df: DataFrame, cols) -> list[str]:
    """Which of ``cols`` hold a null (one narrow aggregate, one small action)."""
    cols = list(cols)
    if not cols:
        return []
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def _medians(df: DataFrame, cols) -> DataFrame:
    """One row of exact medians (distributed; see :mod:`lanecraft.functions.quantiles`)."""
    return exact_medians(df, {c: f"__med_{c}" for c in cols})


def dirty_numeric(df: DataFrame, money_cols=MONEY_COLUMNS, unit_col: str = S.UNITS) -> DataFrame:
    """Strip everything but digits, dot and minus; cast; fill nulls with the
    column median (0.0, and 1 for units, when a column has no value); units → int."""
    cols = [c for c in money_cols if c in df.columns]
    has_units = unit_col in df.columns
    num = {c: F.regexp_replace(F.col(c).cast("string"), r"[^0-9.\-]", "").try_cast(T.DoubleType())
           for c in cols + ([unit_col] if has_units else [])}
    d = df.withColumns(num)
    med = _medians(d, list(num)) if num else None
    out = d.crossJoin(med) if num else d
    med_of = lambda c: F.col(f"__med_{c}")
    fills = {c: F.coalesce(F.col(c), med_of(c), F.lit(0.0)) for c in cols}
    if has_units:
        fills[unit_col] = F.coalesce(F.col(unit_col), med_of(unit_col), F.lit(1.0)).cast("int")
    return out.withColumns(fills).drop(*[f"__med_{c}" for c in num])


# ── missing values ───────────────────────────────────────────────────────────

def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct) for columns with at least one null.

    One pass: every column's null count in a single aggregate, then unpivot."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    long = counts.selectExpr("__rows", f"stack({len(cols)}, {stack}) as (`column`, missing_count)")
    return (long.filter(F.col("missing_count") > 0)
                .select("column", "missing_count",
                        (F.rint(F.col("missing_count") / F.col("__rows") * 10000.0) / 100.0).alias("missing_pct")))


def drop_null_dates(df: DataFrame, cols=DATE_COLUMNS) -> DataFrame:
    """Drop a row when any date is missing."""
    return df.dropna(how="any", subset=list(cols))


def fill_median(df: DataFrame, money_cols=MONEY_COLUMNS, unit_col: str = S.UNITS) -> DataFrame:
    """Numeric nulls → column median (units → truncated median); all medians come from one pass."""
    cols = [c for c in money_cols if c in df.columns] + ([unit_col] if unit_col in df.columns else [])
    if not cols:
        return df
    med = lambda c: F.col(f"__med_{c}").cast("long") if c == unit_col else F.col(f"__med_{c}")
    out = df.crossJoin(_medians(df, cols))
    fills = {c: F.coalesce(F.col(c), med(c).cast(df.schema[c].dataType)) for c in cols}
    return out.withColumns(fills).drop(*[f"__med_{c}" for c in cols])


def fill_unknown(df: DataFrame, cols=S.CATEGORICAL_COLUMNS + [S.PRODUCT_ID], value: str = S.UNKNOWN) -> DataFrame:
    """String categorical nulls → ``Unknown`` (non-string columns untouched)."""
    strings = [c for c in cols if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    return df.fillna(value, subset=strings)


def dedup_full(df: DataFrame) -> DataFrame:
    """Drop fully identical rows: only those that may have a copy are shuffled, with map-side partial aggregation."""
    parts = parted(df, df.columns)
    return parts[0].unionByName(parts[1].dropDuplicates()) if parts else df.dropDuplicates()


# ── categoricals ─────────────────────────────────────────────────────────────

def trim(df: DataFrame, cols=S.TRIM_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)) for c in cols if c in df.columns})


def domain_violations(df: DataFrame, domains: dict[str, DataFrame]) -> DataFrame:
    """(column, value) of distinct values outside each column's allow-list.

    ``domains`` maps a column to a one-column DataFrame of allowed values;
    each check is a left-anti join (values are kept in the data, only reported)."""
    parts = []
    for col, allowed in domains.items():
        vals = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
        allow = allowed.select(F.col(allowed.columns[0]).alias("value"))
        parts.append(vals.join(allow, "value", "left_anti").select(F.lit(col).alias("column"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fix_names(df: DataFrame, corrections: dict[str, str], col: str = S.PRODUCT_NAME) -> DataFrame:
    """Exact-value replacement map."""
    if not corrections:
        return df
    return df.replace(corrections, subset=[col])


def count_name_fixes(df: DataFrame, corrections: dict[str, str], col: str = S.PRODUCT_NAME) -> DataFrame:
    return df.agg(F.count_if(F.col(col).isin(list(corrections))).alias("product_name_fixes"))


def valid_lead(order_date=S.ORDER_DATE, ship_date=S.SHIP_DATE):
    """Ship date after order date (lead > 0 days)."""
    return F.datediff(ship_date, order_date) > 0


def drop_invalid_lead(df: DataFrame) -> DataFrame:
    return df.filter(valid_lead())


def enforce_types(df: DataFrame) -> DataFrame:
    """Final casts: integer units, double money."""
    casts = {S.UNITS: F.col(S.UNITS).cast("long")}
    casts.update({c: F.col(c).cast("double") for c in MONEY_COLUMNS if c in df.columns})
    return df.withColumns(casts)


# ── pipeline ─────────────────────────────────────────────────────────────────

def clean_with_report(raw: DataFrame, corrections: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, one row of stage counts): load → schema → dates → numerics → missing → dedup → trim → names →
    lead → types, and what each stage dropped or changed.

    The counts are observed while the stages run (``Observation``); the pass that writes the cleaned rows yields
    the report, nothing is counted again."""
    seen, parsed, single, final = (Observation(n) for n in ("raw", "parsed", "single", "final"))
    rows = lambda name: F.count(F.lit(1)).alias(name)
    d = check_schema(raw).observe(seen, rows("raw_rows"))
    d = postal_pad(cast_numeric(parse_dates(d)))
    # text is parsed once, for the medians and the rows
    d = materialize(drop_null_dates(d).observe(parsed, rows("n")), "parsed")
    d = trim(dedup_full(fill_unknown(fill_median(d))))
    d = d.observe(single, rows("n"), F.count_if(F.col(S.PRODUCT_NAME).isin(list(corrections or {}))).alias("product_name_fixes"))
    d = drop_invalid_lead(fix_names(d, corrections or {})).observe(final, rows("final_rows"))
    d = materialize(enforce_types(d), "cleaned")
    raw_rows, dated, once, kept = seen.get["raw_rows"], parsed.get["n"], single.get, final.get["final_rows"]
    counts = {"raw_rows": raw_rows, "bad_date_rows": raw_rows - dated, "duplicates_removed": dated - once["n"],
              "invalid_leads_removed": once["n"] - kept, "product_name_fixes": once["product_name_fixes"], "final_rows": kept}
    report = raw.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()])
    return d, report


def clean_pipeline(raw: DataFrame, corrections: dict[str, str] | None = None) -> DataFrame:
    return clean_with_report(raw, corrections)[0]


def clean_report(raw: DataFrame, corrections: dict[str, str] | None = None) -> DataFrame:
    return clean_with_report(raw, corrections)[1]
