"""CSV at the edges, Parquet inside.

Readers never infer a schema (raw text stays text, typed reads take an
explicit schema); writers keep surrounding blanks so a round trip is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lanecraft import schema as S
from lanecraft.operators import clean as C
from lanecraft.plans.materialize import shared_path

_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; empty fields and the usual NA texts → null."""
    r = spark.read.option("header", "true").option("encoding", encoding).options(**_KEEP_BLANKS)
    if schema is None:
        r = r.option("inferSchema", "false")
    else:
        r = r.schema(schema)
    df = r.csv(path)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(S.NA_TEXTS), F.col(f"`{c}`")) for c in text})


def text_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, or Latin-1 when a line of the files isn't valid UTF-8 (one narrow pass).

    Read as Latin-1 every byte is one character, so the check sees the bytes themselves."""
    lines = spark.read.option("header", "false").option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "") \
        .schema("line string").csv(path)
    bad = lines.filter(~F.is_valid_utf8(F.encode("line", "ISO-8859-1").cast("string")))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType = S.TYPED_SCHEMA,
                   date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Typed re-read with an explicit schema and date format."""
    return (spark.read.option("header", "true").option("dateFormat", date_format).options(**_KEEP_BLANKS)
                 .schema(schema).csv(path))


def read_dayfirst_csv(spark: SparkSession, path: str, date_cols=C.DATE_COLUMNS, encoding: str | None = None) -> DataFrame:
    """Raw text read (UTF-8, else Latin-1), then dates parsed day-first or ISO (unparsable → null)."""
    raw = read_raw_csv(spark, path, S.RAW_STRING_SCHEMA, encoding or text_encoding(spark, path))
    return C.parse_dates_multi(raw, date_cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    df.write.mode(mode).option("header", "true").option("compression", compression).options(**_KEEP_BLANKS).csv(path)
    return path


def scratch_csv(df: DataFrame, name: str) -> str:
    """Write to a fresh folder under the shared checkpoint root, one gzip file a task (as text a row takes ten times
    its size in Parquet)."""
    return write_csv(df, shared_path(df.sparkSession, name), compression="gzip")


_FROM_FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_stats(spark: SparkSession, path: str, columns: tuple[str, ...] = (), plans: list | None = None) -> dict:
    """Row count (``rows``) and per column ``min_c`` and ``max_c`` of a Parquet table, from its file footers.

    The Parquet source of the second kind takes the aggregate over; no row group is read.  Numbers and dates only:
    of other types footers may hold shortened bounds.  One row comes back.  ``plans`` receives the plan's text."""
    before = {k: spark.conf.get(k, None) for k in _FROM_FOOTERS}
    try:
        for k, v in _FROM_FOOTERS.items():
            spark.conf.set(k, v)
        aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
        df = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *aggs)
        if plans is not None:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.first().asDict()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


REQUIRED_UPLOAD = [S.ORDER_ID, S.SHIP_MODE, S.PRODUCT_NAME, S.SALES, S.UNITS]


def stage_profile(staged: DataFrame, required=REQUIRED_UPLOAD) -> DataFrame:
    """Staged upload profile: rows, columns, required-column fit."""
    have = [c for c in required if c in staged.columns]
    return staged.agg(F.count(F.lit(1)).alias("staged_rows")).select(
        "staged_rows", F.lit(len(staged.columns)).alias("staged_columns"),
        F.lit(len(have)).alias("required_fit"), F.lit(len(required)).alias("required_total"),
        F.lit(",".join(c for c in required if c not in have)).alias("missing_required"))


SUMMARY_COLUMNS = [S.ORDER_ID, S.ORDER_DATE, S.SHIP_DATE, S.CUSTOMER_ID, S.CITY, S.STATE, S.FACTORY, S.SALES,
                   S.GROSS_PROFIT, S.LEAD_TIME, S.DELAY_FLAG]


def summary_columns(df: DataFrame, cols=SUMMARY_COLUMNS) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])
