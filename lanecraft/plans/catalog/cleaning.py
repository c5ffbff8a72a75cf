"""§2.2 cleaning queries on the dirtied raw table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import literal_table
from lanecraft.operators import clean as C
from lanecraft.plans import featured as FT
from lanecraft.plans.oracle_base import DIMS, FACT, FACTX, dirty_cte, with_ctes
from lanecraft.sources import testdata as td

CORRECTIONS = {"red widget": "red widget (fixed)"}
ALLOWED = {S.SHIP_MODE: td.TEST_SHIP_MODES, S.REGION: ["AFRICA", "AMERICA", "ASIA", "EUROPE"],
           S.DIVISION: ["ECONOMY", "PROMO", "STANDARD"]}


def _dirty(s, d, currency=False):
    return FT.dirty(s, d, currency)


def _domains(s):
    return {c: literal_table(s, [(v,) for v in vals], ["v"], ["string"]) for c, vals in ALLOWED.items()}


MONEY = [S.ROW_ID, S.SALES, S.GROSS_PROFIT, S.COST, S.UNITS]

QUERIES = {
    "clean_parse_dates": lambda s, d: C.parse_dates(_dirty(s, d)).select(S.ROW_ID, S.ORDER_DATE, S.SHIP_DATE),
    "clean_parse_dates_multi": lambda s, d: C.parse_dates_multi(_dirty(s, d)).select(S.ROW_ID, S.ORDER_DATE,
                                                                                     S.SHIP_DATE),
    "clean_date_failures": lambda s, d: C.date_parse_failures(_dirty(s, d)),
    "clean_cast_numeric": lambda s, d: C.cast_numeric(_dirty(s, d)).select(*MONEY),
    "clean_postal_pad": lambda s, d: C.postal_pad(_dirty(s, d)).select(S.ROW_ID, S.POSTAL_CODE),
    "clean_dirty_numeric": lambda s, d: C.dirty_numeric(_dirty(s, d, True)).select(*MONEY),
    "clean_missing_profile": lambda s, d: C.missing_profile(_dirty(s, d)),
    "clean_drop_null_dates": lambda s, d: C.drop_null_dates(C.parse_dates(_dirty(s, d))),
    "clean_fill_median": lambda s, d: C.fill_median(C.cast_numeric(_dirty(s, d))).select(*MONEY),
    "clean_fill_unknown": lambda s, d: C.fill_unknown(_dirty(s, d)).select(S.ROW_ID, S.PRODUCT_NAME),
    "clean_dedup_full": lambda s, d: C.dedup_full(_dirty(s, d)),
    "clean_trim": lambda s, d: C.trim(_dirty(s, d)).select(S.ROW_ID, S.CITY),
    "clean_domain_violations": lambda s, d: C.domain_violations(FT.base(s, d), _domains(s)),
    "clean_fix_names": lambda s, d: C.fix_names(FT.base(s, d), CORRECTIONS).groupBy(S.PRODUCT_NAME).agg(
        F.count(F.lit(1)).alias("rows")),
    "clean_drop_invalid_lead": lambda s, d: C.drop_invalid_lead(FT.base(s, d)),
    "clean_enforce_types": lambda s, d: C.enforce_types(FT.base(s, d)),
    "clean_report": lambda s, d: C.clean_report(_dirty(s, d), CORRECTIONS),
    "clean_chain": lambda s, d: C.clean_pipeline(_dirty(s, d), CORRECTIONS),
}

DIRTY = [FACT, DIMS, FACTX, dirty_cte(False)]
DIRTY_CUR = [FACT, DIMS, FACTX, dirty_cte(True)]


def over_dirty(sql: str, *extra: str, currency: bool = False) -> str:
    return with_ctes(*(DIRTY_CUR if currency else DIRTY), *extra) + sql


def over_base(sql: str, *extra: str) -> str:
    return with_ctes(FACT, DIMS, *extra) + sql


def _pd(c: str) -> str:
    return f"CAST(try_strptime({c}, '%d-%m-%Y') AS DATE)"


def _pd_multi(c: str) -> str:
    return f"coalesce(CAST(try_strptime({c}, '%d-%m-%Y') AS DATE), CAST(try_strptime({c}, '%Y-%m-%d') AS DATE))"


POSTAL = "CASE WHEN length(trim(postal_code)) >= 5 THEN trim(postal_code) ELSE lpad(trim(postal_code), 5, '0') END"


def _num(c: str) -> str:
    return f"CASE WHEN isfinite(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END AS {c}"


NUM = ", ".join(_num(c) for c in ("sales", "gross_profit", "cost", "units"))
COLS = ("row_id, order_id, order_date, ship_date, ship_mode, customer_id, country, city, state, postal_code, division, "
        "region, product_id, product_name, sales, units, gross_profit, cost")
C1 = f"""c1 AS (SELECT row_id, order_id, {_pd('order_date')} AS order_date, {_pd('ship_date')} AS ship_date, ship_mode,
  customer_id, country, city, state, {POSTAL} AS postal_code, division, region, product_id, product_name, {NUM}
  FROM dirty)"""
C2 = "c2 AS (SELECT * FROM c1 WHERE order_date IS NOT NULL AND ship_date IS NOT NULL)"
C3 = """c3 AS (SELECT row_id, order_id, order_date, ship_date, coalesce(ship_mode, 'Unknown') AS ship_mode,
  coalesce(customer_id, 'Unknown') AS customer_id, coalesce(country, 'Unknown') AS country,
  coalesce(city, 'Unknown') AS city, coalesce(state, 'Unknown') AS state, postal_code,
  coalesce(division, 'Unknown') AS division, coalesce(region, 'Unknown') AS region,
  coalesce(product_id, 'Unknown') AS product_id, coalesce(product_name, 'Unknown') AS product_name,
  coalesce(sales, (SELECT median(sales) FROM c2)) AS sales,
  coalesce(units, (SELECT trunc(median(units)) FROM c2)) AS units,
  coalesce(gross_profit, (SELECT median(gross_profit) FROM c2)) AS gross_profit,
  coalesce(cost, (SELECT median(cost) FROM c2)) AS cost FROM c2)"""
C4 = "c4 AS (SELECT DISTINCT * FROM c3)"
C5 = f"""c5 AS (SELECT row_id, order_id, order_date, ship_date, trim(ship_mode) AS ship_mode, customer_id,
  trim(country) AS country, trim(city) AS city, trim(state) AS state, postal_code, trim(division) AS division,
  trim(region) AS region, product_id,
  CASE WHEN trim(product_name) = 'red widget' THEN 'red widget (fixed)' ELSE trim(product_name) END AS product_name,
  sales, units, gross_profit, cost FROM c4)"""
C6 = "c6 AS (SELECT * FROM c5 WHERE date_diff('day', order_date, ship_date) > 0)"

SQL = {
    "clean_parse_dates": over_dirty(f"SELECT row_id, {_pd('order_date')} AS order_date, {_pd('ship_date')} AS ship_date FROM dirty"),
    "clean_parse_dates_multi": over_dirty(
        f"SELECT row_id, {_pd_multi('order_date')} AS order_date, {_pd_multi('ship_date')} AS ship_date FROM dirty"),
    "clean_date_failures": over_dirty(f"""SELECT count_if(order_date IS NOT NULL AND {_pd('order_date')} IS NULL) AS order_date_unparsed,
  count_if(ship_date IS NOT NULL AND {_pd('ship_date')} IS NULL) AS ship_date_unparsed FROM dirty"""),
    "clean_cast_numeric": over_dirty(f"SELECT row_id, {NUM} FROM dirty"),
    "clean_postal_pad": over_dirty(f"SELECT row_id, {POSTAL} AS postal_code FROM dirty"),
    "clean_dirty_numeric": over_dirty("""SELECT row_id,
  coalesce(sales, (SELECT median(sales) FROM n), 0.0) AS sales,
  coalesce(gross_profit, (SELECT median(gross_profit) FROM n), 0.0) AS gross_profit,
  coalesce(cost, (SELECT median(cost) FROM n), 0.0) AS cost,
  CAST(trunc(coalesce(units, (SELECT median(units) FROM n), 1.0)) AS INTEGER) AS units FROM n""",
        """n AS (SELECT row_id,
  TRY_CAST(regexp_replace(sales, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS sales,
  TRY_CAST(regexp_replace(gross_profit, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS gross_profit,
  TRY_CAST(regexp_replace(cost, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS cost,
  TRY_CAST(regexp_replace(units, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS units FROM dirty)""", currency=True),
    "clean_missing_profile": over_dirty(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing_count, "
        f"round_even(count_if({c} IS NULL) / count(*) * 100.0, 2) AS missing_pct FROM dirty HAVING count_if({c} IS NULL) > 0"
        for c in S.BASE_COLUMNS)),
    "clean_drop_null_dates": over_dirty(f"""SELECT * REPLACE ({_pd('order_date')} AS order_date, {_pd('ship_date')} AS ship_date)
FROM dirty WHERE {_pd('order_date')} IS NOT NULL AND {_pd('ship_date')} IS NOT NULL"""),
    "clean_fill_median": over_dirty("""SELECT row_id, coalesce(sales, (SELECT median(sales) FROM n)) AS sales,
  coalesce(gross_profit, (SELECT median(gross_profit) FROM n)) AS gross_profit,
  coalesce(cost, (SELECT median(cost) FROM n)) AS cost,
  coalesce(units, (SELECT trunc(median(units)) FROM n)) AS units FROM n""",
        f"n AS (SELECT row_id, {NUM} FROM dirty)"),
    "clean_fill_unknown": over_dirty("SELECT row_id, coalesce(product_name, 'Unknown') AS product_name FROM dirty"),
    "clean_dedup_full": over_dirty("SELECT DISTINCT * FROM dirty"),
    "clean_trim": over_dirty("SELECT row_id, trim(city) AS city FROM dirty"),
    "clean_domain_violations": over_base(" UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM fact WHERE {c} IS NOT NULL AND {c} NOT IN "
        f"({', '.join(repr(v) for v in vals)})" for c, vals in ALLOWED.items())),
    "clean_fix_names": over_base("""SELECT CASE WHEN product_name = 'red widget' THEN 'red widget (fixed)' ELSE product_name END
  AS product_name, count(*) AS rows FROM fact GROUP BY 1"""),
    "clean_drop_invalid_lead": over_base("SELECT * FROM fact WHERE date_diff('day', order_date, ship_date) > 0"),
    "clean_enforce_types": over_base("""SELECT * REPLACE (CAST(units AS BIGINT) AS units, CAST(sales AS DOUBLE) AS sales,
  CAST(gross_profit AS DOUBLE) AS gross_profit, CAST(cost AS DOUBLE) AS cost) FROM fact"""),
    "clean_report": over_dirty("""SELECT (SELECT count(*) FROM dirty) AS raw_rows,
  (SELECT count(*) FROM dirty) - (SELECT count(*) FROM c2) AS bad_date_rows,
  (SELECT count(*) FROM c2) - (SELECT count(*) FROM c4) AS duplicates_removed,
  (SELECT count(*) FROM c4) - (SELECT count(*) FROM c6) AS invalid_leads_removed,
  (SELECT count_if(trim(product_name) = 'red widget') FROM c4) AS product_name_fixes,
  (SELECT count(*) FROM c6) AS final_rows""", C1, C2, C3, C4, C5, C6),
    "clean_chain": over_dirty(f"SELECT {COLS.replace('units', 'CAST(trunc(units) AS BIGINT) AS units')} FROM c6", C1, C2, C3, C4, C5, C6),
}
