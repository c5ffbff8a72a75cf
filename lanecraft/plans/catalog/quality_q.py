"""§2.11 data quality, health and repair queries (on the unfiltered audit table)."""

from __future__ import annotations

from lanecraft import schema as S
from lanecraft.operators import quality as Q
from lanecraft.operators import repair as RP
from lanecraft.plans import featured as FT
from lanecraft.sources import testdata as td
from lanecraft.plans.oracle_base import AUD, DIMS, FACT, with_ctes


def _aud(s, d):
    return FT.audited(s, d)


def _names(s, d):
    return td.factory_name_dim(s, d)


DROPPED = [S.COUNTRY, S.CITY, S.UNITS, S.COST]

QUERIES = {
    "dq_counts": lambda s, d: Q.dq_counts(_aud(s, d)),
    "dq_score": lambda s, d: Q.dq_score(Q.dq_counts(_aud(s, d))),
    "dq_rules": lambda s, d: Q.dq_rules(_aud(s, d)),
    "dq_completeness": lambda s, d: Q.dq_completeness(_aud(s, d)),
    "hl_nulls": lambda s, d: Q.hl_nulls(_aud(s, d)),
    "hl_duplicates": lambda s, d: Q.hl_duplicates(_aud(s, d)),
    "hl_chronology": lambda s, d: Q.hl_chronology(_aud(s, d)),
    "hl_nonpositive_lead": lambda s, d: Q.hl_nonpositive_lead(_aud(s, d)),
    "hl_outliers": lambda s, d: Q.hl_outliers(_aud(s, d)),
    "hl_unmapped": lambda s, d: Q.hl_unmapped(_aud(s, d), _names(s, d)),
    "hl_report": lambda s, d: Q.hl_report(_aud(s, d), _names(s, d)),
    "fix_drop_duplicates": lambda s, d: RP.drop_duplicates(_aud(s, d)),
    "fix_clean_nulls": lambda s, d: RP.clean_nulls(_aud(s, d)),
    "fix_dates": lambda s, d: RP.fix_dates(_aud(s, d)),
    "fix_nonpositive_lead": lambda s, d: RP.fix_nonpositive_lead(_aud(s, d)),
    "fix_cap_sales": lambda s, d: RP.cap_sales(_aud(s, d)),
    "fix_default_factory": lambda s, d: RP.default_factory(FT.base(s, d), _names(s, d), "Factory#0"),
    "fix_missing_cols": lambda s, d: RP.missing_cols(FT.base(s, d).drop(*DROPPED), default_mode="5-LOW"),
    "fix_all": lambda s, d: RP.fix_all(_aud(s, d), _names(s, d), "Factory#0", "5-LOW")[0],
}

AUD_COLS = S.BASE_COLUMNS + [S.FACTORY, S.FACTORY_LAT, S.FACTORY_LON, S.LEAD_TIME]
NUMERIC = {S.ORDER_ID: "BIGINT", S.CUSTOMER_ID: "BIGINT", S.PRODUCT_ID: "BIGINT", S.SALES: "DECIMAL(18,4)",
           S.UNITS: "INTEGER", S.GROSS_PROFIT: "DECIMAL(18,4)", S.COST: "DECIMAL(18,4)",
           S.FACTORY_LAT: "DOUBLE", S.FACTORY_LON: "DOUBLE", S.LEAD_TIME: "INTEGER"}
STRINGS = [S.ROW_ID, S.SHIP_MODE, S.COUNTRY, S.CITY, S.STATE, S.POSTAL_CODE, S.DIVISION, S.REGION,
           S.PRODUCT_NAME, S.FACTORY]
NAMES = """names AS (SELECT DISTINCT product_name FROM (
  SELECT p.p_name AS product_name FROM part p JOIN factory_dim fd ON p.p_partkey = fd.product_id))"""
NULLS = " + ".join(f"count_if({c} IS NULL)" for c in AUD_COLS)
DUPS = "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM aud GROUP BY order_id, product_id))"
COUNTS = f"""cnt AS (SELECT count(*) AS total_rows, {NULLS} AS total_nulls, count_if(lead_time < 0) AS negative_lead_time,
  count_if(ship_date < order_date) AS invalid_dates, count_if(factory_lat IS NULL OR factory_lon IS NULL) AS missing_coords,
  CAST({DUPS} AS BIGINT) AS duplicate_rows FROM aud)"""
CHECKS = f"""chk AS (
  SELECT 'schema' AS "check", CAST(0 AS BIGINT) AS count, 0 AS deduction, CAST(NULL AS VARCHAR) AS severity
  UNION ALL SELECT 'nulls', n, CASE WHEN n > 0 THEN least(20, CAST(trunc(n / r * 100.0) AS INTEGER)) ELSE 0 END,
    CASE WHEN n > 0 THEN CASE WHEN n < r * 0.05 THEN 'Medium' ELSE 'High' END END
    FROM (SELECT {NULLS} AS n, count(*) AS r FROM aud)
  UNION ALL SELECT 'duplicates', d, CASE WHEN d > 0 THEN least(15, CAST(trunc(d / r * 100.0) AS INTEGER) + 5) ELSE 0 END,
    CASE WHEN d > 0 THEN 'Medium' END FROM (SELECT {DUPS} AS d, count(*) AS r FROM aud)
  UNION ALL SELECT 'chronology', n, CASE WHEN n > 0 THEN 15 ELSE 0 END, CASE WHEN n > 0 THEN 'High' END
    FROM (SELECT count_if(ship_date < order_date) AS n FROM aud)
  UNION ALL SELECT 'nonpositive_lead', n, CASE WHEN n > 0 THEN 10 ELSE 0 END, CASE WHEN n > 0 THEN 'High' END
    FROM (SELECT count_if(lead_time <= 0) AS n FROM aud)
  UNION ALL SELECT 'outliers', n, 0, CASE WHEN n > 0 THEN 'Low' END FROM (
    SELECT count_if(CAST(sales AS DOUBLE) > q3 + 4.0 * (q3 - q1)) AS n FROM aud,
      (SELECT quantile_cont(CAST(sales AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(sales AS DOUBLE), 0.75) AS q3 FROM aud))
  UNION ALL SELECT 'unmapped_products', n, CASE WHEN n > 0 THEN least(15, n * 5) ELSE 0 END, CASE WHEN n > 0 THEN 'Medium' END
    FROM (SELECT count(*) AS n FROM (SELECT DISTINCT product_name FROM aud WHERE product_name IS NOT NULL
                                     AND product_name NOT IN (SELECT product_name FROM names)))
)"""


def over_aud(sql: str, *extra: str) -> str:
    return with_ctes(FACT, DIMS, AUD, NAMES, *extra) + sql


def _check(name: str) -> str:
    return over_aud(f"SELECT * FROM chk WHERE \"check\" = '{name}'", CHECKS)


def _clean_nulls_select(src: str = "aud") -> str:
    parts = []
    for c in AUD_COLS:
        if c in NUMERIC:
            t = NUMERIC[c]
            med = f"(SELECT median(CAST({c} AS DOUBLE)) FROM {src})"
            fill = (f"CAST(trunc(coalesce({med}, 0.0)) AS {t})" if t in ("BIGINT", "INTEGER")
                    else f"CAST(coalesce({med}, 0.0) AS {t})")
            parts.append(f"coalesce({c}, {fill}) AS {c}")
        elif c in STRINGS:
            parts.append(f"coalesce({c}, 'Unknown') AS {c}")
        else:
            parts.append(c)
    return ", ".join(parts)


DEDUP = f"""SELECT {', '.join(AUD_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id, product_id ORDER BY row_id) AS __rn FROM {{src}}) WHERE __rn = 1"""
SWAP = """SELECT * REPLACE (CASE WHEN coalesce(ship_date < order_date, false) THEN ship_date ELSE order_date END AS order_date,
  CASE WHEN coalesce(ship_date < order_date, false) THEN order_date ELSE ship_date END AS ship_date) FROM {src}"""
CLIP = """SELECT * REPLACE (round_even(CASE WHEN lead_time IS NULL THEN NULL
  ELSE greatest(CAST(lead_time AS DOUBLE), 0.5::DOUBLE) END, 2) AS lead_time) FROM {src}"""

SQL = {
    "dq_counts": over_aud("SELECT * FROM cnt", COUNTS),
    "dq_score": over_aud("""SELECT *, greatest(0.0, least(100.0, 100.0 - (total_nulls * 0.1 + duplicate_rows * 0.5
  + negative_lead_time * 2.0 + invalid_dates * 2.0 + missing_coords * 1.0))) AS quality_score FROM cnt""", COUNTS),
    "dq_rules": over_aud("""SELECT rule, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'Order & Ship Date Chronology' AS rule, count_if(ship_date < order_date) AS violations FROM aud
  UNION ALL SELECT 'Non-Negative Transit Days', count_if(lead_time < 0) FROM aud
  UNION ALL SELECT 'Factory Coordinate Mapping', count_if(factory_lat IS NULL OR factory_lon IS NULL) FROM aud
  UNION ALL SELECT 'Division & Product Integrity', count_if(d <> 1 OR n > 0) FROM (
    SELECT product_id, count(DISTINCT division) AS d, count_if(division IS NULL) AS n FROM aud
    WHERE product_id IS NOT NULL GROUP BY product_id)
  UNION ALL SELECT 'Financial Balance (Sales = Cost + Profit)',
    count_if(abs(CAST(sales AS DOUBLE) - CAST(cost AS DOUBLE) - CAST(gross_profit AS DOUBLE)) > 0.01) FROM aud)"""),
    "dq_completeness": over_aud(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing_values, "
        f"round_even((1.0 - count_if({c} IS NULL) / count(*)) * 100.0, 2) AS completeness_pct FROM aud"
        for c in AUD_COLS)),
    "hl_nulls": _check("nulls"),
    "hl_duplicates": _check("duplicates"),
    "hl_chronology": _check("chronology"),
    "hl_nonpositive_lead": _check("nonpositive_lead"),
    "hl_outliers": _check("outliers"),
    "hl_unmapped": _check("unmapped_products"),
    "hl_report": over_aud(f"""SELECT CASE WHEN (SELECT count(*) FROM aud) = 0 THEN 0
  ELSE greatest(5, 100 - (SELECT sum(deduction) FROM chk)) END AS health_score,
  (SELECT count(*) FROM aud) AS total_records, {len(AUD_COLS)} AS total_columns,
  (SELECT count FROM chk WHERE "check" = 'nulls') AS total_nulls,
  (SELECT count FROM chk WHERE "check" = 'duplicates') AS duplicate_count,
  (SELECT count FROM chk WHERE "check" = 'chronology') AS date_inversions,
  (SELECT count FROM chk WHERE "check" = 'schema') AS missing_columns_count,
  (SELECT count FROM chk WHERE "check" = 'unmapped_products') AS unmapped_products""", CHECKS),
    "fix_drop_duplicates": over_aud(DEDUP.format(src="aud")),
    "fix_clean_nulls": over_aud(f"SELECT {_clean_nulls_select()} FROM aud"),
    "fix_dates": over_aud(SWAP.format(src="aud")),
    "fix_nonpositive_lead": over_aud(CLIP.format(src="aud")),
    "fix_cap_sales": over_aud("""SELECT * REPLACE (CASE WHEN sales IS NULL THEN NULL
  ELSE least(CAST(sales AS DOUBLE), (SELECT quantile_cont(CAST(sales AS DOUBLE), 0.99) FROM aud)) END AS sales) FROM aud"""),
    "fix_default_factory": with_ctes(FACT, DIMS) + """SELECT f.*, coalesce(nd.factory, 'Factory#0') AS factory FROM fact f
LEFT JOIN (SELECT p.p_name AS product_name, arg_min(fd.factory, p.p_partkey) AS factory
           FROM part p JOIN factory_dim fd ON p.p_partkey = fd.product_id GROUP BY p.p_name) nd
  ON f.product_name = nd.product_name""",
    "fix_missing_cols": with_ctes(FACT, DIMS) + f"""SELECT * EXCLUDE ({', '.join(DROPPED)}),
  'Unassigned' AS country, 'Unassigned' AS city, 1 AS units, 0.0::DOUBLE AS cost FROM fact""",
    "fix_all": over_aud("SELECT * FROM f4",
                        f"f1 AS (SELECT {_clean_nulls_select()} FROM aud)",
                        "f2 AS (" + DEDUP.format(src="f1") + ")",
                        "f3 AS (" + SWAP.format(src="f2") + ")",
                        "f4 AS (" + CLIP.format(src="f3") + ")"),
}
