"""DuckDB SQL text shared by every oracle query.

``FACT`` mirrors :func:`lanecraft.sources.testdata.shipments`; ``FEAT``
mirrors :func:`lanecraft.plans.featured.batch_features`.  Each oracle query
is ``with_ctes(...)`` + its own SELECT, so all of them start from the same
text.  Rounding: ``round_even`` ≡ Spark ``rint(x·10ⁿ)/10ⁿ``; money sums are
exact decimals rounded half-up in both engines.
"""

from __future__ import annotations

FACT = """fact AS (
  SELECT
    concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR), CAST(l.l_partkey AS VARCHAR),
              CAST(l.l_suppkey AS VARCHAR), strftime(l.l_shipdate, '%Y%m%d'),
              CAST(CAST(round_even(l.l_extendedprice * 100, 0) AS BIGINT) AS VARCHAR)) AS row_id,
    l.l_orderkey AS order_id,
    CAST(o.o_orderdate AS DATE) AS order_date,
    CAST(l.l_shipdate AS DATE) AS ship_date,
    o.o_orderpriority AS ship_mode,
    o.o_custkey AS customer_id,
    'US' AS country,
    c.c_mktsegment AS city,
    n.n_name AS state,
    CAST(c.c_custkey AS VARCHAR) AS postal_code,
    p.p_type AS division,
    r.r_name AS region,
    l.l_partkey AS product_id,
    p.p_name AS product_name,
    CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS sales,
    CAST(trunc(l.l_quantity) AS INTEGER) AS units,
    CAST(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4))
         - CAST(l.l_extendedprice * 0.65 AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS gross_profit,
    CAST(l.l_extendedprice * 0.65 AS DECIMAL(18,4)) AS cost
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

DIMS = """factory_dim AS (
  SELECT p_partkey AS product_id, 'Factory#' || CAST(p_partkey % 5 AS VARCHAR) AS factory
  FROM part WHERE p_partkey % 40 <> 0
),
coords AS (
  SELECT 'Factory#' || CAST(k AS VARCHAR) AS factory, CAST(30 + 3 * k AS DOUBLE) AS factory_lat,
         CAST(-110 + 7 * k AS DOUBLE) AS factory_lon
  FROM range(5) t(k)
),
state_dim AS (
  SELECT n_name AS state, 'N' || CAST(n_nationkey AS VARCHAR) AS state_abbrev,
         CAST(25 + n_nationkey AS DOUBLE) AS state_lat, CAST(-120 + 2 * n_nationkey AS DOUBLE) AS state_lon
  FROM nation WHERE n_nationkey <> 24
),
domestic AS (SELECT n_name AS state FROM nation WHERE n_nationkey < 20),
mode_order AS (
  SELECT * FROM (VALUES ('5-LOW', 0), ('4-NOT SPECIFIED', 1), ('3-MEDIUM', 2), ('2-HIGH', 3), ('1-URGENT', 4))
  t(ship_mode, mode_order)
),
sla AS (
  SELECT * FROM (VALUES ('5-LOW', 760.0::DOUBLE), ('4-NOT SPECIFIED', 745.0::DOUBLE), ('3-MEDIUM', 730.0::DOUBLE),
                        ('2-HIGH', 715.0::DOUBLE), ('1-URGENT', 700.0::DOUBLE)) t(ship_mode, sla_days)
)"""


def temporal_sql(alias: str = "", day_name: bool = False) -> str:
    a = f"{alias}." if alias else ""
    sd, od = f"{a}ship_date", f"{a}order_date"
    cols = [
        f"CAST(year({sd}) AS INTEGER) AS ship_year", f"CAST(month({sd}) AS INTEGER) AS ship_month",
        f"strftime({sd}, '%b') AS ship_month_name", f"CAST(quarter({sd}) AS INTEGER) AS ship_quarter",
        f"CAST(weekofyear({sd}) AS INTEGER) AS ship_week", f"CAST(day({sd}) AS INTEGER) AS ship_day",
        f"CAST(isodow({sd}) - 1 AS INTEGER) AS ship_dow",
        f"CAST(year({od}) AS INTEGER) AS order_year", f"CAST(month({od}) AS INTEGER) AS order_month",
        f"strftime({od}, '%b') AS order_month_name", f"CAST(day({od}) AS INTEGER) AS order_day",
        f"CAST(isodow({od}) - 1 AS INTEGER) AS order_dow",
    ]
    if day_name:
        cols.append(f"strftime({sd}, '%A') AS ship_day_name")
    return ",\n    ".join(cols)


def _slug(x: str) -> str:
    return f"regexp_replace({x}, '[^A-Za-z0-9]', '_', 'g')"


def score_ctes(src: str, out: str, fill: str | None = None, digits: int | None = None,
               dw: float = 0.6, lw: float = 0.4) -> str:
    """Per-route score joined back onto ``src`` as ``out``."""
    score = "s.__score"
    if fill is not None:
        score = f"coalesce({score}, {fill})"
    if digits is not None:
        score = f"round_even({score}, {digits})"
    return f"""{out}_rs AS (
  SELECT state_route AS __route, avg(CAST(delay_flag AS INTEGER)) AS delay_rate, avg(lead_time) AS avg_lead_time
  FROM {src} WHERE state_route IS NOT NULL GROUP BY state_route
),
{out}_mm AS (SELECT min(avg_lead_time) AS __lo, max(avg_lead_time) AS __hi FROM {out}_rs),
{out}_sc AS (
  SELECT __route, CASE WHEN raw IS NULL THEN NULL ELSE least(greatest(raw, 0.0::DOUBLE), 1.0::DOUBLE) END AS __score
  FROM (SELECT __route,
               1.0::DOUBLE - ({dw}::DOUBLE * delay_rate + {lw}::DOUBLE *
                 (CASE WHEN __hi - __lo > 0 THEN (avg_lead_time - __lo) / (__hi - __lo)
                       WHEN avg_lead_time IS NOT NULL THEN 0.0::DOUBLE END)) AS raw
        FROM {out}_rs, {out}_mm)
),
{out} AS (SELECT b.*, {score} AS efficiency_score FROM {src} b LEFT JOIN {out}_sc s ON b.state_route = s.__route)"""


FEAT = f"""b0 AS (
  SELECT f.*, coalesce(fd.factory, 'Unknown Factory') AS factory
  FROM fact f LEFT JOIN factory_dim fd ON f.product_id = fd.product_id
  WHERE date_diff('day', f.order_date, f.ship_date) > 0
),
b1 AS (
  SELECT b0.*, c.factory_lat, c.factory_lon,
    CAST(date_diff('day', b0.order_date, b0.ship_date) AS INTEGER) AS lead_time,
    b0.factory || ' → ' || b0.state AS state_route,
    b0.factory || ' → ' || b0.region AS region_route,
    {_slug('b0.factory')} || '_to_' || {_slug('b0.state')} AS route_id,
    {temporal_sql('b0')}
  FROM b0 LEFT JOIN coords c ON b0.factory = c.factory
),
b1_med AS (SELECT ship_mode AS __mode, median(lead_time) AS mode_median FROM b1 WHERE ship_mode IS NOT NULL GROUP BY ship_mode),
b2 AS (
  SELECT b1.*, coalesce(b1.lead_time > m.mode_median, false) AS delay_flag
  FROM b1 LEFT JOIN b1_med m ON b1.ship_mode = m.__mode
),
{score_ctes('b2', 'feat')}"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def over_feat(select_sql: str, *extra_ctes: str) -> str:
    """Oracle SQL over the batch-featured table ``feat``."""
    return with_ctes(FACT, DIMS, FEAT, *extra_ctes) + select_sql


def over_fact(select_sql: str, *extra_ctes: str) -> str:
    return with_ctes(FACT, DIMS, *extra_ctes) + select_sql


FACTX = FACT.replace("fact AS (", "factx AS (", 1).replace(
    "    l.l_orderkey AS order_id,", "    l.l_suppkey AS __supp,\n    l.l_orderkey AS order_id,", 1)


def dirty_cte(currency: bool = False) -> str:
    sales = ("'$' || format('{:,.4f}', CAST(sales AS DOUBLE))" if currency else "CAST(sales AS VARCHAR)")
    return f"""dirty0 AS (
  SELECT row_id, CAST(order_id AS VARCHAR) AS order_id,
    CASE WHEN __supp % 7 = 0 THEN strftime(order_date, '%Y-%m-%d') ELSE strftime(order_date, '%d-%m-%Y') END AS order_date,
    CASE WHEN product_id % 97 = 0 THEN '31-02-2024' ELSE strftime(ship_date, '%d-%m-%Y') END AS ship_date,
    ship_mode, CAST(customer_id AS VARCHAR) AS customer_id, country, '  ' || city || ' ' AS city, state, postal_code,
    division, region, CAST(product_id AS VARCHAR) AS product_id,
    CASE WHEN product_id % 89 = 0 THEN NULL ELSE product_name END AS product_name,
    CASE WHEN __supp % 13 = 0 THEN NULL ELSE {sales} END AS sales,
    CASE WHEN __supp % 11 = 0 THEN CAST(units AS VARCHAR) || '.0' WHEN __supp % 23 = 0 THEN '2.5' ELSE CAST(units AS VARCHAR) END AS units,
    CASE WHEN __supp % 17 = 0 THEN 'NaN' ELSE CAST(gross_profit AS VARCHAR) END AS gross_profit,
    CASE WHEN __supp % 19 = 0 THEN 'N/A' ELSE CAST(cost AS VARCHAR) END AS cost
  FROM factx
),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE CAST(order_id AS BIGINT) % 100 = 0)"""


AUD = """aud AS (
  SELECT f.*, coalesce(fd.factory, 'Unknown Factory') AS factory, c.factory_lat, c.factory_lon,
    CAST(date_diff('day', f.order_date, f.ship_date) AS INTEGER) AS lead_time
  FROM fact f LEFT JOIN factory_dim fd ON f.product_id = fd.product_id
  LEFT JOIN coords c ON coalesce(fd.factory, 'Unknown Factory') = c.factory
)"""


def recalc_ctes(src: str = "fact", out: str = "recalc", policy: str = "auto", dw: float = 0.6, lw: float = 0.4) -> str:
    med_flag = "coalesce(r1.lead_time > m.mode_median, false)"
    sla_flag = "coalesce(r1.lead_time > coalesce(s.sla_days, 4.0::DOUBLE), false)"
    if policy == "median":
        flag = med_flag
    elif policy == "sla":
        flag = sla_flag
    else:
        flag = (f"CASE WHEN coalesce((SELECT median(lead_time) FROM {out}_r1), 0.0) > 50.0 THEN {med_flag} "
                f"ELSE {sla_flag} END")
    return f"""{out}_r0 AS (
  SELECT f.*, coalesce(fd.factory, 'Unknown Factory') AS factory,
    CASE WHEN f.ship_date IS NULL OR f.order_date IS NULL THEN NULL ELSE
      round_even(greatest(CAST(date_diff('second', CAST(f.order_date AS TIMESTAMP), CAST(f.ship_date AS TIMESTAMP)) AS DOUBLE)
                          / 86400.0, 0.5::DOUBLE), 2) END AS lead_time
  FROM {src} f LEFT JOIN factory_dim fd ON f.product_id = fd.product_id
),
{out}_r1 AS (
  SELECT r.*, coalesce(c.factory_lat, 39.5::DOUBLE) AS factory_lat, coalesce(c.factory_lon, -98.35::DOUBLE) AS factory_lon
  FROM {out}_r0 r LEFT JOIN coords c ON r.factory = c.factory
),
{out}_med AS (SELECT ship_mode AS __mode, median(lead_time) AS mode_median FROM {out}_r1 WHERE ship_mode IS NOT NULL GROUP BY ship_mode),
{out}_r2 AS (
  SELECT r1.*, {flag} AS delay_flag
  FROM {out}_r1 r1 LEFT JOIN {out}_med m ON r1.ship_mode = m.__mode LEFT JOIN sla s ON r1.ship_mode = s.ship_mode
),
{out}_r3 AS (
  SELECT b.*, b.factory || ' → ' || b.state AS state_route, b.factory || ' → ' || b.region AS region_route,
    {_slug('b.factory')} || '_to_' || {_slug('b.state')} AS route_id,
    {temporal_sql('b', day_name=True)}
  FROM {out}_r2 b
),
{score_ctes(f'{out}_r3', out, fill='0.5::DOUBLE', digits=4, dw=dw, lw=lw)}"""


def with_ctes_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
