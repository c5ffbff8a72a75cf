"""§2.9 report aggregates (pages)."""

from __future__ import annotations

from lanecraft.operators import filters as FL
from lanecraft.operators import kpi as K
from lanecraft.operators import report as RP
from lanecraft.plans.catalog.common import feat, route_summary_sql
from lanecraft.plans.oracle_base import over_feat
from lanecraft.sources import testdata as td

FACTORY = "Factory#1"
ORDER = 77


def _kpis(s, d):
    return K.summary(feat(s, d))


def _cust(s, d):
    return RP.customer_summary(feat(s, d))


def _prod(s, d):
    return RP.product_summary(feat(s, d))


def _abc(s, d):
    return RP.product_abc(_prod(s, d))


def _orders(s, d):
    return FL.order_search(feat(s, d), "ring", "Delayed Only", 1998, "sales", False)


QUERIES = {
    "rpt_division_split": lambda s, d: RP.division_split(feat(s, d)),
    "rpt_region_split": lambda s, d: RP.region_split(feat(s, d)),
    "rpt_period_label": lambda s, d: RP.period_label(K.monthly_trend(feat(s, d))),
    "rpt_health_index": lambda s, d: RP.health_index(_kpis(s, d)),
    "rpt_gauge_band": lambda s, d: RP.gauge_band(_kpis(s, d).select("on_time_rate_pct"), "on_time_rate_pct"),
    "rpt_worst_state_mode": lambda s, d: RP.worst_state_mode(feat(s, d)),
    "rpt_profit_waterfall": lambda s, d: RP.profit_waterfall(_kpis(s, d)),
    "rpt_best_worst_factory": lambda s, d: RP.best_worst_factory(K.factory_performance(feat(s, d))),
    "rpt_factory_deep_dive": lambda s, d: RP.factory_deep_dive(feat(s, d), FACTORY),
    "rpt_factory_product_mix": lambda s, d: RP.factory_product_mix(feat(s, d), FACTORY),
    "rpt_factory_routes": lambda s, d: RP.factory_routes(feat(s, d), FACTORY, 10),
    "rpt_factory_catalog": lambda s, d: RP.factory_catalog(td.factory_name_dim(s, d)),
    "cust_summary": lambda s, d: _cust(s, d).drop("__s", "__p"),
    "cust_cards": lambda s, d: RP.customer_cards(_cust(s, d)),
    "cust_top": lambda s, d: RP.top_customers(_cust(s, d), 10),
    "prod_detail": lambda s, d: RP.product_detail(feat(s, d)),
    "prod_summary": lambda s, d: _prod(s, d).drop("__s", "__p"),
    "prod_abc": _abc,
    "prod_abc_counts": lambda s, d: RP.abc_counts(_abc(s, d)),
    "prod_cards": lambda s, d: RP.product_cards(_prod(s, d), _abc(s, d), feat(s, d)),
    "prod_treemap_rollup": lambda s, d: RP.treemap_rollup(feat(s, d)),
    "ord_year_counts": lambda s, d: RP.order_year_counts(feat(s, d)),
    "ord_strip": lambda s, d: RP.order_strip(_orders(s, d)),
    "ord_display": lambda s, d: RP.order_display(_orders(s, d)),
    "ord_detail": lambda s, d: RP.order_detail(feat(s, d), ORDER),
}

KPI_LITE = """k AS (SELECT CAST(round(sum(sales), 2) AS DOUBLE) AS total_sales, CAST(round(sum(cost), 2) AS DOUBLE) AS total_cost,
  coalesce(round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2), 0.0) AS delay_rate_pct,
  coalesce(round_even(CAST(sum(gross_profit) AS DOUBLE) / nullif(CAST(sum(sales) AS DOUBLE), 0) * 100.0, 2), 0.0) AS profit_margin_pct
FROM feat)"""
CUST = """c AS (SELECT customer_id, count(DISTINCT order_id) AS orders, sum(sales) AS __s, sum(gross_profit) AS __p,
  avg(lead_time) AS avg_lead_time, count_if(delay_flag) AS delays,
  CAST(sum(sales) AS DOUBLE) AS total_sales, CAST(sum(gross_profit) AS DOUBLE) AS total_profit,
  coalesce(CAST(sum(gross_profit) AS DOUBLE) / nullif(CAST(sum(sales) AS DOUBLE), 0) * 100.0, 0.0) AS margin_pct,
  count(DISTINCT order_id) > 1 AS repeat_buyer
FROM feat WHERE customer_id IS NOT NULL GROUP BY customer_id)"""
PROD = """p AS (SELECT product_name, sum(sales) AS __s, CAST(sum(units) AS BIGINT) AS units_sold, count(order_id) AS orders,
  CAST(sum(sales) AS DOUBLE) AS total_sales, CAST(sum(gross_profit) AS DOUBLE) AS total_profit,
  round_even(CAST(sum(gross_profit) AS DOUBLE) / nullif(CAST(sum(sales) AS DOUBLE), 0) * 100.0, 1) AS margin_pct
FROM feat WHERE product_name IS NOT NULL GROUP BY product_name)"""
ABC = """abc AS (SELECT product_name, units_sold, orders, total_sales, total_profit, margin_pct, cum_sales, cum_pct,
  CASE WHEN cum_pct <= 70.0 THEN 'A (Core 70%)' WHEN cum_pct <= 90.0 THEN 'B (Secondary 20%)'
       WHEN cum_pct <= 100.0 THEN 'C (Long-Tail 10%)' END AS abc_class
FROM (SELECT p.*, CAST(cum AS DOUBLE) AS cum_sales,
        least(CAST(cum AS DOUBLE) / CAST((SELECT sum(__s) FROM p) AS DOUBLE) * 100.0, 100.0) AS cum_pct
      FROM (SELECT p.*, sum(__s) OVER (ORDER BY __s DESC, product_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM p) p))"""
ORD = """o AS (SELECT * FROM feat WHERE order_year = 1998 AND (
  coalesce(regexp_matches(lower(CAST(order_id AS VARCHAR)), 'ring'), false)
  OR coalesce(regexp_matches(lower(CAST(customer_id AS VARCHAR)), 'ring'), false)
  OR coalesce(regexp_matches(lower(city), 'ring'), false) OR coalesce(regexp_matches(lower(state), 'ring'), false)
  OR coalesce(regexp_matches(lower(product_name), 'ring'), false)
  OR coalesce(regexp_matches(lower(factory), 'ring'), false)) AND delay_flag = true)"""
FP = """fp AS (SELECT factory, count(row_id) AS shipments, round_even(avg(efficiency_score), 4) AS avg_efficiency_score
FROM feat WHERE factory IS NOT NULL GROUP BY factory)"""

SQL = {
    "rpt_division_split": over_feat("""SELECT division, count(row_id) AS shipments, CAST(sum(sales) AS DOUBLE) AS sales,
  round_even(count(row_id) / sum(count(row_id)) OVER () * 100.0, 2) AS shipments_share_pct
FROM feat WHERE division IS NOT NULL GROUP BY division"""),
    "rpt_region_split": over_feat("""SELECT region, count(row_id) AS shipments,
  round_even(count(row_id) / sum(count(row_id)) OVER () * 100.0, 2) AS shipments_share_pct
FROM feat WHERE region IS NOT NULL GROUP BY region"""),
    "rpt_period_label": over_feat("""SELECT ship_year, ship_month, ship_month_name, count(row_id) AS shipments,
  CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(gross_profit) AS DOUBLE) AS profit,
  round_even(avg(lead_time), 2) AS avg_lead_time, avg(CAST(delay_flag AS INTEGER)) AS delay_rate,
  round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct,
  CAST(ship_year AS VARCHAR) || '-' || lpad(CAST(ship_month AS VARCHAR), 2, '0') AS period
FROM feat WHERE ship_year IS NOT NULL GROUP BY ship_year, ship_month, ship_month_name"""),
    "rpt_health_index": over_feat("""SELECT health_score,
  CASE WHEN health_score >= 75 THEN 'good' WHEN health_score >= 50 THEN 'warn' ELSE 'bad' END AS health_band
FROM (SELECT greatest(0, least(100, CAST(trunc(100.0 - delay_rate_pct * 0.6 + profit_margin_pct * 0.2) AS INTEGER)))
      AS health_score FROM k)""", KPI_LITE),
    "rpt_gauge_band": over_feat("""SELECT on_time_rate_pct,
  CASE WHEN on_time_rate_pct >= 70.0 THEN 'good' WHEN on_time_rate_pct >= 40.0 THEN 'warn' ELSE 'bad' END AS gauge_band
FROM (SELECT round_even(100.0 - delay_rate_pct, 2) AS on_time_rate_pct FROM k)""", KPI_LITE),
    "rpt_worst_state_mode": over_feat("""SELECT * FROM
  (SELECT arg_min(state, (-p, state)) AS worst_state, round_even(max(p), 2) AS worst_state_pct FROM
     (SELECT state, avg(CAST(delay_flag AS INTEGER)) * 100.0 AS p FROM feat WHERE state IS NOT NULL GROUP BY state)),
  (SELECT arg_min(ship_mode, (-p, ship_mode)) AS highest_delay_mode, round_even(max(p), 2) AS mode_delay_pct FROM
     (SELECT ship_mode, avg(CAST(delay_flag AS INTEGER)) * 100.0 AS p FROM feat WHERE ship_mode IS NOT NULL GROUP BY ship_mode))"""),
    "rpt_profit_waterfall": over_feat("""SELECT 0 AS step, 'Gross Revenue' AS category, total_sales AS amount FROM k
UNION ALL SELECT 1, 'COGS & Mfg Cost', -total_cost FROM k
UNION ALL SELECT 2, 'Logistics Overhead', -(total_sales * 0.08) FROM k
UNION ALL SELECT 3, 'Net Retained Margin', total_sales - total_cost - total_sales * 0.08 FROM k""", KPI_LITE),
    "rpt_best_worst_factory": over_feat("""SELECT arg_min(factory, (-avg_efficiency_score, -shipments, factory)) AS best_factory,
  max(avg_efficiency_score) AS best_score,
  arg_min(factory, (avg_efficiency_score, -shipments, factory)) AS worst_factory, min(avg_efficiency_score) AS worst_score
FROM fp""", FP),
    "rpt_factory_deep_dive": over_feat(f"""SELECT '{FACTORY}' AS factory, count(*) AS shipments,
  round_even(avg(lead_time), 2) AS avg_lead_time, round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
FROM feat WHERE factory = '{FACTORY}'"""),
    "rpt_factory_product_mix": over_feat(f"""SELECT product_name, count(row_id) AS shipments, CAST(sum(sales) AS DOUBLE) AS sales
FROM feat WHERE factory = '{FACTORY}' AND product_name IS NOT NULL GROUP BY product_name"""),
    "rpt_factory_routes": over_feat(
        "SELECT * FROM frs ORDER BY avg_efficiency_score DESC NULLS LAST, route LIMIT 10",
        f"ff AS (SELECT * FROM feat WHERE factory = '{FACTORY}')",
        f"frs AS ({route_summary_sql('state', 'ff')})"),
    "rpt_factory_catalog": over_feat("""SELECT DISTINCT factory, product_name FROM (
  SELECT p.p_name AS product_name, arg_min(fd.factory, p.p_partkey) AS factory
  FROM part p JOIN factory_dim fd ON p.p_partkey = fd.product_id GROUP BY p.p_name) WHERE factory IS NOT NULL"""),
    "cust_summary": over_feat("SELECT * EXCLUDE (__s, __p) FROM c", CUST),
    "cust_cards": over_feat("""SELECT count(*) AS customers, count_if(repeat_buyer) AS repeat_customers,
  coalesce(round_even(count_if(repeat_buyer) / nullif(count(*), 0) * 100.0, 2), 0.0) AS repeat_pct,
  coalesce(round_even(CAST(sum(__s) AS DOUBLE) / count(*), 2), 0.0) AS avg_revenue_per_customer,
  round_even(CAST((SELECT sum(__s) FROM (SELECT __s FROM c ORDER BY __s DESC, customer_id LIMIT 10)) AS DOUBLE)
             / CAST(sum(__s) AS DOUBLE) * 100.0, 2) AS top10_share_pct
FROM c""", CUST),
    "cust_top": over_feat("""SELECT customer_id, orders, total_sales, total_profit, margin_pct, avg_lead_time, delays,
  repeat_buyer FROM c ORDER BY __s DESC, customer_id LIMIT 10""", CUST),
    "prod_detail": over_feat("""SELECT product_name, division, factory, CAST(sum(sales) AS DOUBLE) AS total_sales,
  CAST(sum(gross_profit) AS DOUBLE) AS total_profit, CAST(sum(units) AS BIGINT) AS units_sold,
  count(order_id) AS orders, avg(lead_time) AS avg_lead_time
FROM feat WHERE product_name IS NOT NULL AND division IS NOT NULL AND factory IS NOT NULL
GROUP BY product_name, division, factory"""),
    "prod_summary": over_feat("SELECT * EXCLUDE (__s) FROM p", PROD),
    "prod_abc": over_feat("SELECT * FROM abc", PROD, ABC),
    "prod_abc_counts": over_feat("SELECT abc_class AS class, count(*) AS count FROM abc GROUP BY abc_class", PROD, ABC),
    "prod_cards": over_feat("""SELECT count(*) AS skus, arg_min(product_name, (-__s, product_name)) AS top_sku,
  CAST(max(__s) AS DOUBLE) AS top_sku_sales,
  (SELECT count_if(abc_class = 'A (Core 70%)') FROM abc) AS a_items,
  (SELECT round_even(CAST(sum(gross_profit) AS DOUBLE) / nullif(CAST(sum(sales) AS DOUBLE), 0) * 100.0, 1) FROM feat)
    AS portfolio_margin_pct
FROM p""", PROD, ABC),
    "prod_treemap_rollup": over_feat("""SELECT r.division, r.product_name,
  CASE r.level_id WHEN 0 THEN 'leaf' WHEN 1 THEN 'branch' ELSE 'root' END AS level,
  CAST(r.v AS DOUBLE) AS value, CAST(pv AS DOUBLE) AS parent_value,
  round_even(CAST(r.v AS DOUBLE) / nullif(CAST(pv AS DOUBLE), 0) * 100.0, 4) AS pct_of_parent
FROM (SELECT r.*, CASE WHEN r.level_id = 0 THEN b.v WHEN r.level_id = 1 THEN (SELECT v FROM r0 WHERE level_id = 3) END AS pv
      FROM r0 r LEFT JOIN (SELECT division, v FROM r0 WHERE level_id = 1) b
        ON r.level_id = 0 AND r.division = b.division) r""",
        """r0 AS (SELECT division, product_name, sum(sales) AS v, grouping(division, product_name) AS level_id
FROM feat WHERE division IS NOT NULL AND product_name IS NOT NULL GROUP BY ROLLUP (division, product_name))"""),
    "ord_year_counts": over_feat("""SELECT order_year, count(*) AS rows FROM feat WHERE order_year IS NOT NULL
GROUP BY order_year"""),
    "ord_strip": over_feat("""SELECT count(*) AS records, CAST(sum(sales) AS DOUBLE) AS sales,
  CAST(sum(gross_profit) AS DOUBLE) AS profit, round_even(avg(lead_time), 2) AS avg_lead_time,
  round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct FROM o""", ORD),
    "ord_display": over_feat("""SELECT order_id, strftime(order_date, '%Y-%m-%d') AS order_date,
  strftime(ship_date, '%Y-%m-%d') AS ship_date, order_year AS year, ship_mode, customer_id, city, state, region,
  product_name, factory, division, CAST(sales AS DOUBLE) AS sales, units, CAST(gross_profit AS DOUBLE) AS profit,
  CAST(cost AS DOUBLE) AS cost, lead_time AS lead_days,
  CASE WHEN delay_flag THEN 'Delayed' WHEN NOT delay_flag THEN 'On Time' END AS status,
  round_even(efficiency_score, 3) AS efficiency, replace(state_route, '→', '->') AS route FROM o""", ORD),
    "ord_detail": over_feat(f"""SELECT row_id, order_id, product_name, units, CAST(sales AS DOUBLE) AS sales,
  CAST(gross_profit AS DOUBLE) AS gross_profit, CAST(cost AS DOUBLE) AS cost,
  (SELECT CAST(sum(sales) AS DOUBLE) FROM feat WHERE order_id = {ORDER}) AS order_total_sales,
  (SELECT CAST(sum(gross_profit) AS DOUBLE) FROM feat WHERE order_id = {ORDER}) AS order_total_profit
FROM feat WHERE order_id = {ORDER}"""),
}
