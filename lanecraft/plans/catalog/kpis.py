"""§2.4 KPI queries."""

from __future__ import annotations

from lanecraft.operators import kpi as K
from lanecraft.plans.catalog.common import feat
from lanecraft.plans.oracle_base import over_feat
from lanecraft.sources import testdata as td

QUERIES = {
    "kpi_summary": lambda s, d: K.summary(feat(s, d)),
    "kpi_factory_performance": lambda s, d: K.factory_performance(feat(s, d)),
    "kpi_route_performance": lambda s, d: K.route_performance(feat(s, d)),
    "kpi_ship_mode_performance": lambda s, d: K.ship_mode_performance(feat(s, d), td.ship_mode_order_dim(s)),
    "kpi_monthly_trend": lambda s, d: K.monthly_trend(feat(s, d)),
    "kpi_top_products": lambda s, d: K.top_products(feat(s, d), 10, "sales"),
    "kpi_bottom_products": lambda s, d: K.bottom_products(feat(s, d), 10, "sales"),
}

MARGIN = ("coalesce(round_even(CAST(sum(gross_profit) AS DOUBLE) / nullif(CAST(sum(sales) AS DOUBLE), 0) * 100.0, 2), 0.0)")
PRODUCTS = """pt AS (
  SELECT product_name, factory, count(row_id) AS shipments, CAST(sum(sales) AS DOUBLE) AS sales,
         CAST(sum(gross_profit) AS DOUBLE) AS profit, CAST(sum(units) AS BIGINT) AS units
  FROM feat WHERE product_name IS NOT NULL AND factory IS NOT NULL GROUP BY product_name, factory)"""

SQL = {
    "kpi_summary": over_feat(f"""SELECT
  count(*) AS total_shipments, CAST(sum(units) AS BIGINT) AS total_units,
  round_even(avg(units), 2) AS avg_units_per_order,
  CAST(round(sum(sales), 2) AS DOUBLE) AS total_sales, CAST(round(sum(gross_profit), 2) AS DOUBLE) AS total_profit,
  CAST(round(sum(cost), 2) AS DOUBLE) AS total_cost,
  round_even(CAST(sum(sales) AS DOUBLE) / count(sales), 2) AS avg_sales,
  round_even(CAST(sum(gross_profit) AS DOUBLE) / count(gross_profit), 2) AS avg_profit,
  round_even(CAST(sum(cost) AS DOUBLE) / count(cost), 2) AS avg_cost,
  {MARGIN} AS profit_margin_pct,
  round_even(avg(lead_time), 2) AS avg_lead_time, round_even(median(lead_time), 2) AS median_lead_time,
  min(lead_time) AS min_lead_time, max(lead_time) AS max_lead_time,
  coalesce(round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2), 0.0) AS delay_rate_pct,
  count_if(delay_flag) AS total_delayed,
  round_even(100.0 - coalesce(round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2), 0.0), 2) AS on_time_rate_pct,
  count(DISTINCT order_id) AS total_orders, count(DISTINCT state) AS unique_states,
  count(DISTINCT state_route) AS unique_routes
FROM feat"""),
    "kpi_factory_performance": over_feat(f"""SELECT factory, count(row_id) AS shipments,
  CAST(sum(sales) AS DOUBLE) AS total_sales, CAST(sum(gross_profit) AS DOUBLE) AS total_profit,
  CAST(sum(units) AS BIGINT) AS total_units, round_even(avg(lead_time), 2) AS avg_lead_time,
  round_even(median(lead_time), 2) AS median_lead_time, avg(CAST(delay_flag AS INTEGER)) AS delay_rate,
  round_even(avg(efficiency_score), 4) AS avg_efficiency_score, {MARGIN} AS profit_margin_pct,
  round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
FROM feat WHERE factory IS NOT NULL GROUP BY factory"""),
    "kpi_route_performance": over_feat("""SELECT state_route AS route, count(row_id) AS shipments,
  CAST(sum(sales) AS DOUBLE) AS total_sales, CAST(sum(gross_profit) AS DOUBLE) AS total_profit,
  round_even(avg(lead_time), 2) AS avg_lead_time, round_even(median(lead_time), 2) AS median_lead_time,
  round_even(stddev_samp(lead_time), 2) AS std_lead_time, min(lead_time) AS min_lead_time,
  max(lead_time) AS max_lead_time, avg(CAST(delay_flag AS INTEGER)) AS delay_rate,
  round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct,
  round_even(coalesce(stddev_samp(lead_time) / nullif(avg(lead_time), 0), 0.0), 4) AS lead_time_cv,
  round_even(avg(efficiency_score), 2) AS avg_efficiency_score,
  CAST(rank() OVER (ORDER BY round_even(avg(efficiency_score), 2) DESC NULLS LAST) AS INTEGER) AS rank
FROM feat WHERE state_route IS NOT NULL GROUP BY state_route"""),
    "kpi_ship_mode_performance": over_feat("""SELECT a.*, coalesce(mo.mode_order, 99) AS mode_order FROM (
  SELECT ship_mode, count(row_id) AS shipments, CAST(sum(sales) AS DOUBLE) AS total_sales,
    CAST(sum(gross_profit) AS DOUBLE) AS total_profit, CAST(sum(units) AS BIGINT) AS total_units,
    round_even(avg(lead_time), 2) AS avg_lead_time, median(lead_time) AS median_lead_time,
    avg(CAST(delay_flag AS INTEGER)) AS delay_rate, CAST(sum(cost) AS DOUBLE) / count(cost) AS avg_cost,
    round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct,
    round_even(CAST(sum(gross_profit) AS DOUBLE) / count(row_id), 2) AS profit_per_shipment
  FROM feat WHERE ship_mode IS NOT NULL GROUP BY ship_mode) a
LEFT JOIN mode_order mo ON a.ship_mode = mo.ship_mode"""),
    "kpi_monthly_trend": over_feat("""SELECT ship_year, ship_month, ship_month_name, count(row_id) AS shipments,
  CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(gross_profit) AS DOUBLE) AS profit,
  round_even(avg(lead_time), 2) AS avg_lead_time, avg(CAST(delay_flag AS INTEGER)) AS delay_rate,
  round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
FROM feat WHERE ship_year IS NOT NULL GROUP BY ship_year, ship_month, ship_month_name"""),
    "kpi_top_products": over_feat("SELECT * FROM pt ORDER BY sales DESC, product_name, factory LIMIT 10", PRODUCTS),
    "kpi_bottom_products": over_feat("SELECT * FROM pt ORDER BY sales ASC, product_name, factory LIMIT 10", PRODUCTS),
}
