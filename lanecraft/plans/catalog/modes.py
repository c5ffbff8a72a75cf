"""§2.7 ship-mode queries."""

from __future__ import annotations

from lanecraft.operators import mode as M
from lanecraft.plans.catalog.common import feat
from lanecraft.plans.oracle_base import over_feat
from lanecraft.sources import testdata as td


def _ms(s, d):
    return M.mode_summary(feat(s, d), td.ship_mode_order_dim(s))


def _otd(s, d):
    return M.on_time_vs_delayed(feat(s, d), td.ship_mode_order_dim(s))


QUERIES = {
    "mode_summary": _ms,
    "mode_lead_distribution": lambda s, d: M.lead_distribution(feat(s, d)),
    "mode_box_stats": lambda s, d: M.box_stats(feat(s, d)),
    "mode_monthly_trend": lambda s, d: M.monthly_mode_trend(feat(s, d)),
    "mode_factory_breakdown": lambda s, d: M.mode_pivot(feat(s, d), "factory", td.TEST_SHIP_MODES),
    "mode_region_breakdown": lambda s, d: M.mode_pivot(feat(s, d), "region", td.TEST_SHIP_MODES),
    "mode_cost_time_tradeoff": lambda s, d: M.cost_time_tradeoff(_ms(s, d)),
    "mode_region_delay": lambda s, d: M.delay_by_mode_region(feat(s, d)),
    "mode_on_time_vs_delayed": _otd,
    "mode_status_unpivot": lambda s, d: M.status_long(_otd(s, d)),
    "mode_best_worst": lambda s, d: M.best_worst_mode(_ms(s, d)),
}

MS = """ms AS (
  SELECT a.* EXCLUDE (__sales, __profit), coalesce(mo.mode_order, 99) AS mode_order,
    CAST(__sales AS DOUBLE) AS total_sales, CAST(__profit AS DOUBLE) AS total_profit,
    round_even(CAST(__profit AS DOUBLE) / shipments, 2) AS profit_per_shipment,
    round_even(CAST(__sales AS DOUBLE) / shipments, 2) AS sales_per_shipment,
    coalesce(round_even(CAST(__profit AS DOUBLE) / nullif(CAST(__sales AS DOUBLE), 0) * 100.0, 2), 0.0) AS profit_margin_pct,
    round_even(shipments / sum(shipments) OVER () * 100.0, 2) AS volume_share_pct,
    round_even(CAST(__sales AS DOUBLE) / CAST(sum(__sales) OVER () AS DOUBLE) * 100.0, 2) AS sales_share_pct
  FROM (
    SELECT ship_mode, count(row_id) AS shipments, sum(sales) AS __sales, sum(gross_profit) AS __profit,
      CAST(sum(units) AS BIGINT) AS total_units, round_even(avg(lead_time), 2) AS avg_lead_time,
      round_even(median(lead_time), 2) AS median_lead_time, round_even(stddev_samp(lead_time), 2) AS std_lead_time,
      min(lead_time) AS min_lead_time, max(lead_time) AS max_lead_time,
      avg(CAST(delay_flag AS INTEGER)) AS delay_rate,
      round_even(CAST(sum(cost) AS DOUBLE) / count(cost), 2) AS avg_cost,
      CAST(round(sum(cost), 2) AS DOUBLE) AS total_cost,
      round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
    FROM feat WHERE ship_mode IS NOT NULL GROUP BY ship_mode) a
  LEFT JOIN mode_order mo ON a.ship_mode = mo.ship_mode)"""
OTD = """otd AS (
  SELECT a.*, coalesce(mo.mode_order, 99) AS mode_order FROM (
    SELECT ship_mode, count_if(NOT delay_flag) AS on_time, count_if(delay_flag) AS delayed,
      count_if(NOT delay_flag) + count_if(delay_flag) AS total
    FROM feat WHERE ship_mode IS NOT NULL AND delay_flag IS NOT NULL GROUP BY ship_mode) a
  LEFT JOIN mode_order mo ON a.ship_mode = mo.ship_mode)"""


def _pivot_sql(row: str) -> str:
    cols = ",\n  ".join(f"count(row_id) FILTER (WHERE ship_mode = '{m}') AS \"{m}\"" for m in td.TEST_SHIP_MODES)
    names = ", ".join(f"'{m}'" for m in td.TEST_SHIP_MODES)
    cols += f",\n  count(row_id) FILTER (WHERE ship_mode NOT IN ({names})) AS other"
    return over_feat(f"SELECT {row},\n  {cols}\nFROM feat WHERE {row} IS NOT NULL GROUP BY {row}")


SQL = {
    "mode_summary": over_feat("SELECT * FROM ms", MS),
    "mode_lead_distribution": over_feat("SELECT ship_mode, lead_time FROM feat"),
    "mode_box_stats": over_feat("""SELECT q.*, w.whisker_low, w.whisker_high, w.outliers FROM q JOIN (
  SELECT d.ship_mode, min(CASE WHEN inside THEN lead_time END) AS whisker_low,
    max(CASE WHEN inside THEN lead_time END) AS whisker_high, count_if(NOT inside) AS outliers
  FROM (SELECT f.ship_mode, f.lead_time, f.lead_time >= q.lower_fence AND f.lead_time <= q.upper_fence AS inside
        FROM feat f JOIN q ON f.ship_mode = q.ship_mode WHERE f.lead_time IS NOT NULL) d
  GROUP BY d.ship_mode) w ON q.ship_mode = w.ship_mode""",
        """q AS (SELECT ship_mode, n, q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
  q3 + 1.5 * (q3 - q1) AS upper_fence FROM (
  SELECT ship_mode, count(lead_time) AS n, quantile_cont(lead_time, 0.25) AS q1,
    quantile_cont(lead_time, 0.5) AS median, quantile_cont(lead_time, 0.75) AS q3
  FROM feat WHERE ship_mode IS NOT NULL AND lead_time IS NOT NULL GROUP BY ship_mode))"""),
    "mode_monthly_trend": over_feat("""SELECT ship_year, ship_month, ship_mode, count(row_id) AS shipments,
  CAST(sum(sales) AS DOUBLE) AS total_sales, round_even(avg(lead_time), 2) AS avg_lead_time,
  avg(CAST(delay_flag AS INTEGER)) AS delay_rate, round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
FROM feat WHERE ship_year IS NOT NULL AND ship_mode IS NOT NULL GROUP BY ship_year, ship_month, ship_mode"""),
    "mode_factory_breakdown": _pivot_sql("factory"),
    "mode_region_breakdown": _pivot_sql("region"),
    "mode_cost_time_tradeoff": over_feat("""SELECT ship_mode, avg_cost, avg_lead_time, delay_rate_pct, profit_margin_pct,
  shipments, volume_share_pct, sales_share_pct, mode_order FROM ms""", MS),
    "mode_region_delay": over_feat("""SELECT ship_mode, region, count(row_id) AS shipments,
  avg(CAST(delay_flag AS INTEGER)) AS delay_rate, round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
FROM feat WHERE ship_mode IS NOT NULL AND region IS NOT NULL GROUP BY ship_mode, region"""),
    "mode_on_time_vs_delayed": over_feat("SELECT * FROM otd", OTD),
    "mode_status_unpivot": over_feat("""SELECT ship_mode, 'On Time' AS status, on_time AS count FROM otd
UNION ALL SELECT ship_mode, 'Delayed' AS status, delayed AS count FROM otd""", OTD),
    "mode_best_worst": over_feat("""SELECT arg_min(ship_mode, (delay_rate_pct, mode_order)) AS best_mode,
  min(delay_rate_pct) AS best_delay_rate_pct,
  arg_min(ship_mode, (-delay_rate_pct, mode_order)) AS worst_mode, max(delay_rate_pct) AS worst_delay_rate_pct
FROM ms""", MS),
}
