"""§2.6 geography queries."""

from __future__ import annotations

from lanecraft.operators import geo as G
from lanecraft.plans.catalog.common import feat
from lanecraft.plans.oracle_base import over_feat
from lanecraft.sources import testdata as td


def _us(s, d):
    return G.us_scope(feat(s, d), td.domestic_states(s, d))


def _sp(s, d):
    return G.state_performance(_us(s, d), td.state_dim(s, d))


def _rp(s, d):
    return G.region_performance(feat(s, d))


def _cov(s, d):
    return G.factory_coverage(feat(s, d), td.factory_coords_dim(s))


QUERIES = {
    "geo_us_scope": _us,
    "geo_state_performance": _sp,
    "geo_region_performance": _rp,
    "geo_factory_coverage": _cov,
    "geo_shipping_density": lambda s, d: G.shipping_density(_sp(s, d), 20),
    "geo_bottleneck_states": lambda s, d: G.bottleneck_states(_sp(s, d), 50.0, 10),
    "geo_high_delay_regions": lambda s, d: G.high_delay_regions(_rp(s, d), 45.0),
    "geo_route_lines": lambda s, d: G.route_lines(_us(s, d), td.state_dim(s, d), 5),
    "geo_line_band": lambda s, d: G.line_band(G.route_lines(_us(s, d), td.state_dim(s, d), 5)),
    "geo_map_scope": lambda s, d: G.map_scope(_sp(s, d)),
    "geo_cards": lambda s, d: G.geo_cards(_sp(s, d), _cov(s, d)),
    "geo_sankey_links": lambda s, d: G.sankey_links(feat(s, d)),
}

US = "us AS (SELECT * FROM feat WHERE state IN (SELECT state FROM domestic))"
MARGIN = ("coalesce(round_even(CAST(sum(gross_profit) AS DOUBLE) / nullif(CAST(sum(sales) AS DOUBLE), 0) * 100.0, 2), 0.0)")
SP = f"""sp AS (
  SELECT a.*, sd.state_abbrev, sd.state_lat AS lat, sd.state_lon AS lon FROM (
    SELECT state, count(row_id) AS shipments, CAST(sum(sales) AS DOUBLE) AS total_sales,
      CAST(sum(gross_profit) AS DOUBLE) AS total_profit, CAST(sum(units) AS BIGINT) AS total_units,
      round_even(avg(lead_time), 2) AS avg_lead_time, median(lead_time) AS median_lead_time,
      avg(CAST(delay_flag AS INTEGER)) AS delay_rate, round_even(avg(efficiency_score), 4) AS avg_efficiency_score,
      {MARGIN} AS profit_margin_pct, round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
    FROM us WHERE state IS NOT NULL GROUP BY state) a
  LEFT JOIN state_dim sd ON a.state = sd.state)"""
RP = f"""rp AS (
  SELECT region, count(row_id) AS shipments, CAST(sum(sales) AS DOUBLE) AS total_sales,
    CAST(sum(gross_profit) AS DOUBLE) AS total_profit, CAST(sum(units) AS BIGINT) AS total_units,
    round_even(avg(lead_time), 2) AS avg_lead_time, median(lead_time) AS median_lead_time,
    avg(CAST(delay_flag AS INTEGER)) AS delay_rate, count(DISTINCT state) AS unique_states,
    round_even(avg(efficiency_score), 4) AS avg_efficiency_score, {MARGIN} AS profit_margin_pct,
    round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
  FROM feat WHERE region IS NOT NULL GROUP BY region)"""
COV = """cov AS (
  SELECT a.*, c.factory_lat AS lat, c.factory_lon AS lon FROM (
    SELECT factory, count(row_id) AS shipments, count(DISTINCT state) AS states_served,
      count(DISTINCT region) AS regions_served, CAST(sum(sales) AS DOUBLE) AS total_sales,
      round_even(avg(lead_time), 2) AS avg_lead_time, avg(CAST(delay_flag AS INTEGER)) AS delay_rate,
      round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
    FROM feat WHERE factory IS NOT NULL GROUP BY factory) a
  LEFT JOIN coords c ON a.factory = c.factory)"""
LINES = """lines AS (
  SELECT a.*, sd.state_lat, sd.state_lon FROM (
    SELECT factory, state, factory_lat, factory_lon, count(row_id) AS shipments,
      round_even(avg(lead_time), 2) AS avg_lead_time, avg(CAST(delay_flag AS INTEGER)) AS delay_rate,
      round_even(avg(efficiency_score), 4) AS avg_efficiency_score,
      round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct
    FROM us WHERE factory IS NOT NULL AND state IS NOT NULL AND factory_lat IS NOT NULL AND factory_lon IS NOT NULL
    GROUP BY factory, state, factory_lat, factory_lon HAVING count(row_id) >= 5) a
  JOIN state_dim sd ON a.state = sd.state WHERE sd.state_lat IS NOT NULL AND sd.state_lon IS NOT NULL)"""

SQL = {
    "geo_us_scope": over_feat("SELECT * FROM us", US),
    "geo_state_performance": over_feat("SELECT * FROM sp", US, SP),
    "geo_region_performance": over_feat("SELECT * FROM rp", RP),
    "geo_factory_coverage": over_feat("SELECT * FROM cov", COV),
    "geo_shipping_density": over_feat("SELECT * FROM sp ORDER BY shipments DESC, state LIMIT 20", US, SP),
    "geo_bottleneck_states": over_feat("SELECT * FROM sp WHERE delay_rate_pct >= 50.0 AND shipments >= 10", US, SP),
    "geo_high_delay_regions": over_feat("SELECT * FROM rp WHERE delay_rate_pct >= 45.0", RP),
    "geo_route_lines": over_feat("SELECT * FROM lines", US, LINES),
    "geo_line_band": over_feat("""SELECT factory, state, avg_efficiency_score,
  CASE WHEN coalesce(avg_efficiency_score, 0.5) >= 0.5 THEN 'good' ELSE 'bad' END AS line_class,
  round_even(CASE WHEN coalesce(avg_efficiency_score, 0.5) >= 0.5 THEN 0.3 + coalesce(avg_efficiency_score, 0.5) * 0.5
             ELSE 0.3 + (1 - coalesce(avg_efficiency_score, 0.5)) * 0.5 END, 4) AS opacity
FROM lines""", US, LINES),
    "geo_map_scope": over_feat("SELECT * FROM sp WHERE state_abbrev IS NOT NULL", US, SP),
    "geo_cards": over_feat("""SELECT count(state) AS states, max(shipments) AS peak_state_volume,
  round_even(avg(delay_rate_pct), 2) AS mean_state_delay_pct,
  arg_min(state, (-shipments, state)) AS top_volume_state,
  arg_min(state, (-delay_rate_pct, state)) AS worst_delay_state,
  (SELECT max(states_served) FROM cov) AS peak_states_served
FROM sp""", US, SP, COV),
    "geo_sankey_links": over_feat("""SELECT g.source, g.target, g.value, s.node_id AS source_id, t.node_id AS target_id
FROM g JOIN nodes s ON g.source = s.node JOIN nodes t ON g.target = t.node""",
        """g AS (SELECT factory AS source, region AS target, CAST(sum(sales) AS DOUBLE) AS value FROM feat
  WHERE factory IS NOT NULL AND region IS NOT NULL GROUP BY factory, region)""",
        """nodes AS (SELECT node, row_number() OVER (ORDER BY side, node) - 1 AS node_id FROM (
  SELECT node, min(side) AS side FROM (SELECT source AS node, 0 AS side FROM g UNION ALL
                                       SELECT target AS node, 1 AS side FROM g) GROUP BY node))"""),
}
