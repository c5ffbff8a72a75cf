"""§2.5 route queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanecraft.operators import route as R
from lanecraft.plans.catalog.common import feat, route_summary_sql, rs_cte
from lanecraft.plans.oracle_base import over_feat


def _rs(spark, sf_dir, level="state"):
    return R.route_summary(feat(spark, sf_dir), level)


QUERIES = {
    "route_summary_state": lambda s, d: _rs(s, d, "state"),
    "route_summary_region": lambda s, d: _rs(s, d, "region"),
    "route_top": lambda s, d: R.top_routes(_rs(s, d), 10),
    "route_worst": lambda s, d: R.worst_routes(_rs(s, d), 10),
    "route_most_consistent": lambda s, d: R.most_consistent_routes(_rs(s, d), 10, 5),
    "route_most_variable": lambda s, d: R.most_variable_routes(_rs(s, d), 10, 5),
    "route_high_volume": lambda s, d: R.high_volume_routes(_rs(s, d), 10),
    "route_heatmap": lambda s, d: R.route_heatmap(_rs(s, d), "avg_lead_time"),
    "route_delay_breakdown": lambda s, d: R.route_delay_breakdown(feat(s, d), "state"),
    "route_bottlenecks": lambda s, d: R.bottleneck_routes(_rs(s, d), 50.0, 10),
    "route_leaderboard_band": lambda s, d: R.route_leaderboard(_rs(s, d), 10),
    "route_cards": lambda s, d: R.route_cards(_rs(s, d)),
    "route_slowest": lambda s, d: R.slowest_routes(_rs(s, d), 3),
    "route_fastest": lambda s, d: R.fastest_routes(_rs(s, d), 3),
}

_RS = rs_cte("state")

SQL = {
    "route_summary_state": over_feat(route_summary_sql("state")),
    "route_summary_region": over_feat(route_summary_sql("region")),
    "route_top": over_feat("SELECT * FROM rs ORDER BY avg_efficiency_score DESC NULLS LAST, route LIMIT 10", _RS),
    "route_worst": over_feat("SELECT * FROM rs ORDER BY avg_efficiency_score ASC NULLS FIRST, route DESC LIMIT 10", _RS),
    "route_most_consistent": over_feat(
        "SELECT * FROM rs WHERE shipments >= 5 ORDER BY lead_time_cv ASC, route LIMIT 10", _RS),
    "route_most_variable": over_feat(
        "SELECT * FROM rs WHERE shipments >= 5 ORDER BY lead_time_cv DESC, route LIMIT 10", _RS),
    "route_high_volume": over_feat("SELECT * FROM rs ORDER BY shipments DESC, route LIMIT 10", _RS),
    "route_delay_breakdown": over_feat(
        """SELECT state_route AS route, count_if(delay_flag) AS delayed, count_if(NOT delay_flag) AS on_time,
  count_if(delay_flag) + count_if(NOT delay_flag) AS total
FROM feat WHERE state_route IS NOT NULL AND delay_flag IS NOT NULL GROUP BY state_route"""),
    "route_bottlenecks": over_feat(
        "SELECT * FROM rs WHERE delay_rate_pct >= 50.0 AND shipments >= 10", _RS),
    "route_leaderboard_band": over_feat(
        """SELECT route, avg_efficiency_score,
  CASE WHEN avg_efficiency_score >= 0.6 THEN 'good' WHEN avg_efficiency_score >= 0.4 THEN 'warn' ELSE 'bad' END AS band
FROM (SELECT * FROM rs ORDER BY avg_efficiency_score DESC, route LIMIT 10)""", _RS),
    "route_cards": over_feat(
        """SELECT count(route) AS routes, round_even(avg(avg_efficiency_score), 4) AS mean_route_score,
  round_even(avg(delay_rate_pct), 2) AS mean_route_delay_pct, round_even(avg(avg_lead_time), 2) AS mean_route_lead_time
FROM rs""", _RS),
    "route_slowest": over_feat("SELECT * FROM rs ORDER BY avg_lead_time DESC, route LIMIT 3", _RS),
    "route_fastest": over_feat("SELECT * FROM rs ORDER BY avg_lead_time ASC, route LIMIT 3", _RS),
}


# The heat-map oracle needs the destination names as columns; DuckDB's PIVOT
# produces them from the data with the same names.
SQL["route_heatmap"] = over_feat("""SELECT f.factory, t.destination, coalesce(c.v, 0.0) AS avg_lead_time
FROM (SELECT DISTINCT factory FROM rs) f CROSS JOIN (SELECT DISTINCT destination FROM rs) t
LEFT JOIN (SELECT factory, destination, avg(avg_lead_time) AS v FROM rs GROUP BY factory, destination) c
  ON f.factory = c.factory AND t.destination = c.destination""", _RS)
