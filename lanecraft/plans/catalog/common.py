"""Shared inputs of the registered queries."""

from __future__ import annotations

from lanecraft.plans import featured as FT


def feat(spark, sf_dir):
    return FT.featured(spark, sf_dir)


def route_summary_sql(level: str = "state", src: str = "feat", rank: bool = True) -> str:
    route, dest = ("state_route", "state") if level == "state" else ("region_route", "region")
    rk = (",\n  CASE WHEN round_even(avg(efficiency_score), 2) IS NOT NULL THEN CAST(rank() OVER "
          "(ORDER BY round_even(avg(efficiency_score), 2) DESC NULLS LAST) AS INTEGER) END AS rank") if rank else ""
    return f"""SELECT {route} AS route, factory, {dest} AS destination,
  count(row_id) AS shipments,
  CAST(round(sum(sales), 2) AS DOUBLE) AS total_sales,
  CAST(round(sum(gross_profit), 2) AS DOUBLE) AS total_profit,
  CAST(sum(units) AS BIGINT) AS total_units,
  round_even(avg(lead_time), 2) AS avg_lead_time,
  round_even(median(lead_time), 2) AS median_lead_time,
  round_even(stddev_samp(lead_time), 2) AS std_lead_time,
  min(lead_time) AS min_lead_time, max(lead_time) AS max_lead_time,
  avg(CAST(delay_flag AS INTEGER)) AS delay_rate,
  round_even(avg(CAST(delay_flag AS INTEGER)) * 100.0, 2) AS delay_rate_pct,
  round_even(coalesce(stddev_samp(lead_time) / nullif(avg(lead_time), 0), 0.0), 2) AS lead_time_cv,
  round_even(avg(efficiency_score), 2) AS avg_efficiency_score{rk}
FROM {src}
WHERE {route} IS NOT NULL AND factory IS NOT NULL AND {dest} IS NOT NULL
GROUP BY {route}, factory, {dest}"""


def rs_cte(level: str = "state", name: str = "rs", src: str = "feat") -> str:
    return f"{name} AS ({route_summary_sql(level, src)})"
