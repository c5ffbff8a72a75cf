"""§2.10 time-series queries."""

from __future__ import annotations

from lanecraft import schema as S
from lanecraft.operators import series as TS
from lanecraft.plans.catalog.common import feat
from lanecraft.plans.oracle_base import DIMS, FACT, FEAT, with_ctes_recursive


def _monthly(s, d):
    return TS.monthly(feat(s, d))


def _state(s, d, col="orders"):
    return TS.holt_state(_monthly(s, d), col)


CFG = S.default_config()
Z_CFG = TS.z_for(CFG["forecast_settings"]["confidence_level"])
H_CFG = CFG["forecast_settings"]["default_horizon_months"]

QUERIES = {
    "ts_monthly": _monthly,
    "ts_holt_state": lambda s, d: _state(s, d).select("points", "last_period", "level", "trend"),
    "ts_forecast": lambda s, d: TS.forecast(_state(s, d), 6, TS.Z95),
    "ts_forecast_cfg": lambda s, d: TS.forecast_from_config(_state(s, d, "sales"), CFG),
}

MONTHLY = """mon AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS period, count(order_id) AS orders,
  CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(gross_profit) AS DOUBLE) AS profit, avg(lead_time) AS avg_lead_time
FROM feat WHERE order_date IS NOT NULL GROUP BY 1)"""


def holt_ctes(col: str) -> list[str]:
    return [
        MONTHLY,
        f"pts AS (SELECT period, CAST({col} AS DOUBLE) AS x, row_number() OVER (ORDER BY period) AS i FROM mon)",
        """hs AS (SELECT count(*) AS points, max(period) AS last_period, stddev_pop(x) AS std_pop FROM pts)""",
        """h(i, level, trend) AS (
  SELECT 1, (SELECT x FROM pts WHERE i = 1), (SELECT x FROM pts WHERE i = 2) - (SELECT x FROM pts WHERE i = 1)
  UNION ALL
  SELECT h.i + 1,
    0.4::DOUBLE * p.x + (1.0::DOUBLE - 0.4::DOUBLE) * (h.level + h.trend),
    0.2::DOUBLE * ((0.4::DOUBLE * p.x + (1.0::DOUBLE - 0.4::DOUBLE) * (h.level + h.trend)) - h.level)
      + (1.0::DOUBLE - 0.2::DOUBLE) * h.trend
  FROM h JOIN pts p ON p.i = h.i + 1
)""",
        "st AS (SELECT hs.*, h.level, h.trend FROM hs, h WHERE h.i = hs.points AND hs.points > 3)",
    ]


def forecast_sql(col: str, horizon: int, z: float) -> str:
    return with_ctes_recursive(FACT, DIMS, FEAT, *holt_ctes(col)) + f"""SELECT k AS step,
  CAST(last_period + to_months(CAST(k AS INTEGER)) AS DATE) AS period,
  round_even(greatest(0.0::DOUBLE, level + k * trend), 4) AS forecast,
  round_even(greatest(0.0::DOUBLE, level + k * trend) + {z!r}::DOUBLE * (std_pop * 0.4::DOUBLE) * sqrt(CAST(k AS DOUBLE)), 4) AS upper,
  round_even(greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, level + k * trend) - {z!r}::DOUBLE * (std_pop * 0.4::DOUBLE) * sqrt(CAST(k AS DOUBLE))), 4) AS lower
FROM st, range(1, {horizon + 1}) t(k)"""


SQL = {
    "ts_monthly": with_ctes_recursive(FACT, DIMS, FEAT, MONTHLY) + "SELECT * FROM mon",
    "ts_holt_state": with_ctes_recursive(FACT, DIMS, FEAT, *holt_ctes("orders"))
                     + "SELECT points, last_period, level, trend FROM st",
    "ts_forecast": forecast_sql("orders", 6, TS.Z95),
    "ts_forecast_cfg": forecast_sql("sales", H_CFG, Z_CFG),
}
