"""Canonical column names, the raw schema, and default business configuration.

The library works on one flat shipment table.  Column names are snake_case so
they survive SQL, Parquet and CSV without quoting.
"""

from __future__ import annotations

import copy

from pyspark.sql import types as T

# ── raw (cleaned) shipment columns, one row per order line ────────────────────
ROW_ID = "row_id"
ORDER_ID = "order_id"
ORDER_DATE = "order_date"
SHIP_DATE = "ship_date"
SHIP_MODE = "ship_mode"
CUSTOMER_ID = "customer_id"
COUNTRY = "country"
CITY = "city"
STATE = "state"
POSTAL_CODE = "postal_code"
DIVISION = "division"
REGION = "region"
PRODUCT_ID = "product_id"
PRODUCT_NAME = "product_name"
SALES = "sales"
UNITS = "units"
GROSS_PROFIT = "gross_profit"
COST = "cost"

BASE_COLUMNS = [ROW_ID, ORDER_ID, ORDER_DATE, SHIP_DATE, SHIP_MODE, CUSTOMER_ID, COUNTRY, CITY, STATE,
                POSTAL_CODE, DIVISION, REGION, PRODUCT_ID, PRODUCT_NAME, SALES, UNITS, GROSS_PROFIT, COST]

# ── derived (featured) columns ────────────────────────────────────────────────
FACTORY = "factory"
FACTORY_LAT = "factory_lat"
FACTORY_LON = "factory_lon"
LEAD_TIME = "lead_time"
DELAY_FLAG = "delay_flag"
STATE_ROUTE = "state_route"
REGION_ROUTE = "region_route"
ROUTE_ID = "route_id"
SCORE = "efficiency_score"

MONEY = T.DecimalType(18, 4)

#: All-string raw schema as it arrives in CSV (dates as text, money with symbols).
RAW_STRING_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in BASE_COLUMNS])

#: Typed schema of the cleaned table.
TYPED_SCHEMA = T.StructType([
    T.StructField(ROW_ID, T.StringType()), T.StructField(ORDER_ID, T.LongType()),
    T.StructField(ORDER_DATE, T.DateType()), T.StructField(SHIP_DATE, T.DateType()),
    T.StructField(SHIP_MODE, T.StringType()), T.StructField(CUSTOMER_ID, T.LongType()),
    T.StructField(COUNTRY, T.StringType()), T.StructField(CITY, T.StringType()),
    T.StructField(STATE, T.StringType()), T.StructField(POSTAL_CODE, T.StringType()),
    T.StructField(DIVISION, T.StringType()), T.StructField(REGION, T.StringType()),
    T.StructField(PRODUCT_ID, T.LongType()), T.StructField(PRODUCT_NAME, T.StringType()),
    T.StructField(SALES, MONEY), T.StructField(UNITS, T.IntegerType()),
    T.StructField(GROSS_PROFIT, MONEY), T.StructField(COST, MONEY),
])

CATEGORICAL_COLUMNS = [SHIP_MODE, COUNTRY, CITY, STATE, DIVISION, REGION, PRODUCT_NAME, CUSTOMER_ID]
TRIM_COLUMNS = [SHIP_MODE, COUNTRY, CITY, STATE, DIVISION, REGION, PRODUCT_NAME]

# Fixed values that must equal the reference's for the same results.
# Label given to products with no factory, fallback factory coordinates,
# default SLA threshold for an unseen mode, the auto-policy switch point,
# efficiency weights, and the unknown-category filler.
UNKNOWN_FACTORY = "Unknown Factory"
DEFAULT_COORDS = (39.5, -98.35)
DEFAULT_SLA_DAYS = 4.0
AUTO_POLICY_MEDIAN_DAYS = 50.0
DELAY_WEIGHT = 0.6
LEAD_TIME_WEIGHT = 0.4
UNKNOWN = "Unknown"
ROUTE_ARROW = " → "
MIN_LEAD_DAYS = 0.5

# SLA days per ship mode, and what repairs fill in (a plant for unmapped products, a mode).
# Product → factory maps and factory coordinates are configuration (user data), passed as dimension tables.
DEFAULT_SLA = {"Standard Class": 5.0, "Second Class": 3.0, "First Class": 2.0, "Same Day": 1.0}
REPAIR_FACTORY = "Secret Factory"
REPAIR_SHIP_MODE = "Standard Class"

DEFAULT_CONFIG = {
    "sla_thresholds_days": dict(DEFAULT_SLA),
    "efficiency_weights": {"delay_weight": DELAY_WEIGHT, "lead_time_weight": LEAD_TIME_WEIGHT},
    "alert_thresholds": {"bottleneck_delay_rate_pct": 50.0, "min_shipments_for_evaluation": 5,
                         "lead_time_outlier_days": 10.0},
    "kpi_targets": {"target_delay_rate_pct": 25.0, "target_avg_lead_time_days": 3.5,
                    "target_efficiency_score": 0.75},
    "ml_settings": {"random_forest_estimators": 100, "test_size": 0.2, "random_state": 42},
    "repair_defaults": {"factory": REPAIR_FACTORY, "ship_mode": REPAIR_SHIP_MODE},
    "forecast_settings": {"default_horizon_months": 6, "confidence_level": 0.95},
}


def default_config() -> dict:
    return copy.deepcopy(DEFAULT_CONFIG)

# ── fixed values: texts that a raw CSV read takes as missing (pandas' defaults) ──
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
            "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
