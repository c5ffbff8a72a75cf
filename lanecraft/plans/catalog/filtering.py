"""§2.8 filter / search / facet queries (fixed parameters)."""

from __future__ import annotations

from lanecraft.operators import filters as FL
from lanecraft.plans.catalog.common import feat
from lanecraft.plans.oracle_base import over_feat
from lanecraft.sources import testdata as td

SEARCH = "steel ring|^77"
APPLY = {"years": [1997, 1998, 1999], "months": [1, 2, 3, 4, 5, 6], "factories": ["Factory#1", "Factory#2"],
         "ship_modes": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "lead_time_range": (100, 1500)}
PRESETS = {
    "Default (All Data)": {},
    "Delayed Orders Only": {"delay_only": True},
    "Year 1998 Scope": {"years": [1998]},
    "Express Modes": {"ship_modes": ["2-HIGH", "1-URGENT"]},
    "Factory#0 Only": {"factories": ["Factory#0"]},
}
SINGLE = {
    "flt_search": {"search_text": SEARCH},
    "flt_years": {"years": [1996, 1998]},
    "flt_months": {"months": [1, 2, 3]},
    "flt_factories": {"factories": ["Factory#1", "Factory#3"]},
    "flt_regions": {"regions": ["ASIA", "EUROPE"]},
    "flt_states": {"states": ["NATION_1", "NATION_2", "NATION_3"]},
    "flt_modes": {"ship_modes": ["1-URGENT", "2-HIGH"]},
    "flt_divisions": {"divisions": ["ECONOMY", "PROMO"]},
    "flt_products": {"products": ["small ring", "red widget", "hot plate"]},
    "flt_lead_range": {"lead_time_range": (200, 900)},
    "flt_delayed_only": {"delay_only": True},
    "flt_apply": APPLY,
}


def _flt(flt):
    return lambda s, d: FL.apply_filters(feat(s, d), flt)


QUERIES = {k: _flt(v) for k, v in SINGLE.items()}
QUERIES.update({
    "flt_presets": lambda s, d: FL.preset_scopes(feat(s, d), PRESETS),
    "flt_active_count": lambda s, d: FL.active_filter_count(APPLY, feat(s, d)),
    "flt_quick_stats": lambda s, d: FL.quick_stats(FL.apply_filters(feat(s, d), APPLY), feat(s, d)),
    "flt_facets": lambda s, d: FL.facets(feat(s, d), td.ship_mode_order_dim(s)),
    "ord_search": lambda s, d: FL.order_search(feat(s, d), "ring", "Delayed Only", 1998, "sales", False),
    "grid_filter": lambda s, d: FL.grid_filter(feat(s, d), "widget", "Factory#2", "3-MEDIUM", "On Time (False)"),
})


def _lit(v):
    return f"'{v}'" if isinstance(v, str) else str(v)


def where_sql(flt: dict) -> str:
    """The same predicate as :func:`lanecraft.operators.filters.apply_filters`."""
    conds = ["TRUE"]
    if flt.get("search_text"):
        p = flt["search_text"]
        conds.append("(" + " OR ".join(f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '{p}', 'i'), false)"
                                       for c in FL.SEARCH_COLUMNS) + ")")
    for key, col in FL.DIMENSIONS.items():
        if key in flt:
            if flt[key]:
                conds.append(f"{col} IN ({', '.join(_lit(v) for v in flt[key])})")
        else:
            conds.append(f"{col} IS NOT NULL")
    months = flt.get("months", FL.ALL_MONTHS)
    conds.append(f"ship_month IN ({', '.join(str(m) for m in months)})")
    if flt.get("products"):
        conds.append(f"product_name IN ({', '.join(_lit(v) for v in flt['products'])})")
    if flt.get("lead_time_range"):
        lo, hi = flt["lead_time_range"]
        conds.append(f"lead_time BETWEEN {lo} AND {hi}")
    else:
        conds.append("lead_time BETWEEN (SELECT CAST(trunc(min(lead_time)) AS BIGINT) FROM feat) "
                     "AND (SELECT CAST(trunc(max(lead_time)) AS BIGINT) FROM feat)")
    if flt.get("delay_only"):
        conds.append("delay_flag = true")
    return " AND ".join(conds)


def filtered_sql(flt: dict) -> str:
    return f"SELECT * FROM feat WHERE {where_sql(flt)}"


SQL = {k: over_feat(filtered_sql(v)) for k, v in SINGLE.items()}
SQL["flt_presets"] = over_feat("\nUNION ALL\n".join(
    f"SELECT '{name}' AS preset, {i} AS preset_order, count(*) AS rows_kept, "
    f"coalesce(CAST(sum(sales) AS DOUBLE), 0.0) AS sales FROM feat WHERE {where_sql(flt)}"
    for i, (name, flt) in enumerate(PRESETS.items())))
SQL["flt_active_count"] = over_feat(f"""SELECT CAST(
  (CASE WHEN {len(APPLY['years'])} < count(DISTINCT ship_year) THEN 1 ELSE 0 END)
  + (CASE WHEN {len(APPLY['factories'])} < count(DISTINCT factory) THEN 1 ELSE 0 END)
  + (CASE WHEN {len(APPLY['ship_modes'])} < count(DISTINCT ship_mode) THEN 1 ELSE 0 END)
  + (CASE WHEN CAST(trunc(min(lead_time)) AS BIGINT) = {APPLY['lead_time_range'][0]}
          AND CAST(trunc(max(lead_time)) AS BIGINT) = {APPLY['lead_time_range'][1]} THEN 0 ELSE 1 END)
  AS INTEGER) AS active_filters FROM feat""")
SQL["flt_quick_stats"] = over_feat(f"""SELECT count(*) AS filtered_records,
  coalesce(CAST(sum(sales) AS DOUBLE), 0.0) AS total_sales,
  coalesce(round_even(avg(lead_time), 6), 0.0) AS avg_lead_time,
  coalesce((1.0 - avg(CAST(delay_flag AS INTEGER))) * 100.0, 100.0) AS on_time_pct,
  (SELECT count(*) FROM feat) AS total_records,
  coalesce(count(*) / nullif((SELECT count(*) FROM feat), 0) * 100.0, 0.0) AS pct_retained
FROM feat WHERE {where_sql(APPLY)}""")
SQL["flt_facets"] = over_feat("""SELECT facet, value,
  row_number() OVER (PARTITION BY facet ORDER BY k_ord NULLS LAST, k_num NULLS LAST, value) - 1 AS position
FROM (
  SELECT DISTINCT 'years' AS facet, CAST(ship_year AS VARCHAR) AS value, CAST(ship_year AS BIGINT) AS k_num, NULL::INTEGER AS k_ord FROM feat WHERE ship_year IS NOT NULL
  UNION ALL SELECT DISTINCT 'factories', factory, NULL, NULL FROM feat WHERE factory IS NOT NULL
  UNION ALL SELECT DISTINCT 'regions', region, NULL, NULL FROM feat WHERE region IS NOT NULL
  UNION ALL SELECT DISTINCT 'states', state, NULL, NULL FROM feat WHERE state IS NOT NULL
  UNION ALL SELECT DISTINCT 'divisions', division, NULL, NULL FROM feat WHERE division IS NOT NULL
  UNION ALL SELECT DISTINCT 'products', product_name, NULL, NULL FROM feat WHERE product_name IS NOT NULL
  UNION ALL SELECT m.ship_mode, NULL, coalesce(mo.mode_order, 99) FROM (SELECT DISTINCT ship_mode FROM feat WHERE ship_mode IS NOT NULL) m
    LEFT JOIN mode_order mo ON m.ship_mode = mo.ship_mode
)""".replace("UNION ALL SELECT m.ship_mode, NULL,", "UNION ALL SELECT 'ship_modes', m.ship_mode, NULL,"))
SQL["ord_search"] = over_feat("""SELECT * FROM feat WHERE order_year = 1998 AND (
  coalesce(regexp_matches(lower(CAST(order_id AS VARCHAR)), 'ring'), false)
  OR coalesce(regexp_matches(lower(CAST(customer_id AS VARCHAR)), 'ring'), false)
  OR coalesce(regexp_matches(lower(city), 'ring'), false)
  OR coalesce(regexp_matches(lower(state), 'ring'), false)
  OR coalesce(regexp_matches(lower(product_name), 'ring'), false)
  OR coalesce(regexp_matches(lower(factory), 'ring'), false)) AND delay_flag = true""")
SQL["grid_filter"] = over_feat("""SELECT * FROM feat WHERE (
  coalesce(regexp_matches(lower(CAST(order_id AS VARCHAR)), 'widget'), false)
  OR coalesce(regexp_matches(lower(product_name), 'widget'), false)
  OR coalesce(regexp_matches(lower(city), 'widget'), false))
  AND factory = 'Factory#2' AND ship_mode = '3-MEDIUM' AND delay_flag = false""")
