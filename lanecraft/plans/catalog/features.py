"""§2.3 feature queries (operators run explicitly on the base fact)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanecraft import schema as S
from lanecraft.operators import clean as C
from lanecraft.operators import feature as FE
from lanecraft.plans import featured as FT
from lanecraft.plans.catalog.common import feat
from lanecraft.plans.oracle_base import AUD, over_fact, over_feat, recalc_ctes, temporal_sql
from lanecraft.sources import testdata as td


def _fact(s, d):
    return FT.base(s, d)


def _with_factory(s, d):
    return FE.add_factory(_fact(s, d), td.factory_dim(s, d))


def _recalc(s, d):
    return FT.recalculated(s, d, "auto")


TEMPORAL = ["ship_year", "ship_month", "ship_month_name", "ship_quarter", "ship_week", "ship_day", "ship_dow",
            "order_year", "order_month", "order_month_name", "order_day", "order_dow"]

QUERIES = {
    "feat_factory": lambda s, d: FE.factory_distribution(_with_factory(s, d)),
    "feat_coords": lambda s, d: FE.add_factory_coords(_with_factory(s, d), td.factory_coords_dim(s)).select(
        S.ROW_ID, S.FACTORY, S.FACTORY_LAT, S.FACTORY_LON),
    "feat_coords_default": lambda s, d: FE.add_factory_coords(_with_factory(s, d), td.factory_coords_dim(s),
                                                              S.DEFAULT_COORDS).select(
        S.ROW_ID, S.FACTORY, S.FACTORY_LAT, S.FACTORY_LON),
    "feat_lead_days": lambda s, d: FE.add_lead_days(_fact(s, d)).select(S.ROW_ID, S.LEAD_TIME),
    "feat_lead_stats": lambda s, d: FE.lead_stats(FE.add_lead_days(C.drop_invalid_lead(_fact(s, d)))),
    "feat_lead_days_clipped": lambda s, d: FE.add_lead_days_clipped(_fact(s, d)).select(S.ROW_ID, S.LEAD_TIME),
    "feat_delay_median": lambda s, d: FE.add_delay_flag_median(
        FE.add_lead_days(C.drop_invalid_lead(_fact(s, d)))).select(S.ROW_ID, S.SHIP_MODE, S.LEAD_TIME, S.DELAY_FLAG),
    "feat_delay_sla": lambda s, d: FE.add_delay_flag_sla(
        FE.add_lead_days(_fact(s, d)), td.sla_dim(s)).select(S.ROW_ID, S.SHIP_MODE, S.LEAD_TIME, S.DELAY_FLAG),
    "feat_delay_auto": lambda s, d: FE.add_delay_flag_auto(
        FE.add_lead_days_clipped(_fact(s, d)), td.sla_dim(s)).select(S.ROW_ID, S.SHIP_MODE, S.LEAD_TIME, S.DELAY_FLAG),
    "feat_route_ids": lambda s, d: FE.add_route_ids(_with_factory(s, d)).select(
        S.FACTORY, S.STATE, S.REGION, S.STATE_ROUTE, S.REGION_ROUTE, S.ROUTE_ID).distinct(),
    "feat_temporal": lambda s, d: FE.add_temporal(_fact(s, d)).select(S.ROW_ID, *TEMPORAL),
    "feat_efficiency": lambda s, d: FE.route_scores(feat(s, d)),
    "feat_efficiency_cfg": lambda s, d: _recalc(s, d).select(S.STATE_ROUTE, S.SCORE).distinct(),
    "feat_chain": feat,
    "recalc_chain": _recalc,
    "recalc_summary": lambda s, d: _recalc(s, d).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.avg(F.col(S.DELAY_FLAG).cast("int")), F.lit(0.0)).alias("overall_delay_rate"),
        (F.rint(F.coalesce(F.avg(S.LEAD_TIME), F.lit(0.0)) * 1e6) / 1e6).alias("mean_lead_time_days")),
}

FF = """ff AS (SELECT f.*, coalesce(fd.factory, 'Unknown Factory') AS factory FROM fact f
  LEFT JOIN factory_dim fd ON f.product_id = fd.product_id)"""
LEAD = "CAST(date_diff('day', order_date, ship_date) AS INTEGER)"
CLIP = ("round_even(greatest(CAST(date_diff('second', CAST(order_date AS TIMESTAMP), CAST(ship_date AS TIMESTAMP)) "
        "AS DOUBLE) / 86400.0, 0.5::DOUBLE), 2)")
RECALC = recalc_ctes("fact", "recalc", "auto")

SQL = {
    "feat_lead_stats": over_fact("""SELECT min(l) AS min_lead_time, median(l) AS median_lead_time, max(l) AS max_lead_time
FROM (SELECT CAST(date_diff('day', order_date, ship_date) AS INTEGER) AS l FROM fact) WHERE l > 0"""),
    "feat_factory": over_fact("SELECT factory, count(*) AS shipments FROM ff GROUP BY factory", FF),
    "feat_coords": over_fact("""SELECT ff.row_id, ff.factory, c.factory_lat, c.factory_lon FROM ff
  LEFT JOIN coords c ON ff.factory = c.factory""", FF),
    "feat_coords_default": over_fact("""SELECT ff.row_id, ff.factory, coalesce(c.factory_lat, 39.5::DOUBLE) AS factory_lat,
  coalesce(c.factory_lon, -98.35::DOUBLE) AS factory_lon FROM ff LEFT JOIN coords c ON ff.factory = c.factory""", FF),
    "feat_lead_days": over_fact(f"SELECT row_id, {LEAD} AS lead_time FROM fact"),
    "feat_lead_days_clipped": over_fact(f"SELECT row_id, {CLIP} AS lead_time FROM fact"),
    "feat_delay_median": over_fact("""SELECT l.row_id, l.ship_mode, l.lead_time,
  coalesce(l.lead_time > m.med, false) AS delay_flag FROM l LEFT JOIN m ON l.ship_mode = m.ship_mode""",
        f"l AS (SELECT row_id, ship_mode, {LEAD} AS lead_time FROM fact WHERE date_diff('day', order_date, ship_date) > 0)",
        "m AS (SELECT ship_mode, median(lead_time) AS med FROM l WHERE ship_mode IS NOT NULL GROUP BY ship_mode)"),
    "feat_delay_sla": over_fact(f"""SELECT f.row_id, f.ship_mode, {LEAD} AS lead_time,
  coalesce({LEAD} > coalesce(s.sla_days, 4.0::DOUBLE), false) AS delay_flag
FROM fact f LEFT JOIN sla s ON f.ship_mode = s.ship_mode"""),
    "feat_delay_auto": over_fact("""SELECT l.row_id, l.ship_mode, l.lead_time,
  CASE WHEN coalesce((SELECT median(lead_time) FROM l), 0.0) > 50.0 THEN coalesce(l.lead_time > m.med, false)
       ELSE coalesce(l.lead_time > coalesce(s.sla_days, 4.0::DOUBLE), false) END AS delay_flag
FROM l LEFT JOIN m ON l.ship_mode = m.ship_mode LEFT JOIN sla s ON l.ship_mode = s.ship_mode""",
        f"l AS (SELECT row_id, ship_mode, {CLIP} AS lead_time FROM fact)",
        "m AS (SELECT ship_mode, median(lead_time) AS med FROM l WHERE ship_mode IS NOT NULL GROUP BY ship_mode)"),
    "feat_route_ids": over_fact("""SELECT DISTINCT factory, state, region, factory || ' → ' || state AS state_route,
  factory || ' → ' || region AS region_route,
  regexp_replace(factory, '[^A-Za-z0-9]', '_', 'g') || '_to_' || regexp_replace(state, '[^A-Za-z0-9]', '_', 'g') AS route_id
FROM ff""", FF),
    "feat_temporal": over_fact(f"SELECT row_id, {temporal_sql()} FROM fact"),
    "feat_efficiency": over_feat("""SELECT rs.__route AS state_route, rs.delay_rate, rs.avg_lead_time,
  CASE WHEN __hi - __lo > 0 THEN (avg_lead_time - __lo) / (__hi - __lo) WHEN avg_lead_time IS NOT NULL THEN 0.0::DOUBLE END
    AS norm_lead_time, sc.__score AS efficiency_score
FROM feat_rs rs, feat_mm JOIN feat_sc sc ON true WHERE sc.__route = rs.__route"""),
    "feat_efficiency_cfg": over_fact("SELECT DISTINCT state_route, efficiency_score FROM recalc", RECALC),
    "feat_chain": over_feat("SELECT * FROM feat"),
    "recalc_chain": over_fact("SELECT * FROM recalc", RECALC),
    "recalc_summary": over_fact("""SELECT count(*) AS record_count,
  coalesce(avg(CAST(delay_flag AS INTEGER)), 0.0) AS overall_delay_rate,
  round_even(coalesce(avg(lead_time), 0.0), 6) AS mean_lead_time_days FROM recalc""", RECALC),
}
_ = AUD
