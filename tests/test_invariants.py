"""Invariants the reference's own tests assert, on the sf0.001 tables."""

from pyspark.sql import functions as F

from lanecraft import schema as S
from lanecraft.operators import filters as FL
from lanecraft.operators import kpi as K
from lanecraft.operators import quality as Q
from lanecraft.operators import route as R
from lanecraft.plans import featured as FT
from lanecraft.sources import testdata as td


def test_scores_and_rates_in_bounds(spark, sf):
    f = FT.featured(spark, sf)
    b = f.agg(F.min(S.SCORE), F.max(S.SCORE)).first()
    assert 0.0 <= b[0] <= b[1] <= 1.0
    k = K.summary(f).first()
    assert 0.0 <= k["delay_rate_pct"] <= 100.0
    assert k["total_shipments"] == f.count()


def test_top_route_beats_worst(spark, sf):
    rs = R.route_summary(FT.featured(spark, sf))
    top = R.top_routes(rs, 1).first()["avg_efficiency_score"]
    worst = R.worst_routes(rs, 1).first()["avg_efficiency_score"]
    assert top >= worst


def test_no_filters_keeps_everything(spark, sf):
    f = FT.featured(spark, sf)
    qs = FL.quick_stats(FL.apply_filters(f, {}), f).first()
    assert qs["pct_retained"] == 100.0
    assert FL.active_filter_count({}, f).first()["active_filters"] == 0
    assert FL.active_filter_count({"delay_only": True}, f).first()["active_filters"] == 1


def test_health_counts_total_rows(spark, sf):
    a = FT.audited(spark, sf)
    rep = Q.hl_report(a, td.factory_name_dim(spark, sf)).first()
    assert rep["total_records"] == a.count()


def test_recalc_keeps_all_rows(spark, sf):
    assert FT.recalculated(spark, sf).count() == FT.base(spark, sf).count()


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "avg_efficiency_score" in df.columns
