"""Quantiles per group, model metrics, scoring, reports and the audit table against plain versions."""

import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lanecraft import schema as S
from lanecraft.functions.quantiles import group_quantiles
from lanecraft.operators import clean as C
from lanecraft.operators import governance as G
from lanecraft.operators import kpi as K
from lanecraft.operators import ml as ML
from lanecraft.operators import mode as M
from lanecraft.operators import route as R
from lanecraft.plans import featured as FT
from lanecraft.plans.materialize import shared_path
from lanecraft.sources import testdata as td
from lanecraft.streaming.audit_table import AuditTable


# ── quantiles per group ──────────────────────────────────────────────────────

def test_group_quantiles_equal_percentile_with_a_hot_group(spark):
    """200,000 distinct doubles, half of them in one group."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 40).alias("g"), (F.rand(3) * 1e6 - 5e5).alias("v"))
    df = df.union(spark.createDataFrame([(0, None), (50, None), (51, float("nan")), (52, 7.5), (None, 1.0)], "g int, v double"))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.g: tuple(r)[1:] for r in group_quantiles(df, ["g"], "v", probs).collect()}
    plain = df.where("g is not null").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    want = {r.g: tuple(r.p or [None] * 5) for r in plain.groupBy("g").agg(F.percentile("v", list(probs.values())).alias("p")).collect()}
    assert got == want and got[50] == got[51] == (None,) * 5 and got[52] == (7.5,) * 5


def test_group_quantiles_of_repeated_values_and_two_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.choice([1.0, 1.0, 1.0, 2.5, 9.0])) for _ in range(500)]
    df = spark.createDataFrame(rows, "x string, y int, v double")
    got = {(r.x, r.y): r.m for r in group_quantiles(df, ["x", "y"], "v", {"m": 0.7}).collect()}
    assert got == {k: float(np.percentile([v for a, b, v in rows if (a, b) == k], 70)) for k in got} and len(got) == 6
    assert group_quantiles(df.limit(0), ["x"], "v", {"m": 0.5}).count() == 0


def test_summaries_agree_on_whole_and_fractional_leads(spark, sf):
    """The same leads as int (median buffer) and as double (distributed)."""
    whole = FT.featured(spark, sf)
    part = whole.withColumn(S.LEAD_TIME, F.col(S.LEAD_TIME).cast("double"))
    order = td.ship_mode_order_dim(spark)
    for f in (lambda d: M.mode_summary(d, order), M.box_stats, K.summary, K.factory_performance, K.route_performance,
              lambda d: K.ship_mode_performance(d, order), R.route_summary):
        a, b = (x.select(sorted(x.columns)).toPandas() for x in (f(whole), f(part)))
        key = [c for c in a.columns if a[c].dtype == object]
        a, b = (x.sort_values(key).reset_index(drop=True) if key else x for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)


# ── models ───────────────────────────────────────────────────────────────────

def plain_auc(rows):
    pos, neg = ([s for y, s in rows if y == want] for want in (1.0, 0.0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_classifier_metrics_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(str(i), float(rng.random() < 0.4), 0.0, rng.choice([0.1, 0.3, 0.3, 0.5, rng.random()])) for i in range(400)]
    rows = [(i, y, float(s + 0.2 * y > 0.45), s + 0.2 * y) for i, y, _, s in rows]
    r = ML.classification_metrics(spark.createDataFrame(rows, "row_id string, label double, prediction double, score double"), "rf").first()
    tp, fp, tn, fn = (sum(y == a and p == b for _, y, p, _ in rows) for a, b in ((1, 1), (0, 1), (0, 0), (1, 0)))
    assert (r.tp, r.fp, r.tn, r.fn) == (tp, fp, tn, fn)
    assert r.accuracy == round((tp + tn) / 400, 4) and r.precision == round(tp / (tp + fp), 4) and r.recall == round(tp / (tp + fn), 4)
    assert r.f1 == round(2 * tp / (2 * tp + fp + fn), 4)
    assert r.roc_auc == round(plain_auc([(y, s) for _, y, _, s in rows]), 4)


@pytest.mark.parametrize("rows", [[(1.0, 0.0, 0.2)], [(0.0, 0.0, 0.2), (1.0, 0.0, 0.2)], [(0.0, 1.0, 0.9), (1.0, 0.0, 0.1)]])
def test_metrics_of_few_rows(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "row_id string, label double, prediction double, score double")
    r = ML.classification_metrics(df, "rf").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    assert r.roc_auc == plain_auc([(y, s) for y, _, s in rows])


def test_regression_metrics_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    y, p = rng.normal(size=300) * 40 + 900, rng.normal(size=300) * 40 + 900
    df = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "row_id string, label double, prediction double")
    r = ML.regression_metrics(df, "rf").first()
    assert r.mae == pytest.approx(np.abs(y - p).mean(), abs=1e-4) and r.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()), abs=1e-4)
    assert r.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)
    flat = spark.createDataFrame([("a", 5.0, 4.0), ("b", 5.0, 6.0)], df.schema)
    assert ML.regression_metrics(flat, "rf").first().r2 is None


@pytest.fixture(scope="module")
def trained(spark, sf):
    f = FT.featured(spark, sf)
    return f, ML.train_classifier(f, "rf", trees=3, depth=3), ML.train_regressor(f, "gbt", trees=3, depth=2)


def test_test_rows_are_scored_once_and_measured_from_their_table(spark, trained):
    f, (model, metrics), _ = trained
    train, test = ML.split(ML.prepare(f, S.DELAY_FLAG))
    pred = ML.predictions(model, test)
    n, hits = pred.agg(F.count("*"), F.count_if(F.col("label") == F.col("prediction"))).first()
    assert n == test.count() and n + train.count() == ML.prepare(f, S.DELAY_FLAG).count()
    got = metrics.first()
    assert got.accuracy == round(hits / n, 4) and got.tp + got.fp + got.tn + got.fn == n
    rows = [(r.label, r.score) for r in pred.collect()]
    assert got.roc_auc == pytest.approx(plain_auc(rows), abs=1e-4) and all(0 <= s <= 1 for _, s in rows)


def test_split_shares_and_classes(spark, trained):
    data = ML.prepare(trained[0], S.DELAY_FLAG)
    marked = ML.with_split(data)
    for r in marked.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert abs(r.t - 0.2 * r.n) <= 1
    again = {tuple(r) for r in ML.split_labels(data.repartition(7)).collect()}
    assert again == {tuple(r) for r in ML.split_labels(data).collect()}


def test_importance_names_every_feature_once(spark, trained):
    rows = ML.importance(trained[1][0], spark, 99).collect()
    assert sorted(r.feature for r in rows) == sorted(ML.FEATURES)
    assert sum(r.importance for r in rows) == pytest.approx(1) and [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    assert ML.importance(trained[1][0], spark, 3).count() == 3


def test_saved_models_predict_the_same(spark, trained):
    f, (model, _), (reg, _) = trained
    (name, path), (_, other) = ML.save({"clf": model, "reg": reg}, shared_path(spark, "test-models"))
    rows = ML.prepare(f, S.DELAY_FLAG).limit(50)
    assert name == "clf" and path.endswith("/clf")
    for kept, own in ((PipelineModel.load(path), model), (PipelineModel.load(other), reg)):
        assert kept.transform(rows).select("prediction").collect() == own.transform(rows).select("prediction").collect()


def test_scenarios_are_scored_by_the_models(spark, trained):
    f, (clf, _), (reg, _) = trained
    scen = spark.createDataFrame([("a", "1-URGENT", "Factory#1", "ASIA", "ECONOMY", 1, 3, 100.0, 60.0),
                                  ("b", "nobody", "Nowhere", "?", "?", 12, 3, 100.0, 60.0)],
                                 "scenario_id string, ship_mode string, factory string, region string, division string, month int, units int, sales double, profit double")
    x = ML.scenario_features(scen, td.factory_coords_dim(spark))
    assert [tuple(r) for r in x.orderBy("scenario_id").select("ship_quarter", "ship_week", "cost", "factory_lat", "factory_lon").collect()] == [
        (1.0, 4.0, 40.0, 33.0, -103.0), (4.0, 48.0, 40.0, 35.0, -90.0)]
    got = {r.scenario_id: r for r in ML.score_scenarios(clf, reg, x).collect()}
    for r in clf.transform(x).collect():
        assert got[r.scenario_id].delay_probability == pytest.approx(r.probability[1]) and got[r.scenario_id].delayed == (r.probability[1] >= 0.5)
    for r in reg.transform(x).collect():
        assert got[r.scenario_id].predicted_lead == pytest.approx(r.prediction)


def test_a_failing_model_is_a_row_and_the_others_stay(spark, trained):
    f, fitted, _ = trained

    def train(algorithm):
        if algorithm == "gbt":
            raise ValueError("no trees")
        return fitted[0], fitted[1].withColumn("algorithm", F.lit(ML.NAMES[algorithm]))

    models, metrics = ML.train_all(f, "classifier", train=train)
    rows = {r.algorithm: r for r in metrics.collect()}
    assert set(models) == {"rf", "xgb"} and rows[ML.NAMES["gbt"]].error == "ValueError: no trees" and rows[ML.NAMES["gbt"]].accuracy is None
    assert sum(r.error is None for r in rows.values()) == 2
    long = {(r.model_type, r.metric): r.value for r in ML.results_long(fitted[1], trained[2][1]).collect()}
    assert len(long) == 8 and long["classifier", "roc_auc"] == fitted[1].first().roc_auc and long["regressor", "mae"] == trained[2][1].first().mae


def test_models_learn_side_by_side(spark, trained):
    f, fitted, _ = trained
    meet = threading.Barrier(3)

    def train(algorithm):
        meet.wait(30)
        return fitted

    assert [r.error for r in ML.train_all(f, "classifier", train=train)[1].collect()] == [None] * 3
    meet.reset()

    def build():
        meet.wait(30)
        return 1

    def failing():
        FT._memo(spark, ("meet", "here", "failing"), build)
        raise ValueError("after the others met it")

    calls = [lambda n=n: FT._memo(spark, ("meet", "here", n), build) for n in range(2)] + [failing]
    got = ML.together(spark, calls, keep_errors=True)
    assert got[:2] == [1, 1] and isinstance(got[2], ValueError)
    with pytest.raises(ValueError, match="after"):
        ML.together(spark, [lambda: 1, lambda e=got[2]: (_ for _ in ()).throw(e)])
    FT.refresh("here")


# ── cleaning report ──────────────────────────────────────────────────────────

def test_the_report_comes_from_the_pass_that_cleans(spark, sf):
    raw = FT.dirty(spark, sf)
    rows, report = C.clean_with_report(raw, {"red widget": "Red Widget"})
    r = report.first()
    assert r.raw_rows == raw.count() and r.final_rows == rows.count()
    assert r.raw_rows - r.bad_date_rows - r.duplicates_removed - r.invalid_leads_removed == r.final_rows
    assert rows.where(F.col(S.PRODUCT_NAME) == "Red Widget").count() <= r.product_name_fixes
    assert tuple(C.clean_with_report(raw.limit(0))[1].first()) == (0,) * 6


# ── audit table ──────────────────────────────────────────────────────────────

def entries(spark, sf):
    return G.audit_log(spark.read.parquet(f"{sf}/events.parquet"))


def test_batches_are_written_once_and_folded(spark, sf):
    table, rows = AuditTable(spark, shared_path(spark, "test-audit")), entries(spark, sf)
    for i in range(12):
        assert table.add(rows.where(F.col("event_id") % 12 == i), i)
    assert not table.add(rows, 11) and not table.add(rows, 3)
    assert AuditTable(spark, table.root).add(rows.limit(0), 12)
    assert len(table.pieces()) == 12 and table.rows().count() == rows.count()
    want = G.latest(rows, 100).collect()
    assert table.latest(100).collect() == want
    assert table.compact() == 1 and table.rows().exceptAll(rows.select(*table.rows().columns)).isEmpty()
    assert table.rows().count() == rows.count() and table.latest(100).collect() == want
    assert not table.add(rows, 12) and table.add(rows.limit(5), 0, source="other")
    assert len(table.pieces()) == 2


def test_latest_reads_the_newest_dates_only(spark, sf):
    table, rows = AuditTable(spark, shared_path(spark, "test-audit")), entries(spark, sf)
    table.add(rows, 0)
    plan = table.latest(1)._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = table.latest(1).select(F.input_file_name()).distinct().count()
    assert files == 1 < len(table.rows().inputFiles())


def test_retention_keeps_the_newest(spark, sf):
    table, rows = AuditTable(spark, shared_path(spark, "test-audit")), entries(spark, sf)
    odd = rows.limit(3).withColumn("ts", F.lit(None).cast(rows.schema["ts"].dataType))
    table.add(rows.unionByName(odd), 0)
    assert table.latest(10 ** 6).count() == rows.count() + 3
    table.compact(keep=200)
    assert table.rows().count() == 200 and table.latest(200).collect() == G.latest(rows, 200).collect()
    with pytest.raises(FileNotFoundError):
        AuditTable(spark, shared_path(spark, "test-audit")).rows()


# ── footers ──────────────────────────────────────────────────────────────────

def test_counts_and_bounds_come_from_footers(spark, sf):
    from lanecraft.sources.files import footer_stats

    plans = []
    got = footer_stats(spark, f"{sf}/lineitem.parquet", ("l_orderkey", "l_quantity"), plans)
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    want = df.agg(F.count("*"), F.min("l_orderkey"), F.max("l_orderkey"), F.min("l_quantity"), F.max("l_quantity")).first()
    assert tuple(got.values()) == tuple(want)
    assert "PushedAggregation: [COUNT(*)" in plans[0]
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
