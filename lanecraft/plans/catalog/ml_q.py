"""§2.12 machine-learning queries, at the full model sizes; a fitted model is kept per session and input
folder, so that the queries about one model train it once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanecraft import schema as S
from lanecraft.operators import ml as ML
from lanecraft.plans import featured as FT
from lanecraft.plans.catalog.common import feat
from lanecraft.plans.materialize import shared_path
from lanecraft.plans.oracle_base import over_feat
from lanecraft.sources import testdata as td

def _trained(s, d, kind, algo):
    """(model, metrics); the metrics are one row, evaluated with the model."""
    fn = ML.train_classifier if kind == "classifier" else ML.train_regressor

    def build():
        model, metrics = fn(feat(s, d), algo)
        return model, s.createDataFrame(metrics.collect(), metrics.schema)

    return FT._memo(s, ("ml", d.rstrip("/"), kind, algo), build)


def _all(s, d, kind):
    return ML.train_all(feat(s, d), kind, train=lambda a: _trained(s, d, kind, a))


def _both(s, d):
    """(models, metrics) of the classifiers and of the regressors, which learn side by side."""
    f = feat(s, d)
    return ML.together(s, [lambda k=kind: ML.train_all(f, k, train=lambda a: _trained(s, d, k, a)) for kind in ML.METRICS])


def _train_all(s, d):
    errors = [metrics.select(F.lit(kind).alias("model_type"), "algorithm", "error")
              for kind, (_, metrics) in zip(ML.METRICS, _both(s, d))]
    return errors[0].unionByName(errors[1])


def _scenarios(s, d):
    """One scenario per (mode, factory, region, division) seen in the data:
    its mean units / sales / profit in month 6."""
    f = feat(s, d)
    g = (f.groupBy(S.SHIP_MODE, S.FACTORY, S.REGION, S.DIVISION)
          .agg(F.round(F.avg(S.UNITS)).cast("int").alias("units"), F.round(F.avg(S.SALES), 2).alias("sales"),
               F.round(F.avg(S.GROSS_PROFIT), 2).alias("profit")))
    return g.select(F.concat_ws("|", S.SHIP_MODE, S.FACTORY, S.REGION, S.DIVISION).alias("scenario_id"),
                    S.SHIP_MODE, S.FACTORY, S.REGION, S.DIVISION, F.lit(6).alias("month"), "units", "sales", "profit")


def _score(s, d):
    feat(s, d)  # built once, before
    (clf, _), (reg, _) = ML.together(s, [lambda k=kind: _trained(s, d, k, "rf") for kind in ML.METRICS])
    return ML.score_scenarios(clf, reg, ML.scenario_features(_scenarios(s, d), td.factory_coords_dim(s)))


def _fallback_scen(s, d):
    f = feat(s, d)
    return (f.groupBy(S.SHIP_MODE, S.STATE).agg(F.round(F.avg(S.SALES), 2).cast("double").alias("sales"))
             .select(F.concat_ws("|", S.SHIP_MODE, S.STATE).alias("scenario_id"), S.SHIP_MODE, S.STATE, "sales"))


def _save(s, d):
    models, _ = _all(s, d, "classifier")
    saved = ML.save(models, shared_path(s, "models"))
    from pyspark.ml import PipelineModel
    rows = [(name, len(PipelineModel.load(path).stages)) for name, path in saved]
    return s.createDataFrame(rows, "algorithm string, stages int")


QUERIES = {
    "ml_features": lambda s, d: ML.encoded(feat(s, d), S.DELAY_FLAG),
    "ml_split": lambda s, d: ML.split_labels(ML.prepare(feat(s, d), S.DELAY_FLAG)),
    "ml_clf_rf": lambda s, d: _trained(s, d, "classifier", "rf")[1],
    "ml_clf_gbt": lambda s, d: _trained(s, d, "classifier", "gbt")[1],
    "ml_clf_xgb": lambda s, d: _trained(s, d, "classifier", "xgb")[1],
    "ml_clf_metrics": lambda s, d: _all(s, d, "classifier")[1],
    "ml_reg_rf": lambda s, d: _trained(s, d, "regressor", "rf")[1],
    "ml_reg_gbt": lambda s, d: _trained(s, d, "regressor", "gbt")[1],
    "ml_reg_xgb": lambda s, d: _trained(s, d, "regressor", "xgb")[1],
    "ml_reg_metrics": lambda s, d: _all(s, d, "regressor")[1],
    "ml_train_all": _train_all,
    "ml_importance": lambda s, d: ML.importance(_trained(s, d, "classifier", "rf")[0], s, 15),
    "ml_results": lambda s, d: ML.results_long(*[metrics for _, metrics in _both(s, d)]),
    "ml_save": _save,
    "ml_score_scenarios": _score,
    "ml_scenario_fallback": lambda s, d: ML.scenario_fallback(_fallback_scen(s, d), feat(s, d)),
}

ENC = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}_encoded" for c in ML.CATEGORICALS)
NUMS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ML.NUMERIC_FEATURES)

PREP = "prep AS (SELECT row_id, CAST(delay_flag AS DOUBLE) AS label, CAST(('0x' || substr(md5(row_id), 1, 12)) AS BIGINT)::DOUBLE AS h FROM feat WHERE " \
    + " AND ".join(f"{c} IS NOT NULL" for c in ML.NUMERIC_FEATURES) + " AND delay_flag IS NOT NULL)"
KINDS = ", ".join(f"('{k}', '{n}', CAST(NULL AS VARCHAR))" for k in ("classifier", "regressor") for n in ML.NAMES.values())

SQL = {
    "ml_split": over_feat("""SELECT row_id, label, CASE WHEN h < cut THEN 'test' ELSE 'train' END AS split
FROM prep JOIN cuts USING (label)""", PREP, "cuts AS (SELECT label, quantile_cont(h, 0.2) AS cut FROM prep GROUP BY label)"),
    "ml_train_all": f"SELECT * FROM (VALUES {KINDS}) t(model_type, algorithm, error)",
    "ml_features": over_feat(f"""SELECT * FROM (SELECT row_id, {NUMS}, {ENC}, CAST(delay_flag AS DOUBLE) AS label FROM feat)
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ML.NUMERIC_FEATURES)} AND label IS NOT NULL"""),
    "ml_scenario_fallback": over_feat("""SELECT sc.ship_mode || '|' || sc.state AS scenario_id, sc.ship_mode, sc.state, sc.sales,
  m.predicted_lead,
  round_even(CASE WHEN st.d = 0 THEN 0.44 ELSE st.d END * 100.0, 4) AS delay_probability_pct,
  round_even(sc.sales * 0.35, 4) AS est_cost,
  round_even((sc.sales - sc.sales * 0.35) / nullif(sc.sales, 0) * 100.0, 4) AS est_margin_pct,
  CASE WHEN CASE WHEN st.d = 0 THEN 0.44 ELSE st.d END * 100.0 < 35 THEN 'low'
       WHEN CASE WHEN st.d = 0 THEN 0.44 ELSE st.d END * 100.0 < 60 THEN 'medium' ELSE 'high' END AS risk_band
FROM sc LEFT JOIN m ON sc.ship_mode = m.ship_mode LEFT JOIN st ON sc.state = st.state""",
        """sc AS (SELECT ship_mode, state, CAST(round(avg(sales), 2) AS DOUBLE) AS sales FROM feat GROUP BY ship_mode, state)""",
        """m AS (SELECT ship_mode, median(lead_time) AS predicted_lead FROM feat WHERE ship_mode IS NOT NULL GROUP BY ship_mode)""",
        """st AS (SELECT state, avg(CAST(delay_flag AS INTEGER)) AS d FROM feat WHERE state IS NOT NULL GROUP BY state)"""),
}
