"""Delay classifier and lead-time regressor as ``pyspark.ml`` pipelines.

Features: 4 categoricals label-encoded in alphabetical order (StringIndexer
``alphabetAsc``, unseen → extra index) plus 10 numeric columns, assembled
into one vector.  The train/test split takes the rows whose row-id hash (md5)
lies below the hash's own 20 % quantile, for the classifier per class
(stratified): exact proportions, reproducible on any cluster size.  The test
rows are scored once into a written prediction table (row id, label,
prediction, score); metrics are plain aggregates over that table: confusion
counts, error sums and the exact rank-sum ROC AUC.
"""

from __future__ import annotations

import logging
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import rintn
from lanecraft.functions.quantiles import column_quantiles, group_median
from lanecraft.functions.windows import running_total
from lanecraft.operators.boost import SecondOrderBoost
from lanecraft.operators.forest import Forest, GradientBoost
from lanecraft.plans.materialize import materialize

log = logging.getLogger(__name__)

CATEGORICALS = [S.SHIP_MODE, S.FACTORY, S.REGION, S.DIVISION]
NUMERIC_FEATURES = ["ship_month", "ship_quarter", "ship_dow", "ship_week", S.UNITS, S.SALES, S.GROSS_PROFIT, S.COST,
                    S.FACTORY_LAT, S.FACTORY_LON]
FEATURES = NUMERIC_FEATURES + [f"{c}_encoded" for c in CATEGORICALS]
SEED = 42
TEST_FRACTION = 0.2

# Model sizes.  The first two follow Spark's forests and boosted trees (``operators/forest.py``); the third model is second-order
# boosting with regularised leaves (``operators/boost.py``).
SIZES = {
    "rf": {"trees": 200, "depth": 10},
    "gbt": {"trees": 200, "depth": 5, "rate": 0.05},
    "xgb": {"trees": 200, "depth": 6, "rate": 0.05},
}
NAMES = {"rf": "RF", "gbt": "GBM", "xgb": "XGB"}
ALGORITHMS = tuple(SIZES)


def prepare(df: DataFrame, label: str, drop_nulls: bool = True) -> DataFrame:
    """Numeric feature columns as double, categoricals kept, null rows dropped."""
    cols = [F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES]
    out = df.select(S.ROW_ID, *CATEGORICALS, *cols, F.col(label).cast("double").alias("label"))
    return out.dropna(subset=NUMERIC_FEATURES + ["label"]) if drop_nulls else out


def encoded(df: DataFrame, label: str = S.DELAY_FLAG) -> DataFrame:
    """The label-encoded feature table: codes are fitted on every row (as the
    reference does), then rows with a missing feature are dropped."""
    raw = prepare(df, label, drop_nulls=False)
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_encoded", stringOrderType="alphabetAsc", handleInvalid="keep")
           for c in CATEGORICALS]
    out = Pipeline(stages=idx).fit(raw).transform(raw).select(S.ROW_ID, *FEATURES, "label")
    return out.dropna(subset=NUMERIC_FEATURES + ["label"])


def row_hash(key: str = S.ROW_ID):
    """48 bits of md5 as a number: exact in a double, and the same in any engine."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("double")


def with_split(df: DataFrame, key: str = S.ROW_ID, test_fraction: float = TEST_FRACTION, stratify: bool = True) -> DataFrame:
    """Adds ``split`` (train / test); with ``stratify`` each label value gives the same share of test rows."""
    h = row_hash(key)
    strata = [0.0, 1.0] if stratify else [None]
    own = {f"__h{i}": h if v is None else F.when(F.col("label") == v, h) for i, v in enumerate(strata)}
    cuts = column_quantiles(df.select(*[c.alias(n) for n, c in own.items()]), {n: [test_fraction] for n in own}, "__cut")
    limit = F.col("__cut0_0") if not stratify else F.when(F.col("label") == 0.0, F.col("__cut0_0")).otherwise(F.col("__cut1_0"))
    marked = df.crossJoin(cuts).withColumn("split", F.when(h < limit, "test").otherwise("train"))
    return marked.drop(*cuts.columns)


def split(df: DataFrame, key: str = S.ROW_ID, test_fraction: float = TEST_FRACTION, stratify: bool = True):
    marked = with_split(df, key, test_fraction, stratify)
    return marked.filter("split = 'train'").drop("split"), marked.filter("split = 'test'").drop("split")


def split_labels(df: DataFrame, key: str = S.ROW_ID, test_fraction: float = TEST_FRACTION, stratify: bool = True):
    return with_split(df, key, test_fraction, stratify).select(key, "label", "split")


def _stages(estimator):
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_encoded", stringOrderType="alphabetAsc", handleInvalid="keep")
           for c in CATEGORICALS]
    asm = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return idx + [asm, estimator]


def classifier(algorithm: str, trees: int | None = None, depth: int | None = None):
    p = dict(SIZES[algorithm])
    if trees:
        p["trees"] = trees
    if depth:
        p["depth"] = depth
    if algorithm == "rf":
        return Forest(kind="classifier", seed=SEED, **p)
    if algorithm == "xgb":
        return SecondOrderBoost(kind="classifier", **p)
    return GradientBoost(kind="classifier", **p)


def regressor(algorithm: str, trees: int | None = None, depth: int | None = None):
    p = dict(SIZES[algorithm])
    if trees:
        p["trees"] = trees
    if depth:
        p["depth"] = depth
    if algorithm == "rf":
        return Forest(kind="regressor", seed=SEED, **p)
    if algorithm == "xgb":
        return SecondOrderBoost(kind="regressor", **p)
    return GradientBoost(kind="regressor", **p)


def fit(df: DataFrame, estimator) -> PipelineModel:
    return Pipeline(stages=_stages(estimator)).fit(df)


def predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The written prediction table of some rows: row_id, label, prediction and, of a classifier, ``score`` (the
    probability of the positive class)."""
    scored = model.transform(rows)
    cols = [S.ROW_ID, "label", "prediction"]
    if "probability" in scored.columns:
        return materialize(scored.select(*cols, F.get(vector_to_array("probability"), 1).alias("score")), "predictions")
    return materialize(scored.select(*cols), "predictions")


def roc_auc(pred: DataFrame) -> DataFrame:
    """One row ``roc_auc``: the share of (positive, negative) pairs that the score ranks rightly, ties counting half.

    From counts per distinct score and a distributed running count of the negatives below it (rank-sum form); null
    if one class is missing."""
    by = pred.groupBy("score").agg(F.count_if(F.col("label") == 1.0).alias("pos"), F.count_if(F.col("label") != 1.0).alias("neg"))
    ranked = running_total(by, [F.col("score").asc()], "neg", "below")
    right = F.sum(F.col("pos").cast("double") * (F.col("below") - F.col("neg") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(right, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def classification_metrics(pred: DataFrame, algorithm: str) -> DataFrame:
    """accuracy, precision, recall, F1 (positive class, 0 on zero division), ROC AUC; 4 dp."""
    y, p = F.col("label") == 1.0, F.col("prediction") == 1.0
    c = pred.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                 F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return c.crossJoin(roc_auc(pred)).select(
        F.lit(NAMES.get(algorithm, algorithm)).alias("algorithm"),
        rintn(F.try_divide(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        rintn(prec, 4).alias("precision"), rintn(rec, 4).alias("recall"), rintn(f1, 4).alias("f1"),
        rintn("roc_auc", 4).alias("roc_auc"), "tp", "fp", "tn", "fn")


def regression_metrics(pred: DataFrame, algorithm: str) -> DataFrame:
    """MAE, RMSE, R² in one pass plus the label mean (crossed in); 4 dp."""
    m = pred.agg(F.avg("label").alias("__mu"))
    e = F.col("prediction") - F.col("label")
    a = (pred.crossJoin(m)
             .agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                  F.sum(e * e).alias("__ssr"), F.sum((F.col("label") - F.col("__mu")) ** 2).alias("__sst"),
                  F.count(F.lit(1)).alias("n")))
    r2 = F.lit(1.0) - F.try_divide(F.col("__ssr"), F.col("__sst"))
    return a.select(F.lit(NAMES.get(algorithm, algorithm)).alias("algorithm"), rintn("mae", 4).alias("mae"),
                    rintn("rmse", 4).alias("rmse"), rintn(r2, 4).alias("r2"), "n")


def _fit_persisted(train: DataFrame, estimator) -> PipelineModel:
    # tree learners pass over the training set once per level / iteration;
    # keep it in executor memory (spilling to disk) for the fit only
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit(train, estimator)
    finally:
        train.unpersist()


def train_classifier(df: DataFrame, algorithm: str = "rf", trees: int | None = None, depth: int | None = None):
    data = prepare(df, S.DELAY_FLAG)
    train, test = split(data, stratify=True)
    model = _fit_persisted(train, classifier(algorithm, trees, depth))
    return model, classification_metrics(predictions(model, test), algorithm)


def train_regressor(df: DataFrame, algorithm: str = "rf", trees: int | None = None, depth: int | None = None):
    data = prepare(df, S.LEAD_TIME)
    train, test = split(data, stratify=False)
    model = _fit_persisted(train, regressor(algorithm, trees, depth))
    return model, regression_metrics(predictions(model, test), algorithm)


METRICS = {"classifier": ["accuracy", "precision", "recall", "f1", "roc_auc", "tp", "fp", "tn", "fn"], "regressor": ["mae", "rmse", "r2", "n"]}


def together(spark, calls: list, keep_errors: bool = False) -> list:
    """Results of some calls that run side by side, each in a thread of its own: most jobs of a boosted model are short
    and leave cores idle.  An error is raised when all have ended, or returned in its place with ``keep_errors``.  If this thread
    is interrupted, the jobs of the calls are cancelled."""
    sc, tag = spark.sparkContext, f"together-{uuid.uuid4().hex}"

    def tried(call):
        try:
            return call()
        except Exception as exc:  # noqa: BLE001 - returned
            return exc

    sc.addJobTag(tag)
    pool = ThreadPoolExecutor(max(1, len(calls)))
    try:
        made = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(tried), c) for c in calls]]
    except BaseException:
        sc.cancelJobsWithTag(tag)
        raise
    finally:
        sc.removeJobTag(tag)
        pool.shutdown(wait=False, cancel_futures=True)
    failed = next((x for x in made if isinstance(x, Exception)), None)
    if failed is not None and not keep_errors:
        raise failed
    return made


def train_all(df: DataFrame, kind: str = "classifier", algorithms=ALGORITHMS, train=None, **size):
    """Train every algorithm, side by side; one that fails is logged and reported as a row with its error (and null
    metrics).  ``train(algorithm)`` may supply already fitted (model, metrics) pairs."""
    fn = train_classifier if kind == "classifier" else train_regressor
    train = train or (lambda a: fn(df, a, **size))
    models, parts = {}, []
    for a, got in zip(algorithms, together(df.sparkSession, [partial(train, a) for a in algorithms], keep_errors=True)):
        try:
            if isinstance(got, Exception):
                raise got
            models[a], met = got
            parts.append(met.withColumn("error", F.lit(None).cast("string")))
        except Exception as exc:  # noqa: BLE001 - reported in the result
            log.warning("training %s %s failed: %s", kind, a, exc)
            parts.append(df.sparkSession.range(1).select(
                F.lit(NAMES.get(a, a)).alias("algorithm"),
                *[F.lit(None).cast("long" if m in ("tp", "fp", "tn", "fn", "n") else "double").alias(m) for m in METRICS[kind]],
                F.lit(f"{type(exc).__name__}: {exc}"[:500]).alias("error")))
    metrics = parts[0]
    for p in parts[1:]:
        metrics = metrics.unionByName(p)
    return models, metrics


def importance(model: PipelineModel, spark, top_n: int = 15) -> DataFrame:
    """(feature, importance) of the fitted trees, top n (a 14-element vector)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(FEATURES, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))[:top_n]
    return spark.createDataFrame(rows, "feature string, importance double")


def results_long(clf_metrics: DataFrame | None, reg_metrics: DataFrame | None) -> DataFrame:
    """Tidy long table (model_type, algorithm, metric, value) over both model kinds."""
    parts = []
    if clf_metrics is not None:
        parts.append(clf_metrics.selectExpr(
            "'classifier' AS model_type", "algorithm",
            "stack(5, 'accuracy', accuracy, 'precision', precision, 'recall', recall, 'f1', f1, 'roc_auc', roc_auc)"
            " AS (metric, value)"))
    if reg_metrics is not None:
        parts.append(reg_metrics.selectExpr(
            "'regressor' AS model_type", "algorithm",
            "stack(3, 'mae', mae, 'rmse', rmse, 'r2', r2) AS (metric, value)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save(models: dict, root: str) -> list[tuple[str, str]]:
    saved = []
    for name, m in models.items():
        path = f"{root.rstrip('/')}/{name}"
        m.write().overwrite().save(path)
        saved.append((name, path))
    return saved


def scenario_features(scen: DataFrame, coords_dim: DataFrame, default=(35.0, -90.0)) -> DataFrame:
    """Build model inputs from scenario rows (month, mode, factory, region,
    division, units, sales, profit): quarter = (m − 1) // 3 + 1, week =
    min(4m, 52), Wednesday, cost = sales − profit, factory coordinates."""
    c = coords_dim.select(F.col(S.FACTORY).alias("__f"), F.col(S.FACTORY_LAT).alias("__lat"),
                          F.col(S.FACTORY_LON).alias("__lon"))
    m = F.col("month")
    return (scen.join(c, F.col(S.FACTORY) == F.col("__f"), "left")
                .select("scenario_id", S.SHIP_MODE, S.FACTORY, S.REGION, S.DIVISION,
                        m.cast("double").alias("ship_month"), (F.floor((m - 1) / 3) + 1).cast("double").alias("ship_quarter"),
                        F.lit(2.0).alias("ship_dow"), F.least(m * 4, F.lit(52)).cast("double").alias("ship_week"),
                        F.col("units").cast("double").alias(S.UNITS), F.col("sales").cast("double").alias(S.SALES),
                        F.col("profit").cast("double").alias(S.GROSS_PROFIT),
                        (F.col("sales") - F.col("profit")).cast("double").alias(S.COST),
                        F.coalesce("__lat", F.lit(default[0])).alias(S.FACTORY_LAT),
                        F.coalesce("__lon", F.lit(default[1])).alias(S.FACTORY_LON)))


def score_scenarios(clf: PipelineModel, reg: PipelineModel, features: DataFrame) -> DataFrame:
    """Delay probability (flag at ≥ 0.5) and predicted lead for each scenario."""
    p = clf.transform(features).select("scenario_id", F.get(vector_to_array("probability"), 1).alias("delay_probability"))
    r = reg.transform(features).select(F.col("scenario_id").alias("__sid"), F.col("prediction").alias("predicted_lead"))
    return (p.join(r, F.col("scenario_id") == F.col("__sid")).drop("__sid")
             .withColumn("delayed", F.col("delay_probability") >= 0.5))


def scenario_fallback(scen: DataFrame, df: DataFrame) -> DataFrame:
    """Model-free estimate: median lead of the mode, mean delay of the state
    (0.44 when that mean is 0), cost 35 % of sales, risk band 35 / 60."""
    median, complete = group_median(df, {S.SHIP_MODE: "__m"}, S.LEAD_TIME, "predicted_lead")
    med = complete(df.filter(F.col(S.SHIP_MODE).isNotNull()).groupBy(F.col(S.SHIP_MODE).alias("__m")).agg(
        F.count(F.lit(1)).alias("__rows"), *median)).drop("__rows")
    st = df.filter(F.col(S.STATE).isNotNull()).groupBy(F.col(S.STATE).alias("__s")).agg(
        F.avg(F.col(S.DELAY_FLAG).cast("int")).alias("__d"))
    j = (scen.join(med, F.col(S.SHIP_MODE) == F.col("__m"), "left")
             .join(st, F.col(S.STATE) == F.col("__s"), "left"))
    prob = F.when(F.col("__d") == 0, F.lit(0.44)).otherwise(F.col("__d")) * 100.0
    cost = F.col("sales") * 0.35
    return j.select("scenario_id", S.SHIP_MODE, S.STATE, "sales", "predicted_lead",
                    rintn(prob, 4).alias("delay_probability_pct"), rintn(cost, 4).alias("est_cost"),
                    rintn(F.try_divide(F.col("sales") - cost, F.col("sales")) * 100.0, 4).alias("est_margin_pct"),
                    F.when(prob < 35, "low").when(prob < 60, "medium").otherwise("high").alias("risk_band"))
