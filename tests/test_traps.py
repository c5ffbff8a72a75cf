"""Tiny literal frames for the semantic traps (ties, nulls, n = 1, empty
input, flat normalisation, short series, merge rules, ABC edge, dirty text)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import literal_table, rint2
from lanecraft.operators import clean as C
from lanecraft.operators import commit as CM
from lanecraft.operators import feature as FE
from lanecraft.operators import kpi as K
from lanecraft.operators import quality as Q
from lanecraft.operators import repair as RP
from lanecraft.operators import report as RPT
from lanecraft.operators import route as R
from lanecraft.operators import series as TS

D = dt.date


def fact(spark, rows):
    """rows: (row_id, order_id, product, factory, state, region, mode, lead, delayed, score, sales)."""
    df = spark.createDataFrame(rows, "row_id string, order_id long, product_name string, factory string, "
                                     "state string, region string, ship_mode string, lead_time int, "
                                     "delay_flag boolean, efficiency_score double, sales double")
    return (df.withColumn(S.SALES, F.col(S.SALES).cast(S.MONEY))
              .withColumn(S.GROSS_PROFIT, (F.col(S.SALES) * 0.5).cast(S.MONEY))
              .withColumn(S.COST, (F.col(S.SALES) * 0.5).cast(S.MONEY))
              .withColumn(S.UNITS, F.lit(1))
              .withColumn(S.STATE_ROUTE, F.concat(F.col(S.FACTORY), F.lit(S.ROUTE_ARROW), F.col(S.STATE)))
              .withColumn(S.REGION_ROUTE, F.concat(F.col(S.FACTORY), F.lit(S.ROUTE_ARROW), F.col(S.REGION))))


def test_rint_matches_numpy_round(spark):
    import numpy as np
    vals = [0.125, 0.135, 2.675, 1.005, -0.125, 12.345, 0.5, 1.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(rint2("x")).collect()]
    assert got == [float(x) for x in np.round(np.array(vals), 2)]     # pandas Series.round semantics


def test_null_dimension_dropped_and_single_row_route(spark):
    df = fact(spark, [("1", 1, "p", "F1", "A", "R", "m", 5, True, 0.5, 10.0),
                      ("2", 2, "p", "F1", None, "R", "m", 7, False, 0.5, 10.0)])
    rs = R.route_summary(df).collect()
    assert len(rs) == 1                       # the null state does not form a group
    r = rs[0]
    assert r["std_lead_time"] is None and r["lead_time_cv"] == 0.0   # n = 1: std null, CV 0


def test_tied_scores_share_min_rank(spark):
    df = fact(spark, [("1", 1, "p", "F1", "A", "R", "m", 5, True, 0.80, 1.0),
                      ("2", 2, "p", "F1", "B", "R", "m", 5, True, 0.80, 1.0),
                      ("3", 3, "p", "F2", "A", "R", "m", 5, True, 0.40, 1.0)])
    ranks = sorted((r["route"], r["rank"]) for r in R.route_summary(df).collect())
    assert [x[1] for x in ranks] == [1, 1, 3]


def test_empty_table_kpis(spark):
    df = fact(spark, [("1", 1, "p", "F1", "A", "R", "m", 5, True, 0.5, 1.0)]).limit(0)
    k = K.summary(df).first()
    assert k["delay_rate_pct"] == 0.0 and k["on_time_rate_pct"] == 100.0 and k["total_shipments"] == 0


def test_flat_normalisation_gives_zero(spark):
    df = fact(spark, [("1", 1, "p", "F1", "A", "R", "m", 5, False, None, 1.0),
                      ("2", 2, "p", "F2", "B", "R", "m", 5, True, None, 1.0)])
    sc = {r[S.STATE_ROUTE]: r for r in FE.route_scores(df).collect()}
    assert all(r["norm_lead_time"] == 0.0 for r in sc.values())
    assert sc["F1 → A"][S.SCORE] == 1.0 and sc["F2 → B"][S.SCORE] == pytest.approx(0.4)


def series(spark, xs):
    rows = [(D(2024, i + 1, 1), x) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "period date, orders long")


def test_holt_needs_more_than_three_points(spark):
    assert TS.holt_state(series(spark, [10, 12, 15])).count() == 0
    assert TS.forecast(TS.holt_state(series(spark, [10, 12, 15]))).count() == 0


def test_holt_four_points(spark):
    st = TS.holt_state(series(spark, [10, 12, 15, 11])).first()
    assert st["level"] == pytest.approx(14.288) and st["trend"] == pytest.approx(1.6416)
    fc = TS.forecast(TS.holt_state(series(spark, [10, 12, 15, 11])), horizon=3).orderBy("step").collect()
    assert [r["period"] for r in fc] == [D(2024, 5, 1), D(2024, 6, 1), D(2024, 7, 1)]
    assert fc[0]["forecast"] == pytest.approx(14.288 + 1.6416, abs=1e-4)
    assert all(r["lower"] >= 0 for r in fc)


def test_merge_rules(spark):
    base = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "c", 7)], "order_id long, city string, units int")
    staged = spark.createDataFrame([(1, "X", None), (3, "NEW", 9)], "order_id long, city string, units int")
    out = sorted(tuple(r) for r in CM.merge_by_key(base, staged, "order_id").collect())
    # null staged value keeps the base value; duplicate base keys all updated; new key not inserted
    assert out == [(1, "X", 5), (1, "X", 6), (2, "c", 7)]
    dup = spark.createDataFrame([(1, "X", 1), (1, "Y", 2)], "order_id long, city string, units int")
    with pytest.raises(ValueError):
        CM.merge_by_key(base, dup, "order_id")


def test_abc_single_dominant_product_is_b(spark):
    rows = [("big", 80.0), ("small1", 10.0), ("small2", 10.0)]
    df = spark.createDataFrame([(str(i), n, s) for i, (n, s) in enumerate(rows)],
                               "order_id string, product_name string, sales double").withColumn(
        S.SALES, F.col(S.SALES).cast(S.MONEY)).withColumn(S.GROSS_PROFIT, F.col(S.SALES)).withColumn(
        S.UNITS, F.lit(1))
    classes = {r[S.PRODUCT_NAME]: r["abc_class"] for r in RPT.product_abc(RPT.product_summary(df)).collect()}
    assert classes["big"].startswith("B")          # alone above 70 %
    assert classes["small2"].startswith("C")        # last one lands in C, cum % clipped at 100


def test_dirty_numeric_text(spark):
    vals = [("$1,234.56", "1,000"), ("$99.00", "2,500"), ("500.25", "10")] + [("$10.00", "5")] * 7
    df = spark.createDataFrame(vals, "sales string, units string")
    out = C.dirty_numeric(df, money_cols=[S.SALES]).collect()
    assert out[0][S.SALES] == 1234.56 and out[0][S.UNITS] == 1000
    assert dict(C.dirty_numeric(df, money_cols=[S.SALES]).dtypes)[S.UNITS] == "int"


def test_three_row_health_frame_and_fix_all(spark):
    rows = [(1, 10, "Choc A", "2024-01-01", "2024-01-05", "Std", 10.0, 1),
            (1, 10, "Choc A", "2024-01-02", "2024-01-06", "Std", None, 2),
            (2, 11, "Mystery", "2024-01-09", "2024-01-03", "Std", 30.0, 3)]
    df = spark.createDataFrame(rows, "order_id long, product_id long, product_name string, order_date string, "
                                     "ship_date string, ship_mode string, sales double, units long")
    names = literal_table(spark, [("Choc A", "F1")], [S.PRODUCT_NAME, S.FACTORY])
    rep = Q.hl_report(df, names).first()
    assert rep["health_score"] < 100 and rep["missing_columns_count"] == 8
    fixed, applied = RP.fix_all(df, names)
    assert applied[0] == "fix_missing_cols" and "drop_duplicates" in applied
    assert fixed.count() == 2 and fixed.filter(F.col(S.SALES).isNull()).count() == 0
    swapped = fixed.filter(F.col(S.ORDER_ID) == 2).first()
    assert swapped[S.ORDER_DATE] == "2024-01-03"


def test_empty_table_health_is_zero(spark):
    df = spark.createDataFrame([], "order_id long, product_id long, sales double")
    names = literal_table(spark, [("x", "F1")], [S.PRODUCT_NAME, S.FACTORY])
    assert Q.hl_report(df, names).first()["health_score"] == 0


def test_exact_quantiles_match_percentile(spark):
    from lanecraft.functions.quantiles import exact_quantiles
    df = spark.range(1001).select(((F.col("id") * 7919) % 1000 / 7.0).alias("x"))
    a = exact_quantiles(df, "x", [0.01, 0.25, 0.5, 0.99]).first()
    b = df.agg(*[F.percentile("x", p).alias(f"q{i}") for i, p in enumerate([0.01, 0.25, 0.5, 0.99])]).first()
    assert list(a) == list(b)


def test_running_total_matches_window(spark):
    from lanecraft.functions.windows import running_total
    from pyspark.sql import Window
    df = spark.range(500).select(F.col("id"), ((F.col("id") * 37) % 101).alias("v"))
    a = {r["id"]: r["rt"] for r in running_total(df, [F.col("v").desc(), F.col("id")], "v", "rt", 7).collect()}
    w = Window.orderBy(F.col("v").desc(), F.col("id")).rowsBetween(Window.unboundedPreceding, 0)
    b = {r["id"]: r["rt"] for r in df.withColumn("rt", F.sum("v").over(w)).collect()}
    assert a == b


def test_exact_quantiles_distributed_path(spark):
    from lanecraft.functions import quantiles as QN
    df = spark.range(2000).select((((F.col("id") * 7919) % 1013) / 3.0).alias("x"))
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    a = QN.exact_quantiles(df, "x", probs).first()
    b = df.agg(*[F.percentile("x", p).alias(f"q{i}") for i, p in enumerate(probs)]).first()
    assert list(a) == list(b)


# ── numbers and encodings as they come in raw files ─────────────────────────

def test_units_written_as_decimals_and_nan_texts(spark):
    from lanecraft import schema as S
    from lanecraft.operators import clean as C
    df = spark.createDataFrame([("3.0", "NaN"), ("4", "10"), ("5", "20"), ("2.0", "inf")], f"{S.UNITS} string, {S.SALES} string")
    cast = C.cast_numeric(df)
    assert [tuple(r) for r in cast.collect()] == [(3.0, None), (4.0, 10.0), (5.0, 20.0), (2.0, None)]
    filled = [tuple(r) for r in C.fill_median(cast).collect()]
    assert sorted(filled) == [(2.0, 15.0), (3.0, 15.0), (4.0, 10.0), (5.0, 20.0)]


def test_running_total_beyond_the_sampling_size(spark):
    """Equal to a plain running sum with payload columns, with and without exchange reuse and AQE."""
    from pyspark.sql import functions as F
    from lanecraft.functions.windows import running_total
    n = 200_000
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), F.col("id"), (F.col("id") % 7).alias("v"),
                               F.lit("payload").alias("p"))
    import numpy as np
    for reuse in ("true", "false"):
        for aqe in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            try:
                got = running_total(df, [F.col("k").asc(), F.col("id").asc()], "v", "cum").select("k", "id", "v", "cum").toPandas()
            finally:
                spark.conf.unset("spark.sql.exchange.reuse")
                spark.conf.unset("spark.sql.adaptive.enabled")
            got = got.sort_values(["k", "id"])
            assert len(got) == n and (np.cumsum(got["v"].to_numpy()) == got["cum"].to_numpy()).all()


def test_quantiles_of_many_distinct_values(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from lanecraft.functions.quantiles import column_quantiles
    df = spark.range(150_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                     F.when(F.col("id") < 0, F.lit(1.0)).alias("empty"))
    r = column_quantiles(df, {"a": [0.25, 0.99], "b": [0.5], "empty": [0.5]}).first()
    a = df.select("a").toPandas()["a"].to_numpy()
    assert np.isclose(r["q0_0"], np.quantile(a, 0.25), rtol=1e-12) and np.isclose(r["q0_1"], np.quantile(a, 0.99), rtol=1e-12)
    assert r["q1_0"] == 2.0 and r["q2_0"] is None


def test_raw_reader_na_texts_and_latin1(spark, tmp_path):
    from lanecraft import schema as S
    from lanecraft.sources import files as IO
    head = ",".join(S.BASE_COLUMNS)
    row = {c: "x" for c in S.BASE_COLUMNS} | {S.ORDER_DATE: "2024-01-05", S.SHIP_DATE: "07-01-2024", S.CITY: "Zürich", S.COST: "N/A"}
    text = head + "\n" + ",".join(row[c] for c in S.BASE_COLUMNS) + "\n"
    for name, enc in (("u", "utf-8"), ("l", "latin-1")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(enc))
        r = IO.read_dayfirst_csv(spark, str(tmp_path / f"{name}.csv")).first()
        assert r[S.CITY] == "Zürich" and r[S.COST] is None
        assert str(r[S.ORDER_DATE]) == "2024-01-05" and str(r[S.SHIP_DATE]) == "2024-01-07"


def test_fix_all_applies_all_seven_repairs(spark):
    """A frame with every fault, repaired step by step in pandas."""
    import datetime as dt
    import numpy as np
    import pandas as pd
    from lanecraft import schema as S
    from lanecraft.operators import quality as Q, repair as RP
    rng = np.random.default_rng(3)
    n = 150
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=int(k))
    df = pd.DataFrame({
        S.ROW_ID: [f"r{i:03d}" for i in range(n)], S.ORDER_ID: rng.integers(0, 60, n), S.PRODUCT_ID: rng.integers(0, 4, n),
        S.ORDER_DATE: [day(k) for k in rng.integers(0, 300, n)], S.CUSTOMER_ID: rng.integers(0, 9, n), S.COUNTRY: "US", S.CITY: "c",
        S.STATE: [None if i % 17 == 0 else "s" for i in range(n)], S.DIVISION: "d", S.REGION: "r",
        S.PRODUCT_NAME: [f"p{i % 5}" for i in range(n)], S.SALES: [None if i % 13 == 0 else float(i) for i in range(n)],
        S.UNITS: 1, S.GROSS_PROFIT: 1.0, S.COST: 2.0, S.LEAD_TIME: [float(i % 5) - 1 for i in range(n)],
        S.FACTORY: ["f" if i % 3 else None for i in range(n)]})
    df[S.SHIP_DATE] = [d + dt.timedelta(days=(i % 4) - 1) for i, d in enumerate(df[S.ORDER_DATE])]
    df.loc[7, S.SALES] = 1e6
    schema = (f"{S.ROW_ID} string, {S.ORDER_ID} long, {S.PRODUCT_ID} long, {S.ORDER_DATE} date, {S.CUSTOMER_ID} long, {S.COUNTRY} string, {S.CITY} string, "
              f"{S.STATE} string, {S.DIVISION} string, {S.REGION} string, {S.PRODUCT_NAME} string, {S.SALES} double, {S.UNITS} int, {S.GROSS_PROFIT} double, "
              f"{S.COST} double, {S.LEAD_TIME} double, {S.FACTORY} string, {S.SHIP_DATE} date")
    raw = spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in df.itertuples(index=False, name=None)], schema)
    names = spark.createDataFrame([("p0", "f"), ("p1", "f")], f"{S.PRODUCT_NAME} string, {S.FACTORY} string")
    fixed, applied = RP.fix_all(raw, names, "Plant", "Road")
    assert applied == list(RP.FIXES) and len(applied) == 7
    want = df.copy()
    want[S.SHIP_MODE] = "Road"
    want[S.SALES] = want[S.SALES].fillna(want[S.SALES].median())
    want[[S.STATE, S.FACTORY]] = want[[S.STATE, S.FACTORY]].fillna("Unknown")
    want = want.sort_values(S.ROW_ID).drop_duplicates([S.ORDER_ID, S.PRODUCT_ID], keep="first")
    swap = want[S.SHIP_DATE] < want[S.ORDER_DATE]
    want.loc[swap, [S.ORDER_DATE, S.SHIP_DATE]] = want.loc[swap, [S.SHIP_DATE, S.ORDER_DATE]].to_numpy()
    want[S.LEAD_TIME] = want[S.LEAD_TIME].clip(lower=0.5)
    want[S.SALES] = want[S.SALES].clip(upper=want[S.SALES].quantile(0.99))
    got = fixed.toPandas().sort_values(S.ROW_ID).reset_index(drop=True)[list(want.columns)]
    want = want.reset_index(drop=True)
    assert len(got) == len(want)
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist() or np.allclose(got[c].astype(float), want[c].astype(float)), c
    assert Q.health_checks(fixed, names).where("check in ('schema', 'nulls', 'duplicates', 'chronology', 'nonpositive_lead') and count > 0").count() == 0
