"""What the shared tables cost: shuffles that follow the input, narrow rows, small files."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lanecraft import schema as S
from lanecraft.functions import repeats
from lanecraft.operators import clean as C, repair as RP
from lanecraft.plans import featured as FT
from lanecraft.plans.materialize import materialize, partitions_for, shared_path, shuffle_partitions
from lanecraft.sources import files as IO, testdata as td


def test_shuffle_partitions_follow_the_input(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(spark, 10) == own
    assert partitions_for(spark, 10_000 << 20) == 834 > own
    with shuffle_partitions(spark, 834):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "834"
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == own


def test_shared_tables_are_compressed(spark, monkeypatch):
    from lanecraft.plans import materialize as M
    made = []
    monkeypatch.setattr(M, "shared_path", lambda s, n: made.append(shared_path(s, n)) or made[-1])
    assert materialize(spark.range(10), "zstd").count() == 10
    file = glob.glob(made[0].replace("file:", "") + "/*.parquet")[0]
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


def test_a_part_table_too_large_to_broadcast_gives_the_same_fact(spark, sf):
    def digest(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()

    want, before = digest(td.shipments(spark, sf)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert digest(td.shipments(spark, sf)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_written_lines_are_the_tables_own_columns(spark, sf, monkeypatch):
    from lanecraft.plans import materialize as M
    made, where = [], M.shared_path
    monkeypatch.setattr(M, "shared_path", lambda s, n: made.append(where(s, n)) or made[-1])
    FT.refresh(sf)
    fact = FT.shipments(spark, sf)
    assert len(made) == 1
    file = glob.glob(made[0].replace("file:", "") + "/*.parquet")[0]
    assert pq.read_schema(file).names == td.JOINED and S.ROW_ID not in td.JOINED
    assert fact.columns == td.shipments(spark, sf).columns
    want = td.shipments(spark, sf)
    assert fact.exceptAll(want).isEmpty() and want.exceptAll(fact).isEmpty()


def test_featured_files_hold_ranges(spark, sf):
    f = FT.featured(spark, sf).withColumn("__file", F.input_file_name())
    per = f.groupBy("ship_year", "__file").agg(F.min("ship_month").alias("lo"), F.max("ship_month").alias("hi"))
    # files of one year meet at most in a month
    rows = sorted((r.ship_year, r.lo, r.hi) for r in per.collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(rows, rows[1:]))
    assert set(S.BASE_COLUMNS) < set(f.columns)


def test_scratch_csv_is_compressed_and_reads_back(spark):
    rows = spark.range(2000).selectExpr("id AS a", "concat(' order, \"', id, '\"') AS b")
    path = IO.scratch_csv(rows, "test-csv")
    assert glob.glob(path.replace("file:", "") + "/*.csv.gz")
    assert sorted(IO.read_raw_csv(spark, path, rows.schema).collect()) == sorted(rows.collect())


# ── copies dropped without shuffling the others ──────────────────────────────

ROWS = [(1, "a", 0.0), (1, "a", -0.0), (2, None, None), (2, None, None), (None, "a", 1.0), (None, "a", float("nan")), (None, "a", float("nan")),
        (3, "b", 2.0), (4, "", 5.0), (4, None, 5.0)]


def test_full_dedup_shuffles_only_rows_that_may_have_a_copy(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, x double")
    got = C.dedup_full(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.distinct().collect()))
    assert len(got.collect()) == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    once, again = plan.split("LeftSemi")[0], plan.split("LeftSemi")[1]
    assert "LeftAnti" in once and "Exchange hashpartitioning" not in once.split("HashAggregate")[0] and again


def test_first_row_a_key_equals_the_plain_way(spark):
    df = spark.createDataFrame([(1, 7, "b"), (1, 7, "a"), (1, 8, "c"), (None, 7, "e"), (None, 7, "d"), (None, None, "f"), (2, None, "g")],
                               f"`{S.ORDER_ID}` long, `{S.PRODUCT_ID}` long, `{S.ROW_ID}` string")
    plain = RP._first_rows(df, [S.ORDER_ID, S.PRODUCT_ID], S.ROW_ID)
    got = RP.drop_duplicates(df)
    assert sorted(r[2] for r in got.collect()) == sorted(r[2] for r in plain.collect()) == ["a", "c", "d", "f", "g"]
    assert got.schema == df.schema
    assert "LeftAnti" in got._jdf.queryExecution().executedPlan().toString()


def test_many_repeated_keys_go_the_plain_way(spark):
    df = spark.range(20).union(spark.range(20))
    assert repeats.parted(df, ["id"], most=19) is None
    once, again = repeats.parted(df.union(spark.range(30, 35)), ["id"], most=20)
    assert sorted(r[0] for r in once.collect()) == list(range(30, 35)) and again.count() == 40
    assert repeats.parted(df.selectExpr("array(id) AS a"), ["a"]) is None
