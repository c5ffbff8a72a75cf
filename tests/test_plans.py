"""Plan shape: the choices the operators rely on at scale."""

from pyspark.sql import functions as F

from lanecraft.operators import filters as FL
from lanecraft.plans import featured as FT
from lanecraft.sources import testdata as td


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lineitem_is_never_the_broadcast_side(spark, sf):
    p = td.shipments(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in p
    # the broadcast exchanges carry dimensions only
    for line in p.splitlines():
        if "BroadcastExchange" in line:
            assert "l_orderkey" not in line


def test_filters_reach_the_scan(spark, sf):
    f = FT.featured(spark, sf)
    q = FL.apply_filters(f, {"factories": ["Factory#1"], "lead_time_range": (1, 500)})
    p = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in p and "factory" in p.split("PushedFilters")[1][:400]


def test_column_pruning_on_featured_scan(spark, sf):
    from lanecraft.operators import kpi as K
    p = K.factory_performance(FT.featured(spark, sf))._jdf.queryExecution().executedPlan().toString()
    rs = p.split("ReadSchema: ")[1].split("\n")[0] if "ReadSchema: " in p else p
    assert "ship_month_name" not in rs


def test_year_filters_prune_partitions(spark, sf):
    f = FT.featured(spark, sf)
    q = FL.apply_filters(f, {"years": [1996, 1998], "lead_time_range": (1, 500)})
    p = plan(q)
    part = p.split("PartitionFilters: [")[1].split("]")[0]
    assert "ship_year" in part
    read = q.select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < len(f.inputFiles())


def test_month_filters_meet_sorted_files(spark, sf):
    import pyarrow.parquet as pq

    f = FT.featured(spark, sf)
    ranges = []
    for name in f.inputFiles():
        group = pq.ParquetFile(name.replace("file://", "")).metadata.row_group(0)
        col = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "ship_month")
        ranges.append((col.statistics.min, col.statistics.max))
    assert sum(a > 3 for a, _ in ranges) > 0  # files a filter on the first quarter skips
