"""Version store and streaming ingest: the durability claims."""

import os

from pyspark.sql import functions as F

from lanecraft.plans import featured as FT
from lanecraft.plans.materialize import shared_path
from lanecraft.sources.versions import VersionStore
from lanecraft.streaming import audit_stream as AS


def test_snapshot_and_rollback(spark, sf):
    vs = VersionStore(spark, shared_path(spark, "test-versions"))
    f = FT.featured(spark, sf)
    full = f.count()
    base = FT.base(spark, sf)
    vs.commit(f, base, reason="load")
    v1 = vs.snapshot("full")
    vs.commit(f.filter(F.col("ship_year") <= 1998), base.limit(5), reason="trim")
    assert vs.current().count() < full
    assert vs.rollback("v_missing")[0] is False
    ok, _ = vs.rollback(v1)
    assert ok and vs.current().count() == full and vs.current("cleaned").count() == base.count()
    listed = vs.versions().collect()
    assert len(listed) == 2 and v1 in listed[0]["description"]   # newest first


def test_stream_restart_does_not_duplicate(spark, sf):
    root = shared_path(spark, "test-audit-stream")
    table, ckpt = f"{root}/table", f"{root}/_checkpoint"
    AS.start(spark, sf, table, ckpt, file_glob="events*.parquet").awaitTermination()
    n1 = AS.read_table(spark, table).count()
    # a restart on the same checkpoint finds no new files: nothing is appended twice
    AS.start(spark, sf, table, ckpt, file_glob="events*.parquet").awaitTermination()
    n2 = AS.read_table(spark, table).count()
    events = spark.read.parquet(os.path.join(sf, "events.parquet")).count()
    assert n1 == n2 == events
