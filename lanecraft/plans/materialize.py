"""Cut lineage by writing Parquet into the shared checkpoint folder.

``materialize`` writes a DataFrame as a Parquet table under the folder named
by ``spark.checkpoint.dir`` (shared storage on a cluster) and reads it back,
so later stages scan a columnar table — with column pruning and predicate
pushdown — instead of recomputing joins, and survive executor loss.  The
folder is removed when the session's file system closes.

A derived side (medians, scores) that is joined back to the fact is
materialized too and joined without a hint: its file size is then known, so
Spark broadcasts it under ``spark.sql.autoBroadcastJoinThreshold`` and
shuffle-joins it beyond (AQE splits skewed partitions).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame

from lanecraft.session import ensure_checkpoint_dir

_PARTITIONS = "spark.sql.shuffle.partitions"
#: bytes of Parquet a shuffle partition takes; as rows in memory they are about ten times as many
SHUFFLED_BYTES = 12 << 20


def shared_path(spark, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/lanecraft/{name}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored_bytes(df: DataFrame) -> int:
    """Bytes that a scan of files is to read, as Spark's planner estimates them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(spark, stored: int, each: int = SHUFFLED_BYTES) -> int:
    """Shuffle partitions for so many bytes of Parquet: at least the session's, more if a task's part would not fit its memory."""
    return max(1, int(spark.conf.get(_PARTITIONS)), -(-stored // each))


@contextmanager
def shuffle_partitions(spark, n: int | None):
    """The session's number of shuffle partitions for the jobs inside (None: as it is)."""
    if not n:  # jobs of other threads may run in the session
        yield
        return
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(n))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None,
                partitions: int | None = None) -> DataFrame:
    """``sort_by``: rows of a task are written in the order of ``partition_by`` and these columns; ``partitions``: shuffle
    partitions of the job that writes."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if sort_by:
        df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with shuffle_partitions(spark, partitions):
        w.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def join_back(big: DataFrame, small: DataFrame, on, how: str = "left", name: str = "side") -> DataFrame:
    """Join a derived side back to its fact, by its written size."""
    return big.join(materialize(small, name), on, how)
