"""Shared helpers of the training-data operators: table access, staged tables, Arrow buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanecraft.session import ensure_checkpoint_dir

#: Rows of one Arrow batch sent to Python.  Text rows are long, so the Spark default (10,000) would put
#: hundreds of MB into one batch.
BATCH_ROWS = "256"
#: Bytes of one Arrow batch (rows of packed blocks are large): batches live outside the executor's heap.
BATCH_BYTES = "8m"
#: Python workers regroup batches until they hold about this many bytes of text.
GROUP_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Once per context: batches sized for text, and the package sent to the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_lanecraft_sent", False):
        return
    root = Path(__file__).resolve().parent.parent
    # built beside the driver, which serves it to the executors as long as the session lives
    folder = tempfile.mkdtemp(prefix="lanecraft-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "lanecraft.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._lanecraft_sent = True


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    The lineage ends there: a lost executor costs a re-read.  The folder is removed when the driver's
    file system closes (session end).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as numpy views; null is the empty text."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


def grouped(batches, column: str, target: int = GROUP_BYTES):
    """Regroup record batches until ``column`` holds about ``target`` bytes (one long row may exceed it)."""
    held, size = [], 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        offsets = text_bytes(col)[1]
        start = 0
        while start < len(col):
            room = target - size
            end = int(np.searchsorted(offsets, offsets[start] + room, side="right")) - 1
            end = max(start + 1, min(end, len(col))) if not held else max(start, min(end, len(col)))
            if end > start:
                held.append(batch.slice(start, end - start))
                size += int(offsets[end] - offsets[start])
                start = end
            if start < len(col) or size >= target:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    release()


def release() -> None:
    """Give freed memory back to the system: Spark keeps the Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


#: A staged side up to this size may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 48 << 20


def sized(staged: DataFrame, row_bytes: int, column: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint behind a check of the side's size (rows x bytes a row, and the bytes of a binary
    ``column``), else the side as it is."""
    return F.broadcast(staged) if side_bytes(staged, row_bytes, column) <= limit else staged


def block_pairs(blocks: DataFrame, key: list[str], i: str, n: str, x: str) -> DataFrame:
    """Every pair i <= j of the blocks (key, i, n: blocks of the key, x) of one key: key, i, j, x, y.

    The blocks of a key form ``g`` ranges and every pair of ranges is a cell, so the pairs of one hot key spread over all
    tasks; a block is copied ``g + 1`` times, ``g`` being at most about the root of twice the shuffle partitions."""
    g = F.least(F.col(n), F.ceil(F.sqrt(F.lit(2.0 * partitions(blocks.sparkSession))))).cast("int")
    own = F.floor(F.col(i) * g / F.col(n)).cast("int")
    left = blocks.select(*key, own.alias("lo"), F.explode(F.sequence(own, g - 1)).alias("hi"), F.col(i).alias("i"), F.col(x).alias("x"))
    right = blocks.select(*key, F.explode(F.sequence(F.lit(0), own)).alias("lo"), own.alias("hi"), F.col(i).alias("j"), F.col(x).alias("y"))
    return left.join(right, [*key, "lo", "hi"]).where("i <= j").drop("lo", "hi")


def side_bytes(staged: DataFrame, row_bytes: int, column: str | None = None) -> int:
    more = F.sum(F.octet_length(column)) if column else F.lit(0)
    n, held = staged.agg(F.count(F.lit(1)), F.coalesce(more, F.lit(0)) if column else F.max(F.lit(0))).first()
    return n * row_bytes + (held or 0)
