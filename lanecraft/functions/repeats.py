"""Rows whose key occurs once, set apart before anything is shuffled.

To drop copies, only rows that may have one must meet.  A first pass counts 64-bit digests of the keys
(the shuffle carries the digests alone); those counted more than once are broadcast while they are few, and rows with
one of them go on as ``again``.  Equal keys have equal digests, so every row of a repeated key is there; a row that shares
a digest by chance is one row more to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lanecraft.plans.materialize import materialize

#: Digests counted more than once that are broadcast at most; beyond, whole rows are shuffled.
MOST_REPEATED = 3_000_000
_FLOATS = (T.FloatType, T.DoubleType)
_COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.UserDefinedType)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _plain(df: DataFrame, name: str) -> Column:
    c = _column(name)
    return c + F.lit(0.0).cast(df.schema[name].dataType) if isinstance(df.schema[name].dataType, _FLOATS) else c  # -0.0 equals 0.0


def parted(df: DataFrame, keys: list[str], most: int = MOST_REPEATED) -> tuple[DataFrame, DataFrame] | None:
    """(once, again): rows whose key occurs once and all others; null keys are equal.  None if that can't be told from a
    digest or too many keys repeat.  Reads ``df`` while planning: its rows must be the same each time."""
    names = [c.lower() for c in df.columns]
    if df.isStreaming or "__h" in names or len(set(names)) < len(names) or any(isinstance(df.schema[k].dataType, _COMPLEX) for k in keys):
        return None
    digest = F.xxhash64(*[_plain(df, k) for k in keys])
    counted = df.select(digest.alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    many = materialize(counted.where("n > 1").select("__h"), "repeats")
    if many.count() > most:
        return None
    marked = df.withColumn("__h", digest)
    return tuple(marked.join(F.broadcast(many), "__h", how).select(*map(_column, df.columns)) for how in ("left_anti", "left_semi"))
