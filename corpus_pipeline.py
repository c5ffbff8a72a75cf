"""Corpus pipeline: language ID, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last one:
packed pieces); its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanecraft.llm import lang_id, minhash, mixing, packing, suffix_dedup
from lanecraft.llm.common import column, prepare, read, sized, stage
from lanecraft.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language (null text, no letters); ``lang`` becomes the predicted language."""
    prepare(spark)
    refs = lang_id.fit(docs)
    whole = docs.select(F.struct(*map(column, docs.columns)).alias("row"), F.col("text"))
    found = lang_id.predict(whole, refs, ["row"]).where(F.col("lang_pred") != lang_id.UNKNOWN)
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest id.  Of rows that repeat an id and its text the
    least row stays; rows of one id with different texts are documents of their own; rows without an id stay."""
    prepare(spark)
    columns = [column(c) for c in docs.columns]
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("__t"))
    variants = stage(texts.groupBy("doc_id").agg(F.min("__t").alias("lo"), F.max("__t").alias("hi")).where("lo < hi").select("doc_id"), "variants")
    mixed = not variants.isEmpty()
    keyed = docs.withColumn("__key", F.col("doc_id"))
    if mixed:  # id and digest of the text name a document; other ids have no second text
        many = sized(variants.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__many")), 24)
        own = F.when(F.col("doc_id").isNotNull(), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.when(
            F.col("__many"), F.md5(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("")))).otherwise("")))
        keyed = docs.join(many, F.col("doc_id") == F.col("__id"), "left").withColumn("__key", own).select(*columns, "__key")
    found = minhash.near_duplicates(keyed.select("__key", "text"), "__key").where("__key is not null")
    if mixed:  # the smallest document of a group, not its smallest key
        ids = keyed.where("__key is not null").groupBy("__key").agg(F.min("doc_id").alias("doc_id"))
        groups = stage(found.join(ids, "__key").groupBy("component_id", "doc_id", "__key").agg(F.count(F.lit(1)).alias("__n")), "groups")
        least = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key", "__n")).alias("x"))
        keep = stage(least.select("x.__key", "x.__n"), "kept")
    else:
        keep = stage(found.where("kept").groupBy("__key").agg(F.count(F.lit(1)).alias("__n")), "kept")
    once, again = keep.where("__n = 1").select("__key"), keep.where("__n > 1").select("__key")
    single = keyed.join(sized(once, 56), "__key", "left_semi")
    repeated = keyed.join(sized(again, 56), "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*columns)).alias("row"))
    repeated = repeated.select(*_fields(docs))
    return single.select(*columns).unionByName(repeated).unionByName(docs.where("doc_id is null")).select(*columns)


def _fields(docs: DataFrame, row: str = "row") -> list:
    """The columns of ``docs`` out of a struct that holds them."""
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes or more go from the texts; texts that lose everything go."""
    prepare(spark)
    cut = suffix_dedup.remove_repeats(docs).where("text <> '' or n_removed = 0")
    other = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return cut.select("doc_id", "text", *other, F.length("text").cast("long").alias("n_chars")).select(*map(column, docs.columns))


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    prepare(spark)
    taken = mixing.mix(docs, whole=True).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*_fields(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the taken documents, placed in sequences of 2048 tokens."""
    prepare(spark)
    return packing.best_fit_pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("source_mix", target_weights),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
