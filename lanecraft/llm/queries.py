"""Registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanecraft.llm import (chat, lang_id, merkle, minhash, mixing, packing, periodic, pii, rp_forest, suffix_dedup,
                           token_count, topk, wrapper)
from lanecraft.llm.common import read

#: Folder-independent lookup of a public tokenizer file; jobs may pass another path to the operators.
def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    refs = lang_id.fit(docs.where(~held_out()))
    return lang_id.predict(docs, refs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.windows(turns.unionByName(more))).withColumnRenamed("conv", "conv_id")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    own = F.col("sources")[0]
    return mixed.select("doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"),
                        (F.col("size") * F.col("copies")).alias("taken"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, keep="none", with_text=False)


def op9_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(read(spark, sf_dir, "pages"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op11_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = periodic.periodic_runs(docs, extra=periodic.checksum(), rule=periodic.folded)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), merkle.third())
