"""One query per operator: the operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.llm import chat, decontaminate, langid, lm, packing, quality, secrets, shards, simhash, toxicity
from msgrisk.llm.common import fold_col, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of every line of every conversation, learned where crc32(conv_id as text) mod 5 is not 0."""
    out = chat.format_chat(chat.transcripts_from(table(spark, sf_dir, "conversations")), fold_col("conv_id", 5) != 0)
    return out.withColumnRenamed("part", "turn").withColumnRenamed("known_role", "role_true").withColumn("held_out", fold_col("conv_id", 5) == 0).drop("text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise_order(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("sentences")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_chat_format, op2_simhash, op3_secrets, op4_decontaminate, op5_lm_score, op6_language_id, op7_quality, op8_token_shards, op9_toxicity, op10_packing)
}

ORACLE_SQL = {"op4_decontaminate": decontaminate.ORACLE_SQL, "op7_quality": quality.oracle_sql()}
