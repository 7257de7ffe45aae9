"""Queries op1 to op10: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, langid_ppm, media_avi, mixing, packing, quality_gam, sharding, simhash, substring_recompression, suffix_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.media_rows(_documents(spark, sf_dir))


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_recompression.earlier_passages(_documents(spark, sf_dir)).drop("spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_documents(spark, sf_dir))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _documents(spark, sf_dir), langid_ppm.held_out(F.col("doc_id"))
    model = quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    scored = quality_gam.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_documents(spark, sf_dir), tokenizer_path()))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(_documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_documents(spark, sf_dir)).drop("spans")


def op10_langid_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid_ppm.predict(docs, langid_ppm.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_simhash": op2_simhash,
    "op3_media_avi": op3_media_avi,
    "op4_recompression": op4_recompression,
    "op5_mixing": op5_mixing,
    "op6_quality_gam": op6_quality_gam,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_langid_ppm": op10_langid_ppm,
}

ORACLE_SQL: dict[str, str] = {"op5_mixing": mixing.ORACLE}
