"""The registered queries of this subpackage, with production parameters and whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, embeddings, jaccard, lm, mixing, quality, substring, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference(_read(spark, sf_dir, "conversations"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"), least=1)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_read(spark, sf_dir, "documents"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_resampling, op3_toxicity, op4_decontaminate, op5_preference_format, op6_ngram_jaccard_join, op7_lm_scoring, op8_substring_dedup, op9_warc_salvage, op10_embedding_near_dedup)}
SQL = {"op1_mix_sources": mixing.SQL, "op4_decontaminate": decontaminate.SQL, "op5_preference_format": chat.SQL, "op6_ngram_jaccard_join": jaccard.SQL, "op8_substring_dedup": substring.SQL, "op9_warc_salvage": warc.SQL}
