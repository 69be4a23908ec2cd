"""The registered query of each operator, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrain.llm import brown, chat, jpeg, jpeg_source, mixing, neardup, packing, quality, sharding, template, vafile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id ASK_EVERY divides, held against all vectors."""
    return vafile.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % vafile.ASK_EVERY == 0).withColumn("distance", F.round("distance", 6))


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_targets(table(spark, sf_dir, "conversations"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op4_brown_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.perplexity(table(spark, sf_dir, "documents"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.slots(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balance(table(spark, sf_dir, "documents")).rates


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images: every embedding is written as a progressive JPEG first, and all of these are decoded."""
    return jpeg.tensors(jpeg_source.pictures(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_va_file_topk, op2_prefix_targets, op3_byte_shards, op4_brown_class_ngrams, op5_length_buckets, op6_template_slots, op7_ngram_jaccard_join, op8_quality_classifier, op9_entropy_balancing, op10_progressive_jpeg)
}

ORACLES: dict[str, str] = {"op1_va_file_topk": vafile.SQL, "op2_prefix_targets": chat.SQL, "op3_byte_shards": sharding.SQL, "op5_length_buckets": packing.SQL, "op7_ngram_jaccard_join": neardup.SQL}
