"""Documents to training batches: filter by quality, drop near copies, mix sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgrain.llm import mixing, neardup, packing, quality
from sparkgrain.llm.common import forget, settled


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with their columns.

    A null or empty text goes; equal rows stay or go together; a null source or language is a site of its own; other
    columns may have any names. Without labels every text with a word stays. No rows give no rows.
    """
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the lowest id, with its columns.

    Rows with a null id, a null or wordless text stay; rows repeated under one id are cut to one of each text; texts
    of any length are compared whole. No rows give no rows.
    """
    return neardup.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources and languages meet their token targets, with their columns.

    A null or empty text goes; a null source or language is a group; equal rows get equal copies; targets that can't be
    met warn and are met as nearly as can be. No rows give no rows.
    """
    return mixing.resample(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of each document.

    A null or empty text is in no batch, a text beyond the budget in one of its own; a null id is carried; copies of a
    row each take a slot, apart from each other. No rows give no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_batches),
]

#: SQL can express neither the fitted classifier nor Newton's steps; the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage but the last returns is written and read again.

    What a stage wrote on its way, and its predecessor's rows, are deleted once its own rows are whole.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, rows=docs: stage(spark, rows, sf_dir), "pipeline-stage")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
