"""Landed tables: reading them, and giving them the ingestion columns that deduplication and quarantine need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "orc")


def landed(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A landed table. CSV columns stay text, as a mapping's chains start from text; JSON needs no schema but is
    read twice without one."""
    if fmt not in FORMATS:
        raise ValueError(f"no format {fmt!r}: {', '.join(FORMATS)}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        return reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return reader.format(fmt).load(path)


def registered(spark: SparkSession, name: str, namespace: str = "bronze") -> DataFrame:
    """A table of the session's catalog."""
    return spark.table(f"{namespace}.{name}" if namespace else name)


def acknowledged(rows: DataFrame, load_id: str, ingested_at: Column, row_id: Column) -> DataFrame:
    """Rows with the three ingestion columns, made from what they hold (no clock, no counter)."""
    return rows.withColumns({"_load_id": F.lit(load_id), "_ingested_at": ingested_at.cast("timestamp_ntz"), "_source_row_id": row_id.cast("string")})
