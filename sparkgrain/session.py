"""The session contract every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sparkgrain", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, ANSI casts and adaptive execution; cluster settings stay with spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
