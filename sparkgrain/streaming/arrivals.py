"""Arrivals as a stream: the same pipeline on micro-batches, and windowed counts with late data bounded."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkgrain.operators import rejects as J
from sparkgrain.operators.silver import evaluate
from sparkgrain.operators.steps import Registry
from sparkgrain.plans.spec import Project
from sparkgrain.sources.store import Store


def deduplicated(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows once a key, as long as repeats come within the watermark; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, time: str, width: str, by: list[str], value: str, late: str | None = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and columns; a window comes out when the watermark has passed it. late: None
    for a stream that has its watermark already."""
    grouped = (stream.withWatermark(time, late) if late else stream).groupBy(F.window(time, width).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str | None = "1 hour") -> DataFrame:
    """Sessions by columns, which a pause of `gap` ends: start, end and rows of each."""
    grouped = (stream.withWatermark(time, late) if late else stream).groupBy(F.session_window(time, gap).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def into_entity(stream: DataFrame, project: Project, entity: str, store: Store, checkpoint: str, registry: Registry | None = None, parents: dict[str, DataFrame] | None = None) -> StreamingQuery:
    """Run an entity's pipeline on each micro-batch: kept rows are upserted by key, diverted ones into the rejects.

    A batch that runs again after a failure gives the same tables, as both writes go by key.
    """
    e, source = project.entities[entity], project.mappings_of(entity)[0].source

    def batch(rows: DataFrame, number: int) -> None:
        held = store.full("silver", f"{entity}__batch", rows)
        s = evaluate(project, registry or Registry(), entity, {source: held}, parents)
        store.by_key("silver", entity, s.kept, e.key)
        if s.diverted is not None:
            new = J.reject_rows(s, source)
            name = f"{entity}__reject"
            store.full("silver", name, J.upsert_rejects(store.read("silver", name), new) if store.exists("silver", name) else new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stamped(stream: DataFrame, load_id: str, at: datetime) -> DataFrame:
    return stream.withColumn("_load_id", F.lit(load_id)).withColumn("_ingested_at", F.lit(at).cast("timestamp_ntz"))
