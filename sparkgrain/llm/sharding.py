"""Contiguous shards of equal bytes out of global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgrain.llm.common import c, written

SHARD_BYTES = 16 << 20


def byte_shards(docs: DataFrame, order: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Assign documents, in the order of a column, to shards of about shard_bytes.

    Gives doc_id, n_bytes (UTF-8), start_byte (bytes of all documents before it) and shard. There are
    ceil(total / shard_bytes) shards, cut at equal targets: a document belongs to the one in which its
    first byte falls, so a shard misses its target by no more than one document at either end.

    Only (order, bytes) rows move: they are range-partitioned once, each partition's total is summed,
    and the exclusive sum of these totals (a row for each partition) is added to running sums inside
    the partitions. No task sees more than its own range.

    Nulls: a null text has 0 bytes; null orders come first. Rows equal in order and in bytes are
    interchangeable, and each takes its own place. When no row has a byte, all are in shard 0. Other
    columns are not carried, so none clash. No rows give no rows.
    """
    rows = docs.select(c(order).alias("doc_id"), F.coalesce(F.octet_length(c(text)), F.lit(0)).cast("bigint").alias("n_bytes"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "n_bytes").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "shard-ranges")
    totals = ranged.groupBy("part").agg(F.sum("n_bytes").alias("bytes"))
    every = Window.orderBy("part")  # one row a partition
    totals = totals.select(
        "part", (F.sum("bytes").over(every) - F.col("bytes")).alias("offset"),
        F.sum("bytes").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "n_bytes").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n_bytes").over(inside)).join(F.broadcast(totals), "part")
    start = F.col("offset") + F.col("upto") - F.col("n_bytes")
    n = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(shard_bytes))).cast("decimal(18,0)")
    wide = start.cast("decimal(20,0)") * n  # past 64 bits on large corpora
    shard = F.when(F.col("total") > 0, F.least(F.floor(wide / F.col("total").cast("decimal(18,0)")).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.lit(0))
    return placed.select("doc_id", "n_bytes", start.alias("start_byte"), shard.cast("bigint").alias("shard"))


SQL = f"""
WITH r AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents),
s AS (
  SELECT doc_id, n_bytes, sum(n_bytes) OVER () AS total,
    sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_bytes AS start_byte
  FROM r
), n AS (SELECT *, greatest(1, (total + {SHARD_BYTES} - 1) // {SHARD_BYTES}) AS n FROM s)
SELECT doc_id, n_bytes, CAST(start_byte AS BIGINT) AS start_byte,
  CAST(CASE WHEN total > 0 THEN least(CAST(start_byte AS HUGEINT) * n // total, n - 1) ELSE 0 END AS BIGINT) AS shard
FROM n
"""
