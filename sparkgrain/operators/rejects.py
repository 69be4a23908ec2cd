"""Reject rows, their upsert, and replay after a spec is relaxed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrain.operators.silver import Silver, dedupe_order, deduplicate, firsts

COLUMNS = ("reject_id", "source_relation", "mapping", "mapping_version", "failed_rules", "key_values", "raw", "_load_id", "_ingested_at", "_source_row_id", "first_seen", "last_seen", "resolved_at", "last_evaluated_at")
#: Says of a row that breaks no rule any more that another row holds its key.
SUPERSEDED = "(superseded)"


def _sized(col: Column) -> Column:
    """A text with its length before it, so that parts can't be read across their border."""
    return F.concat(F.lit("S"), F.length(col).cast("string"), F.lit(":"), col)


def reject_id(relation: str, row_id: Column) -> Column:
    """SHA-256 of relation and source row: a row delivered again keeps its id, whatever load it comes with."""
    return F.sha2(F.concat(_sized(F.lit(relation)), _sized(row_id.cast("string"))), 256)


def reject_rows(s: Silver, relation: str) -> DataFrame:
    """The diverted rows in the reject table's columns; failed_rules names all that fired, not only what diverted."""
    rows = s.diverted if s.diverted is not None else s.evaluated.where(F.lit(False))
    keys = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in sorted(s.entity.key)]), {"ignoreNullFields": "false"})
    seen = F.col("_ingested_at")
    none = F.lit(None).cast("timestamp_ntz")
    return rows.select(
        reject_id(relation, F.col("_source_row_id")).alias("reject_id"), F.lit(relation).alias("source_relation"), F.lit(f"{relation}->{s.entity.name}").alias("mapping"),
        F.lit(1).alias("mapping_version"), F.col("_failed").alias("failed_rules"), keys.alias("key_values"), F.col("_raw").alias("raw"),
        "_load_id", "_ingested_at", "_source_row_id", seen.alias("first_seen"), seen.alias("last_seen"), none.alias("resolved_at"), none.alias("last_evaluated_at"),
    )


def upsert(target: DataFrame, arriving: DataFrame, key: tuple[str, ...] | list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Rows of target with those of arriving in place of their equals by key; keep_first columns stay as they were
    where they were set. One null-safe outer join, so one shuffle of either side."""
    t, a = target.alias("t"), arriving.alias("a")
    on = None
    for k in key:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"a.{k}"))
        on = c if on is None else on & c
    t, a = target.withColumn("_there", F.lit(True)).alias("t"), arriving.withColumn("_here", F.lit(True)).alias("a")
    out = []
    for c in target.columns:
        new, old = F.col(f"a.{c}"), F.col(f"t.{c}")
        out.append(F.when(F.col("a._here"), F.coalesce(old, new) if c in keep_first else new).otherwise(old).alias(c))
    return t.join(a, on, "full").select(*out)


def upsert_rejects(target: DataFrame, arriving: DataFrame) -> DataFrame:
    """The reject table after a run: first_seen and last_evaluated_at stay, all else is the arriving row's."""
    return upsert(target, arriving, ("reject_id",), ("first_seen", "last_evaluated_at"))


def _rank(entity) -> Column:
    """Sorts as the dedupe order does when compared upwards: null parts lose, greater ones win."""
    return F.struct(*[x for c in dedupe_order(entity) for x in (F.col(c).isNotNull(), F.col(c))])


def replay(s: Silver, target: DataFrame, rejects: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """The entity and the reject table after unresolved rejects were judged again.

    s is the pipeline run over the rejects' payloads (payload_rows()). Rows that pass routing compete for their key
    by the dedupe order; the winner replaces an incumbent only if it ranks higher. Rows of other keys pass by unsorted,
    and only open rejects' rows are looked for among the results. Rejects whose row is now in the
    entity are resolved; the rest have their failures restated, with SUPERSEDED where none diverts them any more.
    """
    e = s.entity
    winners = deduplicate(s.kept, e)
    keys = winners.select(*[F.col(k).alias(f"_k_{k}") for k in e.key])
    met = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in e.key]
    rivals = target.join(keys, met, "left_semi")
    both = winners.withColumn("_new", F.lit(True)).unionByName(rivals.withColumn("_new", F.lit(False)), allowMissingColumns=True).withColumn("_rank", _rank(e))
    placed = firsts(both, e.key, [F.col("_rank").desc(), F.col("_new")]).select(*target.columns)
    after = target.join(keys, met, "left_anti").unionByName(placed)
    asked = rejects.where("resolved_at is null").select(F.col("_source_row_id").alias("_in"))
    inside = after.join(asked, F.col("_source_row_id") == F.col("_in"), "left_semi").select(F.col("_source_row_id").alias("_in")).distinct()
    judged = s.evaluated.select(F.col("_source_row_id").alias("_row"), "_failed", "_diverted")
    now = F.lit(at).cast("timestamp_ntz")
    open_ = F.col("resolved_at").isNull()
    r = rejects.join(inside, F.col("_source_row_id") == F.col("_in"), "left").join(judged, F.col("_source_row_id") == F.col("_row"), "left")
    solved = open_ & F.col("_in").isNotNull()
    again = open_ & F.col("_in").isNull() & F.col("_row").isNotNull()
    failed = F.when(F.col("_diverted"), F.col("_failed")).otherwise(F.array_append(F.col("_failed"), F.lit(SUPERSEDED)))
    changed = {
        "failed_rules": F.when(again, failed).otherwise(F.col("failed_rules")),
        "resolved_at": F.when(solved, now).otherwise(F.col("resolved_at")),
        "last_evaluated_at": F.when(solved | again, now).otherwise(F.col("last_evaluated_at")),
    }
    return after, r.select(*[changed.get(c, F.col(c)).alias(c) for c in rejects.columns])


def payload_rows(rejects: DataFrame, columns: list[str]) -> DataFrame:
    """Unresolved rejects as landed rows: each column read back out of the raw payload."""
    return rejects.where("resolved_at is null").select(*[F.get_json_object("raw", f"$.{c}").alias(c) for c in columns if not c.startswith("_")], "_load_id", "_ingested_at", "_source_row_id")


def purge(rejects: DataFrame, retention: str, now: datetime) -> DataFrame:
    """The reject table without rows last seen before the retention (90d, 12h, 2w)."""
    unit = {"d": "DAY", "h": "HOUR", "w": "WEEK"}[retention[-1]]
    return rejects.where(F.col("last_seen").cast("timestamp_ntz") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(retention[:-1])} {unit}"))
