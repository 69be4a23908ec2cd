"""The data-quality mart: counts by entity, by rule and by reconcile check."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrain.operators.silver import Silver

MEASURES = ("rows_evaluated", "rows_failed", "rows_quarantined", "rows_deduped")


@dataclass
class Counted:
    """An entity in the quality mart: its pipeline and relation, the rows that landed in this run, and what is stored.

    table: the entity's rows; rejects: its reject table, if it has one. Without either, this run's rows stand for them.
    """

    silver: Silver
    relation: str
    landed: DataFrame
    table: DataFrame | None = None
    rejects: DataFrame | None = None

    @property
    def whole(self) -> bool:
        """Whether the evaluated rows are the population."""
        return self.table is None and self.rejects is None and self.silver.diverted is not None

    @property
    def population(self) -> DataFrame:
        """Flags and side of every row that the rules were judged on: the entity and its unresolved rejects.

        A replayed row is in the entity and its reject is resolved, so it counts once; rows of earlier runs count too.
        """
        if self.whole:  # either side at once, so that the rows are evaluated once
            fired = F.when(F.col("_diverted"), F.col("_failed")).otherwise(F.col("_quality_flags"))
            return self.silver.evaluated.select(fired.alias("fired"), F.col("_diverted").alias("aside"))
        kept = (self.silver.kept if self.table is None else self.table).select(F.col("_quality_flags").alias("fired"), F.lit(False).alias("aside"))
        if self.rejects is None and self.silver.diverted is None:
            return kept
        aside = self.silver.diverted.select(F.col("_failed").alias("fired")) if self.rejects is None else self.rejects.where("resolved_at is null").select(F.col("failed_rules").alias("fired"))
        return kept.unionAll(aside.select("fired", F.lit(True)))


def quality_mart(runs: list[Counted], reconciles: list[tuple[dict, DataFrame, str, str]], run_id: str, run_date: date) -> DataFrame:
    """Rows entity, mapping, rule, disposition, run_id, run_date and the four counts.

    One accounting row an entity holds the population counts, so that they sum; a rule's row holds only how many rows
    it failed. All of an entity's counts come out of one aggregate over its population; deduped rows are this run's
    landed ones less those that survived, and 0 where history is kept. A reconcile check counts the keys that disagree,
    under the entity and mapping of its left side.
    """
    out, zero = None, F.lit(0).cast("bigint")
    row = lambda rule, how, *m: F.struct(F.lit(rule).alias("rule"), F.lit(how).alias("disposition"), *[x.cast("bigint").alias(k) for k, x in zip(MEASURES, m)])
    for run in runs:
        s = run.silver
        fired = [F.count_if(F.array_contains("fired", r.name)).alias(f"r{i}") for i, r in enumerate(s.rules)]
        one = run.population.agg(F.count("*").alias("n"), F.count_if("aside").alias("diverted"), *fired)
        if s.entity.dedupe and s.entity.scd != "type2":
            one = one.crossJoin(run.landed.agg(F.count("*").alias("landed")))
            one = one.withColumn("survived", F.col("n")) if run.whole else one.crossJoin(s.evaluated.agg(F.count("*").alias("survived")))
            one = one.withColumn("deduped", F.col("landed") - F.col("survived"))
        else:
            one = one.withColumn("deduped", zero)
        rows = [row("(entity)", "(none)", F.col("n"), zero, F.col("diverted"), F.col("deduped"))]
        rows += [row(r.name, r.on_fail, zero, F.col(f"r{i}"), zero, zero) for i, r in enumerate(s.rules)]
        part = one.select(F.explode(F.array(*rows)).alias("x")).select(F.lit(s.entity.name).alias("entity"), F.lit(f"{run.relation}->{s.entity.name}").alias("mapping"), "x.*")
        out = part if out is None else out.unionByName(part)
    for spec, rows, left, relation in reconciles:
        part = rows.agg(F.count_if(~F.col("agrees")).alias("bad")).select(row(spec["name"], spec["on_fail"], zero, F.col("bad"), zero, zero).alias("x"))
        part = part.select(F.lit(left).alias("entity"), F.lit(f"{relation}->{left}").alias("mapping"), "x.*")
        out = part if out is None else out.unionByName(part)
    return out.select("entity", "mapping", "rule", "disposition", F.lit(run_id).alias("run_id"), F.lit(run_date).alias("run_date"), *MEASURES)


def quarantine_rate(mart: DataFrame) -> DataFrame:
    """The ratio of the sums, by entity."""
    return mart.groupBy("entity").agg((F.sum("rows_quarantined") / F.nullif(F.sum("rows_evaluated"), F.lit(0))).cast("decimal(38,9)").alias("quality_quarantine_rate"))
