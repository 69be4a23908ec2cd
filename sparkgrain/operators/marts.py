"""Wide marts at their base entity's grain, and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrain.operators import rules as R
from sparkgrain.plans.spec import MartSpec, Project

BUCKETS = ("day", "week", "month", "quarter", "year")


def bucket(column, unit: str):
    """The first day of the period; weeks start on Monday."""
    return F.date_trunc(unit, column).cast("date") if unit != "day" else column.cast("date")


def joins_for(project: Project, mart: MartSpec, need: set[str] | None) -> list[dict]:
    """The `via` steps that give one of the needed columns, or that such a step goes on from. A join to a whole key
    neither drops nor repeats rows, so the others can be left out."""
    first: dict[str, int] = {}
    vias = [s for s in mart.flatten if "via" in s]
    for i, s in enumerate(vias):
        first.setdefault(project.relationships[s["via"]].dst, i)
    keep: set[int] = set()
    for i in reversed(range(len(vias))):
        rel = project.relationships[vias[i]["via"]]
        own = {vias[i]["prefix"] + f for f in project.entities[rel.dst].fields}
        if need is None or i in keep or own & need:
            keep.add(i)
            if rel.src != mart.base:
                keep.add(first[rel.src])
    return [s for i, s in enumerate(vias) if i in keep]


def flatten(project: Project, mart: MartSpec, silver: dict[str, DataFrame], need: set[str] | None = None) -> DataFrame:
    """The base joined once for each `via` step (left, many to one, so no row multiplies), each joined column under its
    prefix; each date role as day, week, month, quarter and year. need: columns that are read, if not all."""
    base = project.entities[mart.base]
    rows = silver[mart.base]
    known = {mart.base: {f: f for f in base.fields}}
    out = {f: F.col(f) for f in sorted(base.fields)}
    for step in joins_for(project, mart, need):
        rel = project.relationships[step["via"]]
        dim = silver[rel.dst].select(*[F.col(f).alias(step["prefix"] + f) for f in sorted(project.entities[rel.dst].fields)])
        here = known[rel.src]
        rows = rows.join(dim, [F.col(here[a]) == F.col(step["prefix"] + b) for a, b in rel.via.items()], "left")
        known.setdefault(rel.dst, {f: step["prefix"] + f for f in project.entities[rel.dst].fields})
        out |= {step["prefix"] + f: F.col(step["prefix"] + f) for f in sorted(project.entities[rel.dst].fields)}
    for step in mart.flatten:
        if "date" in step:
            out |= {f"{step['role']}_{b}": bucket(F.col(step["date"]), b) for b in BUCKETS}
    if R.rules_of(project, base) and "_quality_ok" in rows.columns:
        out["has_quality_flags"] = ~F.col("_quality_ok")
    return rows.select(*[c.alias(n) for n, c in out.items()])


def calendar(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    """One row a day of the years, with the starts of its week, month, quarter and year."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(f"{start_year:04d}-01-01").cast("date"), F.lit(f"{end_year:04d}-12-31").cast("date"))).alias("day"))
    return days.select("day", *[bucket(F.col("day"), b).alias(b) for b in BUCKETS[1:]])
