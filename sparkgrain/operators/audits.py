"""Audits: queries that must return no row."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrain.errors import AuditFailed, GuardrailError
from sparkgrain.functions.types import Logical
from sparkgrain.operators import rules as R
from sparkgrain.operators.silver import Silver
from sparkgrain.plans.spec import MartSpec, Project

_SIDE = re.compile(r"(?:(avg|count|max|min|sum)\(\s*)?([a-z_][a-z0-9_]*)\.([a-z_][a-z0-9_]*)\s*\)?(?:\s+by\s+([a-z0-9_,\s]+))?")


@dataclass
class Audit:
    name: str
    violations: DataFrame
    blocking: bool = True

    def failed(self) -> bool:
        return bool(self.violations.limit(1).count())


def enforce(audits: list[Audit]) -> list[str]:
    """Names of the audits that found something; raises if one of them blocks."""
    bad = [a for a in audits if a.failed()]
    if any(a.blocking for a in bad):
        raise AuditFailed("audits found violations: " + ", ".join(a.name for a in bad if a.blocking))
    return [a.name for a in bad]


def ingestion(bronze: DataFrame) -> DataFrame:
    """Rows without all three ingestion columns, with an arrival time that is none, or with a repeated row id."""
    odd = F.col("_load_id").isNull() | F.col("_ingested_at").isNull() | F.col("_source_row_id").isNull() | F.col("_ingested_at").cast("string").try_cast("timestamp_ltz").isNull()
    again = bronze.groupBy("_source_row_id").count().where("count > 1").select(F.col("_source_row_id").alias("_twice"))
    return bronze.join(again, F.col("_source_row_id") == F.col("_twice"), "left").where(odd | F.col("_twice").isNotNull()).drop("_twice")


def conservation(s: Silver) -> DataFrame:
    """One row if kept and diverted rows don't add up to those that survived deduplication."""
    one = s.evaluated.agg(F.count("*").alias("surviving"), F.count_if(~F.col("_diverted")).alias("kept"), F.count_if("_diverted").alias("diverted"))
    return one.where("surviving <> kept + diverted")


def collisions(entity_rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that more than one source delivers."""
    return entity_rows.groupBy(*key).agg(F.count_distinct("_source").alias("n_sources")).where("n_sources > 1")


def fail_rules(s: Silver, stored: DataFrame | None = None) -> list[Audit]:
    """One blocking audit for each rule whose failure stops the run, whether or not the row was diverted.

    Its violations are keys, each once: of this run's rows, and of stored ones whose recorded flags name the rule.
    """
    out, key = [], s.entity.key
    for r in s.rules:
        if r.on_fail == "fail":
            bad = s.evaluated.where(F.array_contains("_failed", r.name)).select(*key)
            if stored is not None:
                bad = bad.unionByName(stored.where(F.array_contains("_quality_flags", r.name)).select(*key))
            out.append(Audit(f"{s.entity.name}_{r.name}", bad.distinct()))
    return out


def assertion(column: str, clause: str, value: object, t: Logical) -> Column:
    """A declared assert as its violation: min, max, regex, not_null, enum."""
    c = F.col(column)
    if clause == "not_null":
        return c.isNull() if value else F.lit(False)
    if clause == "enum":
        return ~c.isin(*value)
    if clause == "regex":
        return ~c.rlike(R.portable_pattern(value))
    if clause == "min":
        return c < R.bound(value, t)
    if clause == "max":
        return c > R.bound(value, t)
    raise GuardrailError(f"no assert {clause!r}", column)


def asserts(s: Silver) -> list[Audit]:
    out = []
    for f in s.entity.fields.values():
        for clause, value in sorted(f.asserts.items()):
            out.append(Audit(f"{s.entity.name}_{f.name}_{clause}", s.kept.where(assertion(f.name, clause, value, f.type))))
        if f"{f.name}__direct" in s.kept.columns:
            out.append(Audit(f"{s.entity.name}_{f.name}_reconcile", s.kept.where(~F.col(f.name).eqNullSafe(F.col(f"{f.name}__direct")))))
    return out


def _side(text: str, project: Project) -> tuple[str | None, str, str, tuple[str, ...]]:
    m = _SIDE.fullmatch(text.strip())
    if not m or m[2] not in project.entities or bool(m[1]) != bool(m[4]):
        raise GuardrailError(f"{text!r} is neither entity.column nor agg(entity.column) by keys")
    e = project.entities[m[2]]
    by = tuple(x.strip() for x in m[4].split(",")) if m[4] else e.key
    for col in (m[3], *by):
        if col not in e.fields:
            raise GuardrailError(f"{text!r}: {m[2]} has no column {col!r}")
    if len(set(by)) != len(by):
        raise GuardrailError(f"{text!r}: a key is named twice")
    return m[1], m[2], m[3], by


def reconciled(project: Project, spec: dict) -> tuple[str, str]:
    """The entities of a check's left and right side."""
    return _side(spec["left"], project)[1], _side(spec["right"], project)[1]


def reconcile(project: Project, spec: dict, silver: dict[str, DataFrame]) -> DataFrame:
    """Both sides by key, every key of either, with their difference and whether they agree within the tolerance.

    Two aggregates come out of one aggregate over both sides' rows, other sides meet in a null-safe full join: null
    keys meet once. A side that is missing disagrees unless both are null.
    """
    sides, sums = [], []
    for name in ("left", "right"):
        agg, entity, col, by = _side(spec[name], project)
        rows = silver[entity]
        f = {"avg": F.avg, "count": F.count, "max": F.max, "min": F.min, "sum": F.sum}[agg] if agg else None
        sums.append((rows, f, col))
        rows = rows.groupBy(*by).agg(f(col).alias(f"{name}_value")) if agg else rows.select(*by, F.col(col).alias(f"{name}_value"))
        sides.append((rows.withColumnsRenamed({k: f"_{name}_{k}" for k in by}), by))
    (a, keys), (b, other) = sides
    if sorted(keys) != sorted(other):
        raise GuardrailError(f"{spec['name']}: keys {keys} and {other} differ")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    agree = F.when(F.col("left_value").isNull() & F.col("right_value").isNull(), F.lit(True)).otherwise(F.coalesce(gap <= F.expr(f"{Decimal(str(spec.get('tolerance', '0'))):f}BD"), F.lit(False)))
    (left, f, x), (right, g, y) = sums
    if f and g and all(left.schema[k].dataType == right.schema[k].dataType for k in keys):
        none = lambda rows, col: F.lit(None).cast(rows.schema[col].dataType)
        rows = left.select(*keys, F.col(x).alias("_x"), none(right, y).alias("_y"), F.lit(True).alias("_l"), F.lit(False).alias("_r"))
        rows = rows.unionAll(right.select(*keys, none(left, x), F.col(y), F.lit(False), F.lit(True)))
        both = rows.groupBy(*keys).agg(f("_x").alias("_x"), g("_y").alias("_y"), F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        both = both.select(*keys, F.when(F.col("_l"), F.col("_x")).alias("left_value"), F.when(F.col("_r"), F.col("_y")).alias("right_value"))
        return both.withColumn("agrees", agree)
    on = None
    for k in keys:
        c = F.col(f"_left_{k}").eqNullSafe(F.col(f"_right_{k}"))
        on = c if on is None else on & c
    a, b = a.withColumn("_l", F.lit(True)), b.withColumn("_r", F.lit(True))
    both = a.join(b, on, "full")
    return both.select(*[F.when(F.col("_l"), F.col(f"_left_{k}")).otherwise(F.col(f"_right_{k}")).alias(k) for k in keys], "left_value", "right_value", agree.alias("agrees"))


def coverage(project: Project, spec: dict, silver: dict[str, DataFrame]) -> DataFrame:
    """Referenced rows with fewer dependents than asked for."""
    rel = project.relationships[spec["relationship"]]
    dep = silver[rel.src].groupBy(*[F.col(a).alias(f"_d_{a}") for a in rel.via]).agg(F.count("*").alias("n_dependents"))
    on = [F.col(b) == F.col(f"_d_{a}") for a, b in rel.via.items()]
    keys = project.entities[rel.dst].key
    both = silver[rel.dst].select(*dict.fromkeys([*keys, *rel.via.values()])).join(dep, on, "left")
    return both.select(*keys, F.coalesce("n_dependents", F.lit(0)).alias("n_dependents")).where(F.col("n_dependents") < spec["min"])


def mart_assertion(mart: MartSpec, spec: dict, rows: DataFrame) -> DataFrame:
    """Groups of a mart whose aggregate is out of bounds; without `by` the whole mart is one group."""
    f = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[spec["agg"]]
    got = rows.groupBy(*spec.get("by", ())).agg(f(spec["measure"]).alias("value"))
    bad = F.lit(False)
    for key, out in (("min", lambda b: F.col("value") < b), ("max", lambda b: F.col("value") > b)):
        if spec.get(key) is not None:
            bad = bad | out(F.expr(f"{Decimal(str(spec[key])):f}BD"))
    return got.where(bad)
