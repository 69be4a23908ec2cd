"""The silver pipeline: extract, transform, deduplicate, judge, route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrain.functions.transforms import apply_chain, cast, enum_targets
from sparkgrain.functions.types import STRING, Logical
from sparkgrain.operators import rules as R
from sparkgrain.operators.steps import Registry, spliced
from sparkgrain.plans.spec import METADATA, EntitySpec, FieldMapping, MappingSpec, Project


@dataclass
class Silver:
    """An entity's evaluated rows (read once) and what follows from them.

    evaluated has the entity's columns, flags, _diverted, and for rejects _failed, _raw and the ingestion columns.
    """

    entity: EntitySpec
    rules: list[R.Rule]
    types: dict[str, Logical]
    evaluated: DataFrame
    kept: DataFrame
    diverted: DataFrame | None
    surviving: DataFrame


def extraction(bronze: DataFrame, path: str) -> Column:
    """A path's value as text: the first part is a column, the rest lies in its struct or JSON text."""
    first, *rest = path[2:].split(".")
    col = F.col(f"`{first}`")
    if not rest:
        return col
    kind = bronze.schema[first].dataType
    while rest and isinstance(kind, T.StructType):
        col, kind = col.getField(rest[0]), kind[rest[0]].dataType
        rest = rest[1:]
    return F.get_json_object(col.cast("string"), "$." + ".".join(rest)) if rest else col


def _lowered(project: Project, registry: Registry, bronze: DataFrame, f: FieldMapping, to: Logical, lenient: bool) -> Column:
    if f.kind == "path":
        raw = extraction(bronze, f.source)
        return apply_chain(raw.cast("string"), list(f.chain), to, lenient) if f.chain else cast(raw, to, lenient)
    if f.kind == "macro":
        body = spliced(registry, f.macro, {k: f"`_in_{f.name}_{k}`" for k in f.inputs}, f.parameters)
        return cast(F.expr(body), to, lenient)
    fields = project.catalog.canonical
    canonical = project.entities[_target(project, f)].fields[f.name].canonical or f.name
    recipe = next(r for r in fields[canonical]["recipes"] if r["id"] == f.recipe)
    expr = recipe.get("expr") or recipe["requires"][0]
    for alias in sorted(f.inputs, key=len, reverse=True):
        expr = _renamed(expr, alias, f"`_in_{f.name}_{alias}`")
    return cast(F.expr(expr), to, lenient)


def _renamed(expr: str, name: str, to: str) -> str:
    import re

    return re.sub(rf"(?<![\w`.]){re.escape(name)}(?![\w`(])", lambda _: to, expr)


def _target(project: Project, f: FieldMapping) -> str:
    return next(m.target for m in project.mappings if f is m.all.get(f.name))


def _inputs(project: Project, bronze: DataFrame, f: FieldMapping, lenient: bool) -> list[Column]:
    """A recipe's or macro's inputs as columns; numbers where the catalog says what they are, else as they land."""
    known = project.catalog.canonical
    out = []
    for alias, path in sorted(f.inputs.items()):
        raw, kind = extraction(bronze, path), bronze.schema[path[2:].split(".")[0]].dataType
        if alias in known:
            raw = cast(raw, known[alias]["type"], lenient)
        elif f.kind == "recipe" and (isinstance(kind, T.StringType) or "." in path[2:]):
            raw = raw.try_cast("decimal(38,12)") if lenient else raw.cast("decimal(38,12)")
        out.append(raw.alias(f"_in_{f.name}_{alias}"))
    return out


def branch(project: Project, registry: Registry, entity: EntitySpec, m: MappingSpec, bronze: DataFrame, lenient: bool, metadata: bool) -> DataFrame:
    """One source's rows in the entity's columns, ingestion columns and what the rules read of the source."""
    staged = bronze.select("*", *[c for f in m.all.values() if f.kind != "path" for c in _inputs(project, bronze, f, lenient)])
    cols = []
    for name, spec in sorted(entity.fields.items()):
        f = m.all.get(name)
        if f is None:
            cols.append(F.lit(None).cast(spec.type.spark).alias(name))
            continue
        value = _lowered(project, registry, bronze, f, spec.type, lenient)
        for q in f.quality:
            if q.get("on_fail") == "repair":
                body = spliced(registry, q["repair"]["via"], {"value": f"`_pre_{name}`"}, q["repair"].get("parameters", {}))
                staged = staged.withColumn(f"_pre_{name}", value)
                params = {**q, "values": q.get("values") or enum_targets(list(f.chain)) or []}
                broken = F.coalesce(R.verdict(R.Rule("", q["rule"], f"_pre_{name}", "flag", params), {f"_pre_{name}": spec.type}), F.lit(False))
                value = F.when(broken, cast(F.expr(body), spec.type, lenient)).otherwise(F.col(f"_pre_{name}"))
                cols.append(broken.alias(f"_repaired_{name}"))
        cols.append(value.alias(name))
        if f.direct:
            cols.append(cast(extraction(bronze, f.direct), spec.type, lenient).alias(f"{name}__direct"))
        if lenient:
            present = [extraction(bronze, p).isNotNull() for p in R.sources_of(m, name)]
            there = present[0]
            for x in present[1:]:
                there = there & x
            cols.append(there.alias(f"_src_{name}"))
    if metadata:
        cols += [F.col(x) for x in METADATA if x in bronze.columns]
        redacted = {p[2:].split(".")[0] for p in (entity.quarantine or {}).get("redact", ())}
        named = sorted({p[2:].split(".")[0] for f in m.all.values() for p in ([f.source] if f.kind == "path" else f.inputs.values())} | {p[2:].split(".")[0] for p in m.unmapped})
        raw = [F.col(f"`{x}`").cast("string").alias(x) for x in named if x not in redacted and x in bronze.columns]
        cols.append(F.to_json(F.struct(*raw), {"ignoreNullFields": "false"}).alias("_raw") if raw else F.lit("{}").alias("_raw"))
    return staged.select(*cols)


def dedupe_order(entity: EntitySpec) -> list[str]:
    """Columns of the total order that picks one row of a key, the strongest first."""
    d = entity.dedupe or {}
    return list(dict.fromkeys([*([d["field"], *d.get("tie_break", ())] if d else []), "_source_row_id"]))


def firsts(rows: DataFrame, key: tuple[str, ...] | list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in the order.

    Told by its having none before it, not by its number: Spark sorts rows for a number before they are shuffled, too,
    which hardly drops any where a key's rows are few or far apart.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_before", F.lag(F.lit(True)).over(w)).where(F.col("_before").isNull()).drop("_before")


def deduplicate(rows: DataFrame, entity: EntitySpec) -> DataFrame:
    """The row of each key that comes first in descending order, nulls last."""
    return firsts(rows, entity.key, [F.col(c).desc_nulls_last() for c in dedupe_order(entity)])


def evaluate(project: Project, registry: Registry, name: str, bronze: dict[str, DataFrame], parents: dict[str, DataFrame] | None = None) -> Silver:
    """Run an entity's pipeline over its landed tables. parents: silver tables that referential rules look into."""
    entity, mappings = project.entity(name), project.mappings_of(name)
    rules = R.rules_of(project, entity)
    quality = R.opted_in(entity, mappings)
    types = {f: s.type for f, s in entity.fields.items()}
    metadata = bool(entity.dedupe or entity.quarantine)
    rows = None
    for m in mappings:
        part = branch(project, registry, entity, m, bronze[m.source], quality, metadata)
        if len(mappings) > 1:
            part = part.withColumn("_source", F.lit(m.source))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if entity.dedupe:
        rows = deduplicate(rows, entity)
    surviving = rows
    rows = R.stage_references(R.stage_windows(rows, rules), rules, parents or {})
    rows = rows.withColumn("_failed", R.flags(rules, types)).withColumns({"_quality_flags": R.recorded(rules), "_diverted": R.routed(rules)})
    for r in rules:
        if r.kind == "referential" and r.on_fail == "unknown_member":
            fk = next(iter(r.params["relationship"].via))
            rows = rows.withColumn(fk, F.when(F.col(f"_verdict_{r.name}"), F.lit(R.UNKNOWN_MEMBER)).otherwise(F.col(fk)))
    repaired = [r for r in rules if "repair" in r.params]
    if repaired:
        rows = rows.withColumn("_quality_repairs", F.array_compact(F.array(*[F.when(F.col(f"_repaired_{r.column}"), F.lit(r.name)) for r in repaired])))
    rows = rows.withColumn("_quality_ok", F.size("_quality_flags") == 0)
    carried = [x for x in METADATA if metadata and x in rows.columns]
    shadow = [c for c in rows.columns if c.endswith("__direct")]
    keep = [*sorted(entity.fields), *shadow, "_quality_flags", "_quality_ok", *(["_quality_repairs"] if repaired else []), *(["_source"] if len(mappings) > 1 else []), *carried]
    kept = rows.where(~F.col("_diverted")).select(*keep)
    diverted = rows.where("_diverted") if any(r.on_fail == "quarantine" for r in rules) and metadata else None
    return Silver(entity, rules, types, rows, kept, diverted, surviving)


__all__ = ["Silver", "branch", "deduplicate", "dedupe_order", "evaluate", "extraction", "firsts", "STRING"]
