"""What a new version of a project changes: classes of change, and what to compute again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from sparkgrain.errors import ContractViolation, RenameTargetMissing
from sparkgrain.functions.types import assignable
from sparkgrain.operators import rules as R
from sparkgrain.plans.guard import columns_of
from sparkgrain.plans.request import merged
from sparkgrain.plans.spec import EntitySpec, Project

CLASSES = ("additive", "widening", "rename", "restating", "breaking")


@dataclass(frozen=True, order=True)
class Change:
    entity: str
    subject: str
    kind: str
    detail: str


@dataclass(frozen=True)
class Plan:
    changes: tuple[Change, ...]
    backfill: tuple[str, ...]
    replay: tuple[str, ...]
    metrics: tuple[str, ...]

    @property
    def breaking(self) -> tuple[Change, ...]:
        return tuple(c for c in self.changes if c.kind == "breaking")


def _lowering(p: Project, e: EntitySpec, field: str) -> list:
    out = []
    for m in p.mappings_of(e.name):
        f = m.all.get(field)
        if f is None:
            continue
        recipe = None
        if f.kind == "recipe":
            c = p.catalog.canonical.get(e.fields[field].canonical or field, {})
            recipe = next((r for r in c.get("recipes") or () if r["id"] == f.recipe), None)
        out.append((f.kind, f.source, f.chain, f.recipe, str(recipe), tuple(sorted(f.inputs.items())), f.direct, f.macro, tuple(sorted(f.parameters.items()))))
    return out


def _meaning(p: Project, e: EntitySpec, field: str) -> tuple:
    c = p.catalog.canonical.get(e.fields[field].canonical or field, {})
    return (c.get("unit"), c.get("tax_basis"), c.get("currency"))


def _fields(old: Project, new: Project, a: EntitySpec, b: EntitySpec) -> Iterator[Change]:
    renamed = {f.renamed_from: n for n, f in b.fields.items() if f.renamed_from and not (n in a.fields and a.fields[n].renamed_from == f.renamed_from)}
    for was, n in renamed.items():
        if was not in a.fields:
            raise RenameTargetMissing(f"{n!r} was renamed from {was!r}, which there was not", f"entities.{b.name}.fields.{n}")
        yield Change(b.name, n, "rename", f"from {was}")
    for n, f in b.fields.items():
        was = f.renamed_from if f.renamed_from in renamed and renamed[f.renamed_from] == n else n
        if was not in a.fields:
            yield Change(b.name, n, "breaking" if f.required else "additive", "required field added" if f.required else "field added")
            continue
        o = a.fields[was]
        if o.type != f.type:
            yield Change(b.name, n, "widening" if assignable(o.type, f.type) else "breaking", f"type {o.type} to {f.type}")
        if o.required != f.required:
            yield Change(b.name, n, "breaking" if f.required else "widening", "now required" if f.required else "now optional")
        if o.type == f.type and len(old.mappings_of(a.name)) == len(new.mappings_of(b.name)):
            if _lowering(old, a, was) != _lowering(new, b, n):
                yield Change(b.name, n, "restating", "derivation")
            elif _meaning(old, a, was) != _meaning(new, b, n):
                yield Change(b.name, n, "restating", "unit, tax basis or currency")
        if o.asserts != f.asserts:
            yield Change(b.name, n, "additive", "asserts")
    for n in a.fields:
        if n not in b.fields and n not in renamed:
            yield Change(b.name, n, "breaking", "field removed")


def _looser(a: R.Rule, b: R.Rule) -> bool:
    """Whether rows that broke a may hold under b; yes where it can't be told."""
    if a.params == b.params:
        return False
    if a.kind in ("range", "length"):
        try:
            lo = [Decimal(str(x)) if x is not None else None for x in (a.params.get("min"), b.params.get("min"))]
            hi = [Decimal(str(x)) if x is not None else None for x in (a.params.get("max"), b.params.get("max"))]
        except InvalidOperation:
            lo, hi = ([x.params.get(k) for x in (a, b)] for k in ("min", "max"))
            lo, hi = ([str(v) if v is not None else None for v in x] for x in (lo, hi))
        return (lo[0] is not None and (lo[1] is None or lo[1] < lo[0])) or (hi[0] is not None and (hi[1] is None or hi[1] > hi[0]))
    if a.kind in ("in_set", "in_enum"):
        return bool(set(b.params.get("values") or ()) - set(a.params.get("values") or ()))
    if a.kind == "charset":
        if (a.params.get("allow") is None) != (b.params.get("allow") is None):
            return True
        if a.params.get("allow") is not None:
            return bool(set(R.code_points(b.params["allow"])) - set(R.code_points(a.params["allow"])))
        return bool(set(R.code_points(a.params["forbid"])) - set(R.code_points(b.params["forbid"])))
    return True


def _quality(old: Project, new: Project, a: EntitySpec, b: EntitySpec, replay: set[str]) -> Iterator[Change]:
    was, now = {r.name: r for r in R.rules_of(old, a)}, {r.name: r for r in R.rules_of(new, b)}
    for n in sorted(was.keys() | now.keys()):
        if n not in was or n not in now:
            yield Change(b.name, n, "restating", "rule added" if n not in was else "rule removed")
            if n in was and was[n].on_fail == "quarantine":
                replay.add(b.name)
        elif was[n] != now[n]:
            yield Change(b.name, n, "restating", f"rule changed ({was[n].on_fail} to {now[n].on_fail})" if was[n].on_fail != now[n].on_fail else "rule changed")
            if was[n].on_fail == "quarantine" and (now[n].on_fail in ("flag", "unknown_member") or now[n].on_fail == "quarantine" and _looser(was[n], now[n])):
                replay.add(b.name)
    if a.dedupe != b.dedupe:
        yield Change(b.name, "dedupe", "restating", "deduplication changed")
    q, r = a.quarantine, b.quarantine
    if q and not r:
        yield Change(b.name, "quarantine", "breaking", "quarantine removed")
    elif r and not q:
        yield Change(b.name, "quarantine", "additive", "quarantine added")
    elif q and r:
        if q["retention"] != r["retention"]:
            yield Change(b.name, "quarantine", "additive", f"retention {q['retention']} to {r['retention']}")
        x, y = set(q.get("redact") or ()), set(r.get("redact") or ())
        if x != y:
            yield Change(b.name, "quarantine", "restating" if y - x else "additive", "redaction widened" if y - x else "redaction narrowed")


def _entities(old: Project, new: Project, replay: set[str]) -> Iterator[Change]:
    for n in sorted(old.entities.keys() | new.entities.keys()):
        if n not in old.entities:
            yield Change(n, n, "additive", "entity added")
            continue
        if n not in new.entities:
            yield Change(n, n, "breaking", "entity removed")
            continue
        a, b = old.entities[n], new.entities[n]
        for what in ("grain", "key", "scd", "materialization"):
            if getattr(a, what) != getattr(b, what):
                yield Change(n, n, "breaking", what)
        if a.partition_by != b.partition_by:
            yield Change(n, n, "additive", "partitioning")
        was, now = {m.source for m in old.mappings_of(n)}, {m.source for m in new.mappings_of(n)}
        if was != now:
            if len(was) == len(now) == 1:
                yield Change(n, n, "restating", f"source {min(was)} to {min(now)}")
            else:
                for s in sorted(now - was):
                    yield Change(n, s, "additive", "source added")
                for s in sorted(was - now):
                    yield Change(n, s, "restating", "source removed")
        yield from _fields(old, new, a, b)
        yield from _quality(old, new, a, b, replay)


def _rest(old: Project, new: Project) -> Iterator[Change]:
    for n in sorted(old.metrics.keys() | new.metrics.keys()):
        if n not in old.metrics or n not in new.metrics:
            yield Change("", n, "additive" if n not in old.metrics else "breaking", "metric added" if n not in old.metrics else "metric removed")
        elif (a := merged(old, n)).grain != (b := merged(new, n)).grain:
            yield Change("", n, "breaking", "metric grain")
        elif a != b:
            yield Change("", n, "restating", "metric definition")
    for n in sorted(old.marts.keys() | new.marts.keys()):
        if n not in old.marts or n not in new.marts:
            yield Change("", n, "additive" if n not in old.marts else "breaking", "mart added" if n not in old.marts else "mart removed")
            continue
        a, b = old.marts[n], new.marts[n]
        for what in ("grain", "base", "materialization"):
            if getattr(a, what) != getattr(b, what):
                yield Change("", n, "breaking", what)
        for s in a.flatten:
            if s not in b.flatten:
                yield Change("", n, "breaking", f"flatten step removed: {s.get('via') or s.get('role')}")
        for s in b.flatten:
            if s not in a.flatten:
                yield Change("", n, "additive", f"flatten step added: {s.get('via') or s.get('role')}")
        for x in sorted(set(a.measures) - set(b.measures)):
            yield Change("", n, "breaking", f"measure removed: {x}")
        for x in sorted(set(b.measures) - set(a.measures)):
            yield Change("", n, "additive", f"measure added: {x}")
        if (a.partition_by, a.cost_hint, a.asserts) != (b.partition_by, b.cost_hint, b.asserts):
            yield Change("", n, "additive", "layout, cost or asserts")
    for kind in ("reconcile", "coverage"):
        was, now = ({s["name"]: s for s in getattr(p, kind)} for p in (old, new))
        for n in sorted(was.keys() | now.keys()):
            if was.get(n) != now.get(n):
                yield Change("", n, "additive" if n not in was else "restating", kind)
    was, now = ({s["use"].split("@")[0]: s for s in p.steps} for p in (old, new))
    for n in sorted(was.keys() | now.keys()):
        if was.get(n) != now.get(n):
            yield Change("", n, "additive" if n not in was else "breaking" if n not in now else "restating", "step")


def metric_fields(p: Project, name: str) -> set[tuple[str, str]]:
    """(entity, field) pairs that a metric reads, through the metrics that it is made of."""
    m = merged(p, name)
    out: set[tuple[str, str]] = set()
    if m.expr and m.grain in p.entities:
        out |= {(m.grain, c) for c in columns_of(m.expr, name) if c in p.entities[m.grain].fields}
    for c in m.requires:
        home = p.catalog.canonical.get(c, {}).get("entity")
        if home in p.entities:
            out |= {(home, f) for f, s in p.entities[home].fields.items() if (s.canonical or f) == c}
    for x in {*m.requires_metrics, *((m.ratio or {}).values())} - {name}:
        if x in p.metrics:
            out |= metric_fields(p, x)
    return out


def diff(old: Project | None, new: Project) -> Plan:
    """Changes from old to new (all additive without an old one), entities to compute again or replay, and metrics
    whose numbers change. Refuses to drop or narrow a field that a metric still reads, and to take a measure that a
    metric still needs out of its last mart."""
    old = old or Project(new.catalog, {}, {}, (), {}, {})
    replay: set[str] = set()
    changes = sorted({*_entities(old, new, replay), *_rest(old, new)})
    touched = {(c.entity, c.subject) for c in changes if c.entity and c.kind in ("breaking", "restating")}
    for c in changes:
        if c.entity in old.entities and c.entity in new.entities and c.kind == "breaking" and (c.detail == "field removed" or c.detail.startswith("type ")):
            users = sorted(m for m in new.metrics if m in old.metrics and (c.entity, c.subject) in metric_fields(old, m))
            if users:
                raise ContractViolation(f"{c.entity}.{c.subject}: {c.detail}, and {', '.join(users)} still read it", f"entities.{c.entity}")
    had = {x for m in old.marts.values() for x in m.measures}
    have = {x for m in new.marts.values() for x in m.measures}
    if gone := sorted((had - have) & new.metrics.keys()):
        raise ContractViolation(f"no mart holds {', '.join(gone)} any more", "marts")
    backfill = sorted({c.entity for c in changes if c.entity in new.entities and c.entity in old.entities and c.kind in ("restating", "breaking") and not (c.subject == "quarantine")})
    whole = {c.entity for c in changes if c.entity and c.kind in ("restating", "breaking") and c.subject not in (new.entities[c.entity].fields if c.entity in new.entities else ())}
    hit = {m for m in new.metrics if any((e, f) in touched or e in whole for e, f in metric_fields(new, m))}
    hit |= {c.subject for c in changes if not c.entity and c.subject in new.metrics and c.kind in ("restating", "breaking")}
    grown = True
    while grown:
        more = {m for m in new.metrics if hit & ({*merged(new, m).requires_metrics} | {*((merged(new, m).ratio or {}).values())})} - hit
        hit |= more
        grown = bool(more)
    return Plan(tuple(changes), tuple(backfill), tuple(sorted(replay)), tuple(sorted(hit)))
