"""Everything that is refused before a job runs: references, types, arithmetic, grains, additivity, quality, marts."""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from sparkgrain import errors as E
from sparkgrain.errors import SpecError, nearest
from sparkgrain.functions.transforms import check_chain, enum_targets, nullifying
from sparkgrain.functions.types import Logical, assignable
from sparkgrain.operators import rules as R
from sparkgrain.operators.steps import Registry
from sparkgrain.plans.request import mart_dimensions, merged
from sparkgrain.plans.spec import METADATA, EntitySpec, MappingSpec, MartSpec, Project

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<text>'(?:[^']|'')*')|(?P<op><=|>=|<>|!=|\|\||[-+*/%()=<>,.]))")
_AGGREGATES = {"sum", "count", "avg", "min", "max", "median"}
_WORDS = {"and", "or", "not", "is", "null", "in", "like", "between", "case", "when", "then", "else", "end", "true", "false", "cast", "as", "distinct", "date", "timestamp", "interval"}
_BOOLEAN = re.compile(r"[<>=]|\b(?:and|or|not|is|in|like|between|true|false)\b", re.I)
_QMART = {"rows_evaluated", "rows_failed", "rows_quarantined", "rows_deduped", "quality_quarantine_rate"}
#: For a rule on a column: the types that it can judge.
_RULE_TYPES = {"range": ("int", "decimal", "date", "timestamp"), "length": ("string",), "pattern": ("string",), "charset": ("string",), "normalize": ("string",), "in_enum": ("string",), "in_set": ("string", "int")}


def lexed(expr: str, at: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(expr.rstrip()):
        m = _TOKEN.match(expr, i)
        if not m:
            raise E.ParseError(f"{expr!r} can't be read from {expr[i:i + 12]!r}", at)
        out.append((m.lastgroup, m[m.lastgroup]))
        i = m.end()
    return out


def columns_of(expr: str, at: str) -> list[str]:
    """Names that an expression reads, in order: what is neither a function nor a word of SQL."""
    t = lexed(expr, at)
    return list(dict.fromkeys(v for i, (k, v) in enumerate(t) if k == "name" and v.lower() not in _WORDS and t[i + 1 : i + 2] != [("op", "(")]))


def aggregated(expr: str, at: str) -> set[str]:
    """Names of which every occurrence lies within an aggregate."""
    inside, bare, stack, t = set(), set(), [], lexed(expr, at)
    for i, (k, v) in enumerate(t):
        if (k, v) == ("op", "("):
            stack.append(i > 0 and t[i - 1][0] == "name" and t[i - 1][1].lower() in _AGGREGATES)
        elif (k, v) == ("op", ")") and stack:
            stack.pop()
        elif k == "name":
            (inside if any(stack) else bare).add(v)
    return inside - bare


class _Arithmetic:
    """Walks + - * / over operands with units, bases and currencies; each kind of refusal once an expression."""

    def __init__(self, expr: str, canonical: dict[str, dict], at: str):
        self.t, self.i, self.canonical, self.at = lexed(expr, at), 0, canonical, at
        self.found: dict[type, SpecError] = {}
        self.expr = expr

    def walk(self) -> list[SpecError]:
        while self.i < len(self.t):
            self._sum()
            self.i += self.i < len(self.t)
        return list(self.found.values())

    def _peek(self) -> str:
        return self.t[self.i][1] if self.i < len(self.t) else ""

    def _sum(self) -> list[str]:
        left = self._product()
        while self._peek() in ("+", "-"):
            self.i += 1
            right = self._product()
            self._meet(left, right, True)
            left = left + right
        return left

    def _product(self) -> list[str]:
        left = self._atom()
        while self._peek() in ("*", "/", "%"):
            self.i += 1
            right = self._atom()
            self._meet(left, right, False)
            left = left + right
        return left

    def _atom(self) -> list[str]:
        if self.i >= len(self.t):
            return []
        kind, v = self.t[self.i]
        self.i += 1
        if v in ("-", "+"):
            return self._atom()
        if v == "(" or kind == "name" and self._peek() == "(":
            if kind == "name":
                self.i += 1
            out = []
            while self.i < len(self.t) and self._peek() != ")":
                before = self.i
                out += self._sum()
                self.i += self.i == before or self._peek() == ","
            self.i += 1
            return out
        return [v] if kind == "name" and v in self.canonical else []

    def _meet(self, left: list[str], right: list[str], additive: bool) -> None:
        get = lambda names, what: {self.canonical[n].get(what) for n in names} - {None}
        say = lambda kind, why: self.found.setdefault(kind, kind(f"{self.expr!r}: {why}", self.at))
        a, b = get(left, "currency"), get(right, "currency")
        if a and b and a != b:
            say(E.CurrencyMismatch, f"{sorted(a)} meets {sorted(b)}")
        if not additive or not left or not right:
            return
        a, b = get(left, "unit"), get(right, "unit")
        if a and b and a != b:
            say(E.UnitMismatch, f"{sorted(a)} meets {sorted(b)}")
        money = "currency" in a | b
        bases = {self.canonical[n].get("tax_basis") or "unknown" for n in left + right}
        if {"net", "gross"} <= bases or money and "unknown" in bases:
            say(E.TaxBasisMismatch, f"tax bases {sorted(bases)} meet")


def _references(p: Project) -> list[SpecError]:
    out: list[SpecError] = []
    for name, e in p.entities.items():
        for k in e.key:
            if k not in e.fields:
                out.append(E.MissingReference(f"key column {k!r} is no field", f"entities.{name}"))
        for _, col in e.partition_by:
            if col not in e.fields:
                out.append(E.MissingReference(f"partition column {col!r} is no field", f"entities.{name}"))
        for f in e.fields.values():
            if f.canonical and (f.canonical not in p.catalog.canonical or p.catalog.canonical[f.canonical]["entity"] != name):
                out.append(E.MissingReference(f"{f.canonical!r} is no canonical field of {name}{nearest(f.canonical, p.catalog.canonical)}", f"entities.{name}.fields.{f.name}"))
    for m in p.mappings:
        at = f"mapping[{m.source}->{m.target}]"
        e = p.entities.get(m.target)
        if e is None:
            out.append(E.MissingReference(f"no entity {m.target!r}{nearest(m.target, p.entities)}", at))
            continue
        for f in m.all:
            if f not in e.fields:
                out.append(E.MissingReference(f"{m.target} has no field {f!r}{nearest(f, e.fields)}", f"{at}.{f}"))
        out += [E.ResolutionError(f"{f!r} is mapped as key and as field", at) for f in sorted(set(m.key) & set(m.fields))]
        out += [E.ResolutionError(f"key column {k!r} is not mapped", at) for k in e.key if k not in m.key]
        for f in m.all.values():
            if f.kind == "recipe" and f.name in e.fields:
                c = p.catalog.canonical.get(e.fields[f.name].canonical or f.name)
                r = next((r for r in (c or {}).get("recipes") or () if r["id"] == f.recipe), None)
                if r is None:
                    out.append(E.MissingReference(f"no recipe {f.recipe!r}", f"{at}.{f.name}"))
                elif set(r["requires"]) != set(f.inputs):
                    out.append(E.ResolutionError(f"recipe {f.recipe!r} takes {sorted(r['requires'])}, not {sorted(f.inputs)}", f"{at}.{f.name}"))
                elif r.get("expr") and (odd := set(columns_of(r["expr"], at)) - set(r["requires"])):
                    out.append(E.ResolutionError(f"recipe {f.recipe!r} reads {sorted(odd)}", f"{at}.{f.name}"))
    for r in p.relationships.values():
        for side, cols in ((r.src, r.via), (r.dst, r.via.values())):
            if side not in p.entities:
                out.append(E.MissingReference(f"no entity {side!r}", f"relationships.{r.name}"))
            else:
                out += [E.MissingReference(f"{side} has no field {x!r}", f"relationships.{r.name}") for x in cols if x not in p.entities[side].fields]
    for m in p.metrics.values():
        if m.template and m.template not in p.catalog.templates:
            out.append(E.MissingReference(f"no template {m.template!r}{nearest(m.template, p.catalog.templates)}", f"metrics.{m.name}"))
            continue
        full = merged(p, m.name)
        out += [E.MissingReference(f"{x!r} is no canonical field", f"metrics.{m.name}") for x in full.requires if p.catalog.canonical and x not in p.catalog.canonical]
        out += [E.MissingReference(f"no metric {x!r}{nearest(x, p.metrics)}", f"metrics.{m.name}") for x in (*full.requires_metrics, *((full.ratio or {}).values())) if x not in p.metrics]
        if full.grain and full.grain not in p.entities:
            out.append(E.MissingReference(f"no entity {full.grain!r}", f"metrics.{m.name}"))
    for mart in p.marts.values():
        if mart.base not in p.entities:
            out.append(E.MissingReference(f"no entity {mart.base!r}", f"marts.{mart.name}"))
        out += [E.MissingReference(f"no metric {x!r}{nearest(x, p.metrics)}", f"marts.{mart.name}") for x in mart.measures if x not in p.metrics]
        out += [E.MissingReference(f"no relationship {s['via']!r}", f"marts.{mart.name}") for s in mart.flatten if "via" in s and s["via"] not in p.relationships]
    return out


def metric_cycles(p: Project) -> list[SpecError]:
    done: set[str] = set()

    def visit(name: str, path: tuple[str, ...]) -> str | None:
        if name in path:
            return " -> ".join((*path[path.index(name) :], name))
        if name in done or name not in p.metrics:
            return None
        m = merged(p, name)
        for x in dict.fromkeys((*m.requires_metrics, *((m.ratio or {}).values()))):
            if bad := visit(x, (*path, name)):
                return bad
        done.add(name)
        return None

    bad = next((b for n in sorted(p.metrics) if (b := visit(n, ()))), None)
    return [E.CircularDerivation(bad, "metrics")] if bad else []


def _chains(p: Project) -> list[SpecError]:
    out: list[SpecError] = []
    for m in p.mappings:
        e = p.entities[m.target]
        for f in m.all.values():
            if f.kind == "path" and f.chain:
                try:
                    check_chain(list(f.chain), e.fields[f.name].type, f"mapping[{m.source}->{m.target}].{f.name}")
                except SpecError as err:
                    out.append(err)
    return out


def _merges(p: Project) -> list[SpecError]:
    out: list[SpecError] = []
    for name, e in p.entities.items():
        ms = p.mappings_of(name)
        if len(ms) < 2:
            continue
        at = f"entities.{name}"
        if len({m.source for m in ms}) != len(ms):
            out.append(E.ResolutionError("a relation is merged with itself", at))
        for m in ms:
            out += [E.ResolutionError(f"source {m.source} doesn't give the required field {f.name!r}", at) for f in e.fields.values() if f.required and f.name not in m.all]
            out += [E.ResolutionError(f"source {m.source}: a merged entity records no direct field", at) for f in m.all.values() if f.direct]
            if any(f.quality for f in m.all.values()):
                out.append(E.ResolutionError(f"source {m.source}: rules of fields are for entities with one source", at))
        if e.dedupe or e.quarantine or e.quality:
            out.append(E.ResolutionError("an entity with several sources has no quality surface", at))
        if e.scd == "type2":
            out.append(E.ResolutionError("an entity with several sources keeps no history", at))
    return out


def _asserts(p: Project) -> list[SpecError]:
    out: list[SpecError] = []
    for name, e in p.entities.items():
        for f in e.fields.values():
            at = f"entities.{name}.fields.{f.name}.assert"
            for clause, v in f.asserts.items():
                if clause not in ("min", "max", "enum", "regex", "not_null"):
                    out.append(E.ParseError(f"no assert {clause!r}", at))
                elif clause in ("min", "max"):
                    bad = _bound(v, f.type)
                    out += [E.AssertTyping(f"{clause}: {bad}", at)] if bad else []
                elif clause == "enum":
                    kind = {"string": str, "int": int}.get(f.type.name)
                    if kind is None or not all(isinstance(x, kind) and not isinstance(x, bool) for x in v):
                        out.append(E.AssertTyping(f"enum {v!r} on a {f.type}", at))
                elif clause == "regex":
                    if f.type.name != "string":
                        out.append(E.AssertTyping(f"regex on a {f.type}", at))
                    else:
                        try:
                            R.portable_pattern(v, at)
                        except SpecError as err:
                            out.append(E.AssertTyping(str(err), at))
    return out


def _bound(v: object, t: Logical) -> str | None:
    """Why v is no bound of the type."""
    try:
        if t.name == "date":
            date.fromisoformat(str(v))
        elif t.name == "timestamp":
            datetime.fromisoformat(str(v).replace("Z", "+00:00"))
        elif t.numeric:
            if isinstance(v, bool) or not Decimal(str(v)).is_finite():
                return f"{v!r} is no number"
        else:
            return f"a {t} has no bounds"
    except (ValueError, InvalidOperation):
        return f"{v!r} is no {t}"
    return None


def _quality(p: Project) -> list[SpecError]:
    out: list[SpecError] = []
    for name, e in p.entities.items():
        ms = p.mappings_of(name)
        if not ms:
            continue
        at, m = f"entities.{name}", ms[0]
        rules = R.rules_of(p, e)
        order = (e.dedupe["field"], *e.dedupe.get("tie_break", ())) if e.dedupe else ()
        if e.dedupe and not e.dedupe.get("tie_break"):
            out.append(E.TieBreakMissing("a deduplication names what breaks ties", at))
        for c in order:
            if c not in e.fields and c not in METADATA:
                out.append(E.MissingReference(f"deduplication by {c!r}, which is no field{nearest(c, e.fields)}", at))
        for r in rules:
            if r.kind == "coercible" and r.column in order and r.on_fail != "fail":
                out.append(E.DispositionConflict(f"{r.column!r} sorts a deduplication, so values that can't be read must fail", at))
        if any(r.on_fail == "quarantine" for r in rules) and not e.quarantine:
            out.append(E.RetentionMissing("rules divert rows and no retention says for how long", at))
        if e.dedupe or e.quarantine:
            for mp in ms:
                said = {x[2:].split(".")[0] for x in mp.unmapped} | {x[2:].split(".")[0] for f in mp.all for x in R.sources_of(mp, f)}
                out += [E.IngestionMetadataMissing(f"source {mp.source} doesn't acknowledge {x}", at) for x in METADATA if x not in said]
        mapped = {x[2:].split(".")[0] for f in m.all for x in R.sources_of(m, f)}
        out += [E.RedactionConflict(f"{x} is redacted and mapped", at) for x in (e.quarantine or {}).get("redact", ()) if x[2:].split(".")[0] in mapped]
        written = [q["name"] for q in e.quality if q["rule"] == "expression"]
        made = {r.name for r in rules if r.kind != "expression"}
        out += [E.GuardrailError(f"rule name {x!r} is taken", at) for x in written if x in made or written.count(x) > 1]
        for f in m.all.values():
            for q in f.quality:
                out += _field_rule(e, f, q, order, f"{at}.{f.name}")
        vias: list[str] = []
        for q in e.quality:
            if q["rule"] == "expression":
                out += _expression(q["expr"], e, at)
            elif q["rule"] == "referential":
                vias.append(q["via"])
                rel = p.relationships.get(q["via"])
                if rel is None or rel.src != name:
                    out.append(E.MissingReference(f"{q['via']!r} is no relationship from {name}", at))
                elif rel.src == rel.dst:
                    out.append(E.GuardrailError(f"{q['via']!r} refers to its own entity", at))
                elif q["on_missing"] == "unknown_member" and (len(rel.via) > 1 or e.fields[next(iter(rel.via))].type.name != "string"):
                    out.append(E.GuardrailError(f"{q['via']!r}: an unknown member needs one key column of text", at))
        out += [E.GuardrailError(f"{v!r} is checked twice", at) for v in sorted({v for v in vias if vias.count(v) > 1})]
    for kind, specs in (("reconcile", p.reconcile), ("coverage", p.coverage)):
        names = [s["name"] for s in specs]
        out += [E.GuardrailError(f"{x!r} is there twice", kind) for x in sorted({x for x in names if names.count(x) > 1})]
    for s in p.coverage:
        rel = p.relationships.get(s["relationship"])
        if rel is None:
            out.append(E.MissingReference(f"no relationship {s['relationship']!r}", "coverage"))
        else:
            out += [E.GuardrailError(f"{x} is not built", "coverage") for x in (rel.src, rel.dst) if x in p.entities and not p.mappings_of(x)]
    from sparkgrain.operators.audits import _side

    for s in p.reconcile:
        try:
            sides = [_side(s[x], p) for x in ("left", "right")]
            if sorted(sides[0][3]) != sorted(sides[1][3]):
                out.append(E.GuardrailError(f"{s['name']}: the sides' keys differ", "reconcile"))
            for _, entity, _, _ in sides:
                if len(p.mappings_of(entity)) != 1:
                    out.append(E.GuardrailError(f"{s['name']}: {entity} is not built from one source", "reconcile"))
        except SpecError as err:
            out.append(err)
    out += [E.GuardrailError(f"metric {x!r} belongs to the quality mart", "metrics") for x in sorted(_QMART & set(p.metrics))]
    if "data_quality" in p.marts:
        out.append(E.GuardrailError("mart 'data_quality' is the quality mart", "marts"))
    return out


def _repairs(p: Project) -> list[SpecError]:
    return [E.GuardrailError("a repair names its macro, and what becomes of rows that it leaves broken", f"mapping[{m.source}->{m.target}].{f.name}") for m in p.mappings for f in m.all.values() for q in f.quality if q.get("on_fail") == "repair" and ("via" not in (q.get("repair") or {}) or q["repair"].get("fallback") not in ("flag", "quarantine", "fail"))]


def _field_rule(e: EntitySpec, f, q: dict, order: tuple, at: str) -> list[SpecError]:
    out: list[SpecError] = []
    t, kind = e.fields[f.name].type, q["rule"]
    if t.name not in _RULE_TYPES.get(kind, (t.name,)):
        return [E.GuardrailError(f"{kind} on a {t}", at)]
    if kind in ("range", "length"):
        if q.get("min") is None and q.get("max") is None:
            out.append(E.GuardrailError(f"{kind} without a bound", at))
        for b in ("min", "max"):
            if q.get(b) is not None and (bad := _bound(q[b], t if kind == "range" else Logical("int"))):
                out.append(E.GuardrailError(bad, at))
    try:
        if kind == "pattern":
            R.portable_pattern(q["regex"], at)
        if kind == "charset":
            if (q.get("allow") is None) == (q.get("forbid") is None):
                out.append(E.GuardrailError("charset takes allow or forbid", at))
            R.code_points(q.get("allow") or q.get("forbid") or [], at)
    except SpecError as err:
        out.append(err)
    if kind == "in_enum" and enum_targets(list(f.chain)) is None:
        out.append(E.GuardrailError("in_enum needs a chain that ends in enum_map", at))
    if kind == "in_set" and not all(isinstance(v, int if t.name == "int" else str) and not isinstance(v, bool) for v in q.get("values") or ()):
        out.append(E.GuardrailError(f"in_set {q.get('values')!r} on a {t}", at))
    if kind == "coercible" and nullifying(list(f.chain)) and f.name not in order:
        out.append(E.GuardrailError("coercible over a chain that gives nulls on purpose", at))
    if q.get("on_fail") == "repair":
        if kind in ("coercible", "unique") or f.kind != "path":
            out.append(E.GuardrailError(f"{kind} of a {f.kind} can't be repaired", at))
        if sum(x.get("on_fail") == "repair" for x in f.quality) > 1:
            out.append(E.GuardrailError("a field has one repair", at))
    return out


def _expression(expr: str, e: EntitySpec, at: str) -> list[SpecError]:
    try:
        t = lexed(expr, at)
    except SpecError as err:
        return [err]
    if any(k == "name" and v.lower() in ("select", "exists") for k, v in t):
        return [E.GuardrailError(f"{expr!r} holds a query", at)]
    if ("op", ".") in t:
        return [E.GuardrailError(f"{expr!r} names a table", at)]
    if not _BOOLEAN.search(expr):
        return [E.GuardrailError(f"{expr!r} is neither true nor false", at)]
    known = {x.lower() for x in (*e.fields, *METADATA)}
    return [E.MissingReference(f"{expr!r} reads {x!r}, which is no field{nearest(x, e.fields)}", at) for x in columns_of(expr, at) if x.lower() not in known]


def _metrics(p: Project) -> list[SpecError]:
    out: list[SpecError] = []
    canonical = p.catalog.canonical
    exprs: list[tuple[str, str, str | None]] = []
    for name in sorted(p.metrics):
        m, at = merged(p, name), f"metrics.{name}"
        if m.additivity == "non_additive":
            if not m.ratio and not m.decomposition and not (m.expr and m.requires_metrics):
                out.append(E.AdditivityViolation("a metric that can't be added up needs a ratio or a decomposition", at))
            if any(name in e.fields for e in p.entities.values()):
                out.append(E.AdditivityViolation("a metric that can't be added up is stored as a field", at))
            if any(name in mart.measures for mart in p.marts.values()):
                out.append(E.AdditivityViolation("a metric that can't be added up is a mart's measure", at))
        if m.additivity == "semi_additive":
            s = m.semi_additive or {}
            if not s.get("over") or not s.get("rule"):
                out.append(E.AdditivityViolation("a semi-additive metric says over what and by which rule", at))
            elif m.expr and s["over"] in aggregated(m.expr, at):
                out.append(E.AdditivityViolation(f"the expression aggregates over {s['over']!r}", at))
        if m.expr and m.grain:
            exprs.append((m.expr, at, m.grain))
    for mp in p.mappings:
        e = p.entities[mp.target]
        for f in mp.all.values():
            if f.kind == "recipe":
                c = canonical[e.fields[f.name].canonical or f.name]
                r = next(r for r in c["recipes"] if r["id"] == f.recipe)
                if r.get("expr"):
                    exprs.append((r["expr"], f"mapping[{mp.source}->{mp.target}].{f.name}", None))
    for expr, at, grain in exprs:
        try:
            out += _Arithmetic(expr, canonical, at).walk()
            if grain:
                fine = aggregated(expr, at)
                for x in columns_of(expr, at):
                    home = canonical.get(x, {}).get("entity") or next((n for n, e in p.entities.items() if x in e.fields), None)
                    if x not in p.entities[grain].fields and home and home != grain and x not in fine:
                        out.append(E.GrainMismatch(f"{x!r} is of {home}, the metric of {grain}: it would repeat once a row", at))
        except SpecError as err:
            out.append(err)
    return out


def mart_refusals(p: Project, mart: MartSpec) -> list[SpecError]:
    out: list[SpecError] = []
    at = f"marts.{mart.name}"
    if mart.grain != mart.base:
        out.append(E.GrainViolation(f"grain {mart.grain!r} is not that of the base {mart.base!r}", at))
    if p.entities[mart.base].scd == "type2":
        out.append(E.HistoricalFanout(f"base {mart.base!r} keeps history: a key has many rows", at))
    for x in mart.measures:
        if (g := merged(p, x).grain) and g != mart.grain:
            out.append(E.GrainViolation(f"measure {x!r} is of grain {g!r}, the mart of {mart.grain!r}", at))
    have, cols = {mart.base}, {f: mart.base for f in p.entities[mart.base].fields}
    roles = 0
    for step in mart.flatten:
        if "via" in step:
            rel = p.relationships[step["via"]]
            if rel.src not in have:
                out.append(E.FanoutRisk(f"{step['via']!r} starts from {rel.src!r}, which is not in the mart yet", at))
            if rel.cardinality == "one_to_many":
                out.append(E.FanoutRisk(f"{step['via']!r} gives many rows for one", at))
            if p.entities[rel.dst].scd == "type2":
                out.append(E.HistoricalFanout(f"{rel.dst!r} keeps history: which of a key's rows is meant is not said", at))
            if set(rel.via.values()) != set(p.entities[rel.dst].key):
                out.append(E.FanoutRisk(f"{step['via']!r} doesn't join the whole key of {rel.dst!r}", at))
            have.add(rel.dst)
            new = [step["prefix"] + f for f in p.entities[rel.dst].fields]
        else:
            roles += 1
            f = p.entities[mart.base].fields.get(step["date"])
            if f is None or not f.type.temporal:
                out.append(E.MissingReference(f"{step['date']!r} is no date of {mart.base!r}", at))
            new = [f"{step['role']}_{b}" for b in ("day", "week", "month", "quarter", "year")]
        for x in new:
            if x in cols:
                out.append(E.GuardrailError(f"column {x!r} is there twice", at))
            cols[x] = step.get("via", "date")
    if mart.measures and not roles:
        out.append(E.MissingTimeDimension("a mart with measures has a date role", at))
    if not out:
        dims = mart_dimensions(p, mart)
        for a in mart.asserts:
            for x in a.get("by", ()):
                if x not in dims:
                    out.append(E.MissingReference(f"assert {a['name']!r} by {x!r}, which is no column{nearest(x, dims)}", at))
            if a["measure"] not in dims:
                out.append(E.MissingReference(f"assert {a['name']!r} of {a['measure']!r}, which is no column", at))
            if a.get("min") is None and a.get("max") is None:
                out.append(E.GuardrailError(f"assert {a['name']!r} has no bound", at))
        for _, c in mart.partition_by:
            if c not in dims:
                out.append(E.MissingReference(f"partition column {c!r} is no column", at))
    return out


def _types(p: Project) -> list[SpecError]:
    out = []
    for name, e in p.entities.items():
        for f in e.fields.values():
            if f.canonical and f.canonical in p.catalog.canonical and not assignable(p.catalog.canonical[f.canonical]["type"], f.type) and not f.type.numeric:
                out.append(E.ChainTypeError(f"canonical {f.canonical!r} is {p.catalog.canonical[f.canonical]['type']}, the field {f.type}", f"entities.{name}.fields.{f.name}"))
    return out


def check(p: Project, registry: Registry | None = None) -> Project:
    """The project, or one refusal that holds all that a stage found: references, then types, then guardrails."""
    SpecError.batch(_references(p))
    SpecError.batch(metric_cycles(p) + _merges(p))
    SpecError.batch(_chains(p) + _types(p))
    SpecError.batch(_repairs(p))  # what a rule is called and does depends on them
    found = _asserts(p) + _quality(p) + _metrics(p) + [x for mart in p.marts.values() for x in mart_refusals(p, mart)]
    if registry is not None:
        macros = [f.macro for m in p.mappings for f in m.all.values() if f.kind == "macro"]
        macros += [q["repair"]["via"] for m in p.mappings for f in m.all.values() for q in f.quality if (q.get("repair") or {}).get("via")]
        for use in sorted({*macros, *(s["use"] for s in p.steps)}):
            try:
                registry.get(use)
            except SpecError as err:
                found.append(err)
    SpecError.batch(found)
    return p


def evidence(p: Project, registry: Registry | None = None) -> dict:
    """What holds of a project that may be unfinished: stages passed, refusals, and metrics in and out of reach."""
    from sparkgrain.plans.request import reachable

    stages = (("references", lambda: _references(p)), ("derivations", lambda: metric_cycles(p) + _merges(p)), ("types", lambda: _chains(p) + _types(p)), ("guardrails", lambda: _asserts(p) + _quality(p) + _metrics(p) + [x for m in p.marts.values() for x in mart_refusals(p, m)]))
    passed, refusals = [], []
    for name, stage in stages:
        if found := stage():
            refusals = [(type(x).__name__, str(x)) for x in sorted(found, key=str)]
            break
        passed.append(name)
    missing = {} if not passed else {m: reachable(p, m) for m in sorted(p.metrics)}
    return {"stages": passed, "refusals": refusals, "reachable": [m for m, x in missing.items() if not x], "unreachable": {m: x for m, x in missing.items() if x}}


__all__ = ["MappingSpec", "check", "columns_of", "evidence", "mart_refusals"]
