"""Data-quality rules as violation predicates: true only where a row definitely breaks the rule."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkgrain.errors import GuardrailError, ParseError
from sparkgrain.functions.transforms import cast, enum_targets, nullifying
from sparkgrain.functions.types import STRING, Logical
from sparkgrain.plans.spec import EntitySpec, MappingSpec, Project

UNKNOWN_MEMBER = "__unknown__"


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    column: str | None
    on_fail: str
    params: dict = field(default_factory=dict)


def opted_in(entity: EntitySpec, mappings: list[MappingSpec]) -> bool:
    """Whether an entity asks for the quality system at all."""
    return bool(entity.dedupe or entity.quarantine or entity.quality or any(f.quality for m in mappings for f in m.all.values()))


def sources_of(m: MappingSpec, column: str) -> tuple[str, ...]:
    """The paths that a column is made from."""
    f = m.all[column]
    return (f.source,) if f.kind == "path" else tuple(sorted(f.inputs.values()))


def rules_of(project: Project, entity: EntitySpec) -> list[Rule]:
    """The entity's rules in order of name: declared, implied and of rows; generated names are given out first."""
    mappings = project.mappings_of(entity.name)
    if not mappings or not opted_in(entity, mappings):
        return []
    m = mappings[0]
    order_by = {entity.dedupe["field"], *entity.dedupe.get("tie_break", ())} if entity.dedupe else set()
    slices = tuple(col for _, col in entity.partition_by)
    made: list[Rule] = []
    for col, f in sorted(m.all.items()):
        for q in f.quality:
            p = {k: v for k, v in q.items() if k not in ("rule", "on_fail")}
            stem = f"{col}_{q['rule']}"
            if q["rule"] in ("range", "length") and (q.get("min") is None) != (q.get("max") is None):
                stem += "_min" if q.get("min") is not None else "_max"
            if q["rule"] == "unique":
                p["slice"] = slices
            if q["rule"] == "in_enum":
                p["values"] = enum_targets(list(f.chain)) or []
            how = q["repair"]["fallback"] if q["on_fail"] == "repair" else q["on_fail"]  # for what the repair leaves broken
            made.append(Rule(stem, q["rule"], col, how, p))
        if not any(q["rule"] == "coercible" for q in f.quality) and (col in order_by or not nullifying(list(f.chain))):
            made.append(Rule(f"{col}_coercible", "coercible", col, "fail" if col in order_by else "quarantine"))
    written = []
    for q in entity.quality:
        if q["rule"] == "expression":
            written.append(Rule(q["name"], "expression", None, q["on_fail"], {"expr": q["expr"]}))
        elif q["rule"] == "referential":
            rel = project.relationships.get(q["via"])
            if rel:
                made.append(Rule(f"{q['via']}_referential", "referential", None, q["on_missing"], {"relationship": rel}))
    taken: set[str] = set()
    out = []
    for part in (made, written):
        for r in sorted(part, key=lambda r: (r.name, r.kind, r.on_fail, repr(sorted(r.params.items(), key=str)))):
            name, i = r.name, 1
            while name in taken:
                i += 1
                name = f"{r.name}_{i}"
            taken.add(name)
            out.append(replace(r, name=name))
    return sorted(out, key=lambda r: r.name)


# what patterns may hold ---------------------------------------------------------------------------------------------

def portable_pattern(regex: str, at: str = "") -> str:
    """A pattern out of the portable subset, in Java's spelling; refuses what engines read differently."""

    def no(why: str):
        raise ParseError(f"pattern {regex!r}: {why}", at)

    if not (regex.startswith("^") and regex.endswith("$")) or regex.endswith("\\$"):
        no("it must be anchored by ^ and $")
    body, i, out, stack, repeated = regex[1:-1], 0, "", [], []
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            if i + 1 >= len(body):
                no("it ends in a backslash")
            if body[i + 1].isalnum() and body[i + 1] not in "dwsDWSnrt":
                no(f"escape \\{body[i + 1]}")
            out, i = out + body[i : i + 2], i + 2
            continue
        if ch == "[":
            end = i + 1 + (body[i + 1 : i + 2] == "^")
            end += body[end : end + 1] == "]"
            while end < len(body) and body[end] != "]":
                end += 2 if body[end] == "\\" else 1
            if end >= len(body):
                no("an open class")
            cls = body[i : end + 1]
            if "[:" in cls or "&&" in cls or "[" in cls[1:]:
                no("a class inside a class")
            out, i = out + cls, end + 1
            continue
        if ch == "(":
            if body[i + 1 : i + 3] == "?:":
                stack.append(False)
                out, i = out + "(?:", i + 3
                continue
            no("groups must be (?:...)")
        if ch == ")":
            if not stack:
                no("a closing bracket too many")
            repeated = [stack.pop()]
            if body[i + 1 : i + 2] in ("*", "+") or re.match(r"\{\d+,\}", body[i + 1 :]):
                if repeated[0]:
                    no("an unbounded repetition inside another")
                if stack:
                    stack[-1] = True
        elif ch in "*+" or re.match(r"\{\d+,\}", body[i:]):
            if stack:
                stack[-1] = True
            if body[i + 1 : i + 2] in ("?", "+", "*") and ch in "*+":
                no("lazy and possessive repetition")
        elif ch in "^$":
            no("an anchor inside")
        elif ch == "|" and not stack:
            no("alternatives belong in a group")
        out, i = out + ch, i + 1
    if stack:
        no("an open bracket")
    return rf"\A{out}\z"


def code_points(items: list, at: str = "") -> str:
    """Characters of U+XXXX items, ranges of them, and plain texts; at most 1024, no surrogates."""
    out: list[str] = []
    for item in items:
        item = str(item)
        if item.startswith("U+"):
            lo, _, hi = item.partition("-")
            try:
                a, b = int(lo[2:], 16), int((hi or lo).removeprefix("U+"), 16)
            except ValueError:
                raise ParseError(f"{item!r} is no code point", at) from None
            if a > b or b > 0x10FFFF or (a <= 0xDFFF and b >= 0xD800):
                raise ParseError(f"{item!r} is backwards, a surrogate or no code point", at)
            if b - a > 1024:
                raise ParseError("a set holds at most 1024 characters", at)
            out += map(chr, range(a, b + 1))
        else:
            out += item
    out = list(dict.fromkeys(out))
    if len(out) > 1024:
        raise ParseError("a set holds at most 1024 characters", at)
    return "".join(out)


def nfc(col: Column) -> Column:
    """Unicode NFC; Spark has no such function."""

    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.pandas_udf(normal, StringType())(col)


def bound(value: object, t: Logical, at: str = "") -> Column:
    """A rule's bound as a literal of the column's type; decimals exactly."""
    try:
        if t.name == "date":
            return F.lit(date.fromisoformat(str(value)))
        if t.name == "timestamp":
            return F.lit(datetime.fromisoformat(str(value).replace("Z", "+00:00")).replace(tzinfo=None)).cast("timestamp_ntz")
        d = Decimal(str(value))
        if not d.is_finite():
            raise InvalidOperation
        return F.expr(f"{d:f}BD") if "." in f"{d:f}" else F.expr(f"{d:f}BD")
    except (ValueError, InvalidOperation):
        raise GuardrailError(f"{value!r} is no bound of a {t}", at) from None


def verdict(rule: Rule, types: dict[str, Logical]) -> Column:
    """The rule's predicate over the extracted level; windowed and referential ones read columns staged before."""
    c = F.col(rule.column) if rule.column else None
    p = rule.params
    if rule.kind == "coercible":
        return c.isNull() & F.col(f"_src_{rule.column}")
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind in ("range", "length"):
        t = types[rule.column]
        subject = F.length(c) if rule.kind == "length" else c
        parts = []
        for key, out in (("min", lambda b: subject < b), ("max", lambda b: subject > b)):
            if p.get(key) is not None:
                parts.append(out(F.lit(int(p[key])) if rule.kind == "length" else bound(p[key], t)))
        return parts[0] if len(parts) == 1 else parts[0] | parts[1]
    if rule.kind == "pattern":
        return ~c.rlike(portable_pattern(p["regex"]))
    if rule.kind in ("in_enum", "in_set"):
        return ~c.isin(*p["values"]) if p["values"] else c.isNotNull()
    if rule.kind == "normalize":
        return nfc(c) != c
    if rule.kind == "charset":
        if p.get("allow") is not None:
            return F.length(F.translate(c, code_points(p["allow"]), "")) > 0
        return F.length(F.translate(c, code_points(p["forbid"]), "")) < F.length(c)
    if rule.kind == "expression":
        return ~F.expr(p["expr"])
    return F.col(f"_verdict_{rule.name}")  # unique, referential


def stage_windows(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Verdicts of unique rules, computed once and read by name."""
    for r in rules:
        if r.kind == "unique":
            w = Window.partitionBy(*[F.col(x) for x in (*r.params.get("slice", ()), r.column)])
            rows = rows.withColumn(f"_verdict_{r.name}", F.col(r.column).isNotNull() & (F.count(F.lit(1)).over(w) > 1))
    return rows


def stage_references(rows: DataFrame, rules: list[Rule], parents: dict[str, DataFrame]) -> DataFrame:
    """Verdicts of referential rules: every part of the key is there and the parent is not. Parents are probed by
    distinct keys, so none fans rows out."""
    for r in rules:
        if r.kind == "referential":
            rel = r.params["relationship"]
            keys = list(rel.via.items())
            probe = parents[rel.dst].select(*[F.col(b).alias(f"_parent_{i}") for i, (_, b) in enumerate(keys)]).distinct().withColumn("_found", F.lit(True))
            on = [rows[a] == probe[f"_parent_{i}"] for i, (a, _) in enumerate(keys)]
            there = F.lit(True)
            for a, _ in keys:
                there = there & F.col(a).isNotNull()
            rows = rows.join(probe, on, "left").withColumn(f"_verdict_{r.name}", there & F.col("_found").isNull()).drop("_found", *[f"_parent_{i}" for i in range(len(keys))])
    return rows


def flags(rules: list[Rule], types: dict[str, Logical]) -> Column:
    """Names of the rules that fired, in order, in one pass; never null."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(verdict(r, types), F.lit(r.name)) for r in sorted(rules, key=lambda r: r.name)]))


def _names(rules: list[Rule], *dispositions: str) -> Column:
    return F.array(*[F.lit(r.name) for r in rules if r.on_fail in dispositions]).cast("array<string>")


def recorded(rules: list[Rule]) -> Column:
    """Of the rules that fired, in order, those that don't divert: what a kept row is flagged with."""
    keep = _names(rules, "flag", "fail", "unknown_member")
    return F.filter(F.col("_failed"), lambda x: F.array_contains(keep, x))


def routed(rules: list[Rule]) -> Column:
    """Whether a row is diverted: a quarantine rule fired. Unknown counts as no, so kept and diverted part the rows."""
    return F.arrays_overlap(F.col("_failed"), _names(rules, "quarantine"))


__all__ = ["Rule", "STRING", "bound", "cast", "code_points", "flags", "nfc", "opted_in", "portable_pattern", "recorded", "routed", "rules_of", "sources_of", "stage_references", "stage_windows", "verdict"]
