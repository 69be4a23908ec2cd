"""Registered steps: spliced SQL expressions, SQL models and Python models, with their contracts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrain.errors import StepContract, StepDeterminism, StepError, UnknownStep, nearest
from sparkgrain.functions.types import parse_type

_HOLE = re.compile(r"(?<![:\w]):([a-z_][a-z0-9_]*)")


@dataclass(frozen=True)
class StepDef:
    """A versioned step. kind: sql_macro, sql_model or python_model; outputs: name -> (columns with types, key, required,
    references: column -> output)."""

    ref: str
    version: int
    kind: str
    body: str = ""
    run: Callable[..., dict[str, DataFrame]] | None = None
    inputs: tuple[str, ...] = ()
    outputs: dict[str, dict] = field(default_factory=dict)
    parameters: dict[str, dict] = field(default_factory=dict)
    determinism: str = "pure"

    @property
    def name(self) -> str:
        return f"{self.ref}@{self.version}"


class Registry:
    """Steps by ref@version; one is registered once."""

    def __init__(self, steps: tuple[StepDef, ...] = ()):
        self._steps: dict[str, StepDef] = {}
        for s in steps:
            self.add(s)

    def add(self, s: StepDef) -> None:
        if s.name in self._steps:
            raise StepError(f"step {s.name} exists")
        if s.determinism == "nondeterministic":
            raise StepDeterminism(f"step {s.name} is not deterministic")
        if s.determinism == "seeded" and "seed" not in s.parameters:
            raise StepDeterminism(f"step {s.name} is seeded and has no seed")
        if s.kind == "sql_macro" and s.determinism != "pure":
            raise StepDeterminism(f"macro {s.name} must be pure")
        self._steps[s.name] = s

    def get(self, name: str) -> StepDef:
        if name not in self._steps:
            raise UnknownStep(f"no step {name!r}{nearest(name, self._steps)}")
        return self._steps[name]


def literal(value: object, spec: dict, at: str) -> str:
    """A parameter as SQL, checked against its type and bounds; never spliced as text."""
    t = parse_type(spec.get("type", "string"), at)
    if t.numeric:
        if isinstance(value, bool) or not re.fullmatch(r"-?\d+(\.\d+)?", str(value)):
            raise StepError(f"{value!r} is no number", at)
        from decimal import Decimal

        if (spec.get("min") is not None and Decimal(str(value)) < Decimal(str(spec["min"]))) or (spec.get("max") is not None and Decimal(str(value)) > Decimal(str(spec["max"]))):
            raise StepError(f"{value} is out of bounds", at)
        return str(value)
    if t.name == "bool":
        if not isinstance(value, bool):
            raise StepError(f"{value!r} is no truth value", at)
        return str(value).lower()
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{text}' AS {t.spark.simpleString()})"


def parameters(step: StepDef, given: dict) -> dict[str, str]:
    for k in given:
        if k not in step.parameters:
            raise StepError(f"{step.name} has no parameter {k!r}{nearest(k, step.parameters)}")
    out = {}
    for k, spec in step.parameters.items():
        if k not in given and "default" not in spec:
            raise StepError(f"{step.name} needs parameter {k!r}")
        out[k] = literal(given.get(k, spec.get("default")), spec, f"{step.name}.{k}")
    return out


def spliced(registry: Registry, name: str, columns: dict[str, str], given: dict) -> str:
    """A macro's body with its columns and parameters in place."""
    step = registry.get(name)
    if step.kind != "sql_macro":
        raise StepError(f"{name} is no macro")
    known = {**columns, **parameters(step, given)}
    missing = set(_HOLE.findall(step.body)) - set(known)
    if missing:
        raise StepError(f"{name} reads {sorted(missing)}, which nothing gives")
    return "(" + _HOLE.sub(lambda m: known[m[1]], step.body) + ")"


def check_contract(step: StepDef, output: str, df: DataFrame) -> DataFrame:
    """The output as declared, or a refusal: columns, types, required values and key (one aggregate)."""
    spec = step.outputs[output]
    want = {c: parse_type(t) for c, t in spec["columns"].items()}
    if set(df.columns) != set(want):
        raise StepContract(f"{step.name}.{output}: columns {sorted(df.columns)}, declared {sorted(want)}")
    wrong = [c for c, t in want.items() if df.schema[c].dataType != t.spark]
    if wrong:
        raise StepContract(f"{step.name}.{output}: types of {wrong}")
    need = list(dict.fromkeys([*spec.get("required", ()), *spec.get("key", ())]))
    if need:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in need]).first()
        if bad := [c for c in need if nulls[c]]:
            raise StepContract(f"{step.name}.{output}: nulls in {bad}")
    if spec.get("key") and df.groupBy(*spec["key"]).count().where("count > 1").limit(1).count():
        raise StepContract(f"{step.name}.{output}: {spec['key']} is no key")
    return df.select(*sorted(want))


def run_step(registry: Registry, wiring: dict, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A wired step's outputs by relation, contracts checked."""
    step = registry.get(wiring["use"])
    for i in step.inputs:
        if i not in (wiring.get("inputs") or {}):
            raise StepError(f"{step.name}: input {i!r} is not bound")
    for o in step.outputs:
        if o not in (wiring.get("outputs") or {}):
            raise StepError(f"{step.name}: output {o!r} is not bound")
    bound = {k: tables[v.split(".")[-1]] for k, v in (wiring.get("inputs") or {}).items()}
    given = dict(wiring.get("parameters") or {})
    lits = parameters(step, given)
    if step.kind == "python_model":
        got = step.run(bound, **{k: given.get(k, step.parameters[k].get("default")) for k in step.parameters})
    elif step.kind == "sql_model":
        spark = next(iter(bound.values())).sparkSession
        body = _HOLE.sub(lambda m: lits[m[1]], step.body)
        got = {next(iter(step.outputs)): spark.sql(body, **bound)}
    else:
        raise StepError(f"{step.name} is a macro; it is no step of its own")
    return {wiring["outputs"][o].split(".")[-1]: check_contract(step, o, got[o]) for o in step.outputs}


def siblings_consistent(parent: DataFrame, child: DataFrame, ref: str, key: str) -> DataFrame:
    """Child rows whose reference no parent row has."""
    return child.where(F.col(ref).isNotNull()).join(parent.select(F.col(key).alias("_key")).distinct(), F.col(ref) == F.col("_key"), "left_anti")


def sibling_audits(step: StepDef, outputs: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    """For each reference that an output declares (references: {column: output}), its rows without a match in the other
    output's key. Outputs may each be sound and yet disagree."""
    out = []
    for child, spec in step.outputs.items():
        for column, parent in sorted((spec.get("references") or {}).items()):
            if parent not in step.outputs or len(step.outputs[parent].get("key", ())) != 1 or column not in spec["columns"]:
                raise StepContract(f"{step.name}.{child}.{column} refers to {parent!r}, which is no output of one key column")
            out.append((f"step_{child}_{column}_in_{parent}", siblings_consistent(outputs[parent], outputs[child], column, step.outputs[parent]["key"][0])))
    return out
