"""Strict reading of the six kinds of spec documents."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from sparkgrain.errors import ParseError
from sparkgrain.functions.transforms import Step, parse_step
from sparkgrain.functions.types import Logical, parse_type

RESERVED = {"metric_time", "_quality_flags", "_quality_ok", "_quality_repairs", "_load_id", "_ingested_at", "_source_row_id", "_source", "has_quality_flags"}
METADATA = ("_load_id", "_ingested_at", "_source_row_id")
_NAME, _PATH = re.compile(r"[a-z][a-z0-9_]*"), re.compile(r"\$(\.[A-Za-z_][A-Za-z0-9_]*)+")
_PARTITION, _RETENTION = re.compile(r"(?:(days|months|years|hours)\()?([a-z_][a-z0-9_]*)\)?"), re.compile(r"[1-9]\d*[hdw]")
AGGS = ("sum", "count", "count_distinct", "avg", "average", "min", "max", "median", "sum_boolean")


class _Loader(yaml.SafeLoader):
    """Safe YAML without repeated keys."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        twice = {k for k in keys if keys.count(k) > 1}
        if twice:
            raise ParseError(f"key {sorted(map(str, twice))[0]!r} is there twice")
        return super().construct_mapping(node, deep)


# names such as `on` are texts here, not truth values
_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def load_yaml(text: str, at: str) -> dict:
    try:
        got = yaml.load(text, _Loader)
    except yaml.YAMLError as e:
        raise ParseError(f"no YAML: {e}", at) from None
    if not isinstance(got, dict):
        raise ParseError("a document is a mapping", at)
    return got


def take(raw: dict, at: str, need: tuple[str, ...] = (), may: tuple[str, ...] = ()) -> dict:
    """The mapping, if it has the keys it needs and no unknown one."""
    if not isinstance(raw, dict):
        raise ParseError(f"a mapping is wanted, not {raw!r}", at)
    for k in need:
        if k not in raw:
            raise ParseError(f"{k!r} is missing", at)
    for k in raw:
        if k not in need and k not in may:
            raise ParseError(f"unknown key {k!r}", at)
    return raw


def named(x: object, at: str, reserved: bool = True) -> str:
    if not isinstance(x, str) or not _NAME.fullmatch(x):
        raise ParseError(f"{x!r} is no name of lower-case letters, digits and underscores", at)
    if reserved and x in RESERVED:
        raise ParseError(f"{x!r} is reserved", at)
    return x


def pathed(x: object, at: str) -> str:
    if not isinstance(x, str) or not _PATH.fullmatch(x):
        raise ParseError(f"{x!r} is no path such as $.a.b", at)
    return x


def choice(x: object, of: tuple, at: str):
    if x not in of:
        raise ParseError(f"{x!r} is none of {', '.join(map(str, of))}", at)
    return x


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: Logical
    required: bool = False
    canonical: str | None = None
    asserts: dict = field(default_factory=dict)
    renamed_from: str | None = None


@dataclass(frozen=True)
class EntitySpec:
    name: str
    grain: str
    key: tuple[str, ...]
    fields: dict[str, FieldSpec]
    scd: str = "type1"
    materialization: str | None = None
    partition_by: tuple[tuple[str | None, str], ...] = ()
    dedupe: dict | None = None
    quarantine: dict | None = None
    quality: tuple[dict, ...] = ()


@dataclass(frozen=True)
class RelationshipSpec:
    name: str
    src: str
    dst: str
    via: dict[str, str]
    cardinality: str


@dataclass(frozen=True)
class FieldMapping:
    name: str
    kind: str  # path, recipe or macro
    source: str | None = None
    chain: tuple[Step, ...] = ()
    recipe: str | None = None
    inputs: dict[str, str] = field(default_factory=dict)
    direct: str | None = None
    macro: str | None = None
    parameters: dict = field(default_factory=dict)
    quality: tuple[dict, ...] = ()


@dataclass(frozen=True)
class MappingSpec:
    source: str
    target: str
    key: dict[str, FieldMapping]
    fields: dict[str, FieldMapping]
    unmapped: tuple[str, ...] = ()

    @property
    def all(self) -> dict[str, FieldMapping]:
        return {**self.key, **self.fields}


@dataclass(frozen=True)
class MetricSpec:
    name: str
    grain: str | None = None
    additivity: str | None = None
    agg: str | None = None
    expr: str | None = None
    requires: tuple[str, ...] = ()
    requires_metrics: tuple[str, ...] = ()
    ratio: dict | None = None
    semi_additive: dict | None = None
    decomposition: dict | None = None
    template: str | None = None


@dataclass(frozen=True)
class MartSpec:
    name: str
    grain: str
    base: str
    flatten: tuple[dict, ...]
    measures: tuple[str, ...] = ()
    partition_by: tuple[tuple[str | None, str], ...] = ()
    materialization: str | None = None
    cost_hint: int = 1
    asserts: tuple[dict, ...] = ()


@dataclass(frozen=True)
class CatalogSpec:
    vertical: str = ""
    canonical: dict[str, dict] = field(default_factory=dict)
    relationships: tuple[dict, ...] = ()
    date_dimension: dict | None = None
    templates: dict[str, MetricSpec] = field(default_factory=dict)


@dataclass(frozen=True)
class Project:
    catalog: CatalogSpec
    entities: dict[str, EntitySpec]
    relationships: dict[str, RelationshipSpec]
    mappings: tuple[MappingSpec, ...]
    metrics: dict[str, MetricSpec]
    marts: dict[str, MartSpec]
    steps: tuple[dict, ...] = ()
    reconcile: tuple[dict, ...] = ()
    coverage: tuple[dict, ...] = ()

    def entity(self, name: str) -> EntitySpec:
        return self.entities[name]

    def mappings_of(self, entity: str) -> list[MappingSpec]:
        """In the order in which their rows are united."""
        return sorted((m for m in self.mappings if m.target == entity), key=lambda m: m.source)


def _partitions(raw: object, at: str) -> tuple:
    out = []
    for x in raw or ():
        m = _PARTITION.fullmatch(str(x))
        if not m or bool(m[1]) != str(x).endswith(")"):
            raise ParseError(f"{x!r} is no partition such as a column or days(column)", at)
        out.append((m[1], m[2]))
    return tuple(out)


def _quality(raw: object, at: str) -> tuple[dict, ...]:
    out = []
    for i, r in enumerate(raw or ()):
        here = f"{at}[{i}]"
        take(r, here, ("rule",), ("on_fail", "on_missing", "min", "max", "regex", "values", "form", "allow", "forbid", "name", "expr", "via", "repair"))
        kind = choice(r["rule"], ("coercible", "not_null", "range", "length", "pattern", "in_enum", "in_set", "normalize", "charset", "unique", "expression", "referential"), here)
        if kind == "referential":
            choice(r.get("on_missing"), ("flag", "quarantine", "unknown_member"), here)
        else:
            choice(r.get("on_fail"), ("flag", "quarantine", "fail", "repair"), here)
        out.append(dict(r))
    return tuple(out)


def _entity(name: str, raw: dict, at: str) -> EntitySpec:
    take(raw, at, ("grain", "key", "fields"), ("scd", "materialization", "partition_by", "dedupe", "quarantine", "quality", "description"))
    fields = {}
    for f, spec in raw["fields"].items():
        here = f"{at}.fields.{f}"
        take(spec, here, ("type",), ("required", "canonical", "assert", "renamed_from", "description"))
        fields[named(f, here)] = FieldSpec(f, parse_type(spec["type"], here), bool(spec.get("required", False)), spec.get("canonical"), dict(spec.get("assert") or {}), spec.get("renamed_from"))
    if not raw["key"] or len(set(raw["key"])) != len(raw["key"]):
        raise ParseError("a key is one or more columns, each once", at)
    if raw.get("dedupe") is not None:
        take(raw["dedupe"], f"{at}.dedupe", ("keep", "field"), ("tie_break",))
        choice(raw["dedupe"]["keep"], ("latest_by",), f"{at}.dedupe")
    if raw.get("quarantine") is not None:
        take(raw["quarantine"], f"{at}.quarantine", ("retention",), ("redact",))
        if not _RETENTION.fullmatch(str(raw["quarantine"]["retention"])):
            raise ParseError("a retention is such as 90d, 12h or 2w", f"{at}.quarantine")
    return EntitySpec(
        named(name, at), str(raw["grain"]).strip(), tuple(raw["key"]), fields, choice(raw.get("scd", "type1"), ("type1", "type2"), at),
        raw.get("materialization") and choice(raw["materialization"], ("full", "incremental_by_key", "incremental_by_partition"), at),
        _partitions(raw.get("partition_by"), at), raw.get("dedupe"), raw.get("quarantine"), _quality(raw.get("quality"), f"{at}.quality"),
    )


def _field_mapping(name: str, raw: dict, at: str) -> FieldMapping:
    quality = _quality(raw.get("quality") if isinstance(raw, dict) else None, f"{at}.quality")
    if isinstance(raw, dict) and "recipe" in raw:
        take(raw, at, ("recipe", "from"), ("direct", "quality"))
        inputs = {k: pathed(v, at) for k, v in take(raw["from"], at, (), tuple(raw["from"])).items()}
        return FieldMapping(name, "recipe", recipe=raw["recipe"], inputs=inputs, direct=raw.get("direct") and pathed(raw["direct"], at), quality=quality)
    if isinstance(raw, dict) and "macro" in raw:
        take(raw, at, ("macro", "from"), ("parameters", "quality"))
        return FieldMapping(name, "macro", macro=raw["macro"], inputs={k: pathed(v, at) for k, v in raw["from"].items()}, parameters=dict(raw.get("parameters") or {}), quality=quality)
    take(raw, at, ("from",), ("transform", "quality"))
    return FieldMapping(name, "path", pathed(raw["from"], at), tuple(parse_step(s, at) for s in raw.get("transform") or ()), quality=quality)


def _metric(name: str, raw: dict, at: str) -> MetricSpec:
    take(raw, at, (), ("grain", "additivity", "agg", "expr", "requires", "requires_metrics", "ratio", "semi_additive", "template", "cumulative", "decomposition", "description", "label"))
    if raw.get("additivity") is not None:
        choice(raw["additivity"], ("additive", "semi_additive", "non_additive"), at)
    if raw.get("agg") is not None:
        choice(raw["agg"], AGGS, at)
    if raw.get("ratio") is not None:
        take(raw["ratio"], f"{at}.ratio", ("numerator", "denominator"))
    if raw.get("semi_additive") is not None:
        take(raw["semi_additive"], f"{at}.semi_additive", (), ("over", "rule"))
    return MetricSpec(name, *(raw.get(k) for k in ("grain", "additivity", "agg", "expr")), tuple(raw.get("requires") or ()), tuple(raw.get("requires_metrics") or ()), raw.get("ratio"), raw.get("semi_additive"), raw.get("decomposition"), raw.get("template"))


def parse_catalog(raw: dict, at: str = "catalog") -> CatalogSpec:
    take(raw, at, ("catalog_version",), ("vertical", "canonical_fields", "canonical_relationships", "date_dimension", "metric_templates"))
    choice(raw["catalog_version"], (1,), at)
    canonical = {}
    for k, v in (raw.get("canonical_fields") or {}).items():
        here = f"{at}.canonical_fields.{k}"
        take(v, here, ("entity", "type"), ("unit", "tax_basis", "currency", "recipes", "description"))
        for r in v.get("recipes") or ():
            take(r, here, ("id", "requires"), ("expr",))
        canonical[named(k, here)] = {**v, "type": parse_type(v["type"], here)}
    if (d := raw.get("date_dimension")) is not None:
        take(d, f"{at}.date_dimension", ("name", "start_year", "end_year"), ("grain",))
        if not isinstance(d["start_year"], int) or not isinstance(d["end_year"], int) or d["start_year"] > d["end_year"]:
            raise ParseError("years must be whole and in order", f"{at}.date_dimension")
    templates = {k: _metric(k, v, f"{at}.metric_templates.{k}") for k, v in (raw.get("metric_templates") or {}).items()}
    return CatalogSpec(raw.get("vertical", ""), canonical, tuple(raw.get("canonical_relationships") or ()), raw.get("date_dimension"), templates)


def parse_project(documents: dict[str, dict], catalog: CatalogSpec | None = None) -> Project:
    """A project out of its documents by name; a document's kind is told by its version key."""
    entities, rels, mappings, metrics, marts, steps = {}, {}, [], {}, {}, ()
    reconcile, coverage, kinds = (), (), {}
    for at, raw in sorted(documents.items()):
        kind = [k for k in ("catalog_version", "spec_version", "mapping_version", "metrics_version", "marts_version", "steps_version") if k in raw]
        if len(kind) != 1:
            raise ParseError("a document has one version key", at)
        choice(raw[kind[0]], (1,), at)
        if kind[0] in kinds and kind[0] != "mapping_version":
            raise ParseError(f"a second document with {kind[0]}", at)
        kinds[kind[0]] = at
        if kind[0] == "catalog_version":
            catalog = parse_catalog(raw, at)
        elif kind[0] == "spec_version":
            take(raw, at, ("spec_version", "entities"), ("relationships", "reconcile", "coverage"))
            entities = {k: _entity(k, v, f"{at}.entities.{k}") for k, v in raw["entities"].items()}
            for i, r in enumerate(raw.get("relationships") or ()):
                take(r, f"{at}.relationships[{i}]", ("name", "from", "to", "via", "cardinality"))
                choice(r["cardinality"], ("many_to_one", "one_to_one", "one_to_many"), f"{at}.relationships[{i}]")
                rels[named(r["name"], at)] = RelationshipSpec(r["name"], r["from"], r["to"], dict(r["via"]), r["cardinality"])
            for r in raw.get("reconcile") or ():
                take(r, f"{at}.reconcile", ("name", "left", "right", "on_fail"), ("tolerance",))
            for r in raw.get("coverage") or ():
                take(r, f"{at}.coverage", ("name", "relationship", "min", "on_fail"))
            reconcile, coverage = tuple(raw.get("reconcile") or ()), tuple(raw.get("coverage") or ())
        elif kind[0] == "mapping_version":
            take(raw, at, ("mapping_version", "source", "target", "key"), ("fields", "unmapped"))
            read = lambda part: {k: _field_mapping(k, v, f"{at}.{part}.{k}") for k, v in (raw.get(part) or {}).items()}
            mappings.append(MappingSpec(named(raw["source"], at), raw["target"], read("key"), read("fields"), tuple(pathed(p, at) for p in raw.get("unmapped") or ())))
        elif kind[0] == "metrics_version":
            take(raw, at, ("metrics_version", "metrics"))
            metrics = {named(k, at): _metric(k, v, f"{at}.metrics.{k}") for k, v in raw["metrics"].items()}
        elif kind[0] == "marts_version":
            take(raw, at, ("marts_version", "marts"))
            for k, v in raw["marts"].items():
                here = f"{at}.marts.{k}"
                take(v, here, ("grain", "base"), ("flatten", "measures", "partition_by", "materialization", "cost_hint", "assert"))
                for s in v.get("flatten") or ():
                    take(s, here, ("via", "prefix") if "via" in s else ("date", "role"))
                for a in v.get("assert") or ():
                    take(a, here, ("name", "measure", "agg", "on_fail"), ("by", "min", "max"))
                marts[named(k, here)] = MartSpec(k, v["grain"], v["base"], tuple(v.get("flatten") or ()), tuple(v.get("measures") or ()), _partitions(v.get("partition_by"), here), v.get("materialization"), v.get("cost_hint", 1), tuple(v.get("assert") or ()))
        else:
            take(raw, at, ("steps_version", "steps"))
            for s in raw["steps"]:
                take(s, at, ("use",), ("inputs", "outputs", "parameters", "canonical", "quality", "applies_to"))
            steps = tuple(raw["steps"])
    if not entities:
        raise ParseError("a project has an entity model")
    return Project(catalog or CatalogSpec(), entities, rels, tuple(mappings), metrics, marts, steps, reconcile, coverage)


def load_project(folder: str) -> Project:
    """All YAML documents of a folder."""
    return parse_project({p.stem: load_yaml(p.read_text("utf-8"), p.name) for p in sorted(Path(folder).glob("*.y*ml"))})


def parse_texts(texts: dict[str, str]) -> Project:
    return parse_project({k: load_yaml(v, k) for k, v in texts.items()})


def fingerprint(project: Project) -> str:
    """SHA-256 of the project in a canonical form: order and layout of documents don't matter."""
    import hashlib
    from dataclasses import asdict

    return hashlib.sha256(json.dumps(asdict(project), sort_keys=True, default=str).encode()).hexdigest()
