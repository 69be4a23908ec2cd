"""python -m sparkgrain.cli {check,plan,evidence,explain,compile,resolve,fingerprint,schema} ...: exits 0, 1 if refused, 2 if misused."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from sparkgrain.errors import SpecError
from sparkgrain.plans import spec as S
from sparkgrain.plans.evolve import diff
from sparkgrain.plans.guard import check, evidence
from sparkgrain.plans.request import MetricRequest, RowPolicy, merged, owners, parse_filter_json, plan, reachable

KINDS = {"catalog": S.CatalogSpec, "entity": S.EntitySpec, "mapping": S.MappingSpec, "metric": S.MetricSpec, "mart": S.MartSpec, "relationship": S.RelationshipSpec, "project": S.Project}


def spec_json_schema(kind: str) -> dict:
    """A JSON schema of one kind of spec: its keys, closed."""
    if kind not in KINDS:
        raise KeyError(kind)
    types = {"str": "string", "int": "integer", "bool": "boolean", "dict": "object", "tuple": "array"}
    props = {}
    for f in fields(KINDS[kind]):
        base = str(f.type).split("[")[0].split(" ")[0]
        props[f.name] = {"type": [types[base], "null"] if "None" in str(f.type) else types[base]} if base in types else {}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": kind, "type": "object", "properties": props, "additionalProperties": False}


def asked(ex: argparse.ArgumentParser) -> None:
    """The arguments of a request."""
    ex.add_argument("folder")
    ex.add_argument("--metrics", required=True)
    ex.add_argument("--by", default="")
    ex.add_argument("--where", default="{}")
    ex.add_argument("--grain")
    ex.add_argument("--limit", type=int)
    ex.add_argument("--policy", help="dimension=value,value")


def resolved(p: S.Project) -> dict:
    """Where each field of each entity comes from, and what each metric needs and has."""
    def source(f: S.FieldMapping) -> dict:
        own = {"path": f.source} if f.kind == "path" else {f.kind: f.recipe or f.macro, "from": f.inputs}
        return own | ({"transform": [s.name for s in f.chain]} if f.chain else {})

    entities = {e: {m.source: {k: source(f) for k, f in sorted(m.all.items())} for m in p.mappings_of(e)} for e in sorted(p.entities)}
    return {"entities": entities, "metrics": {m: {"grain": merged(p, m).grain, "mart": owners(p)[m].name if m in owners(p) else None, "missing": reachable(p, m)} for m in sorted(p.metrics)}}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sparkgrain")
    sub = ap.add_subparsers(dest="what", required=True)
    for name in ("check", "evidence", "fingerprint"):
        sub.add_parser(name).add_argument("folder")
    two = sub.add_parser("plan")
    two.add_argument("old")
    two.add_argument("new")
    sub.add_parser("resolve").add_argument("folder")
    for name in ("explain", "compile"):
        asked(sub.add_parser(name))
    sub.add_parser("schema").add_argument("kind", choices=sorted(KINDS))
    try:
        a = ap.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.what == "schema":
            print(json.dumps(spec_json_schema(a.kind), indent=2))
        elif a.what == "plan":
            got = diff(S.load_project(a.old), S.load_project(a.new))
            print(json.dumps({"changes": [vars(c) for c in got.changes], "backfill": got.backfill, "replay": got.replay, "metrics": got.metrics}, indent=2))
        elif a.what == "evidence":
            print(json.dumps(evidence(S.load_project(a.folder)), indent=2))
        elif a.what == "fingerprint":
            print(S.fingerprint(check(S.load_project(a.folder))))
        elif a.what == "resolve":
            print(json.dumps(resolved(check(S.load_project(a.folder))), indent=2))
        elif a.what in ("explain", "compile"):
            split = lambda x: tuple(y for y in x.split(",") if y)
            policy = RowPolicy(a.policy.split("=")[0], split(a.policy.split("=", 1)[1])) if a.policy else None
            got = plan(check(S.load_project(a.folder)), MetricRequest(split(a.metrics), split(a.by), parse_filter_json(json.loads(a.where)), a.grain, limit=a.limit), policy)
            print(got.sql() if a.what == "compile" else json.dumps({"mart": got.mart.name, "columns": {k: str(t) for k, t in got.columns.items()}, "warnings": got.warnings, "explanation": got.explanation, "fingerprint": got.fingerprint}, indent=2))
        else:
            p = check(S.load_project(a.folder))
            print(f"{len(p.entities)} entities, {len(p.mappings)} mappings, {len(p.metrics)} metrics, {len(p.marts)} marts")
    except (SpecError, OSError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
