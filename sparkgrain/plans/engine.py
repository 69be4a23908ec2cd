"""Running a project: entities in order, audits, rejects, marts, the quality mart; and answering requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrain.errors import CircularDerivation, Unsupported
from sparkgrain.operators import audits as A
from sparkgrain.operators import marts as M
from sparkgrain.operators import rejects as J
from sparkgrain.operators import rules as R
from sparkgrain.operators.quality_mart import Counted, quality_mart
from sparkgrain.operators.silver import Silver, evaluate
from sparkgrain.operators.steps import Registry, run_step, sibling_audits
from sparkgrain.plans.guard import check
from sparkgrain.plans.request import MetricRequest, QueryPlan, RowPolicy, execute, plan
from sparkgrain.plans.spec import EntitySpec, MartSpec, Project
from sparkgrain.sources.store import Store


def build_order(p: Project) -> list[str]:
    """Entities, each after those that its referential rules look into; ties by name."""
    needs = {e: {r.params["relationship"].dst for r in R.rules_of(p, s) if r.kind == "referential"} & set(p.entities) for e, s in p.entities.items() if p.mappings_of(e)}
    out: list[str] = []
    while len(out) < len(needs):
        ready = sorted(e for e in needs if e not in out and needs[e] <= {*out, *(p.entities.keys() - needs.keys())})
        if not ready:
            raise CircularDerivation("referential rules go round: " + ", ".join(sorted(set(needs) - set(out))))
        out += ready
    return out


def materialization(spec: EntitySpec | MartSpec) -> str:
    """What is said wins; a partitioned table is replaced by partition, any other whole."""
    return spec.materialization or ("incremental_by_partition" if spec.partition_by else "full")


def stored(store: Store, name: str, s: Silver) -> Silver:
    """A pipeline whose evaluated rows are written once and read for all that follows, without what only the rules read
    and with the payloads of diverted rows alone."""
    rows = s.evaluated.drop(*[c for c in s.evaluated.columns if c.startswith(("_src_", "_verdict_", "_repaired_"))])
    if "_raw" in rows.columns:
        rows = rows.withColumn("_raw", F.when(F.col("_diverted"), F.col("_raw")))
    held = store.full("silver", name, rows)
    kept = held.where("not _diverted").select(*s.kept.columns)
    return Silver(s.entity, s.rules, s.types, held, kept, held.where("_diverted") if s.diverted is not None else None, held)


@dataclass
class Frames:
    """A project over landed tables as lazy frames: nothing is written, and only what is asked for is planned."""

    project: Project
    bronze: dict[str, DataFrame]
    registry: Registry = field(default_factory=Registry)

    def __post_init__(self):
        self._pipelines: dict[str, Silver] = {}
        self._given: dict[str, DataFrame] = {}

    def pipeline(self, entity: str) -> Silver:
        if entity not in self._pipelines:
            parents = {r.params["relationship"].dst: self.silver(r.params["relationship"].dst) for r in R.rules_of(self.project, self.project.entity(entity)) if r.kind == "referential"}
            self._pipelines[entity] = evaluate(self.project, self.registry, entity, self.bronze, parents)
        return self._pipelines[entity]

    def silver(self, entity: str) -> DataFrame:
        if entity in self._given:
            return self._given[entity]
        if not self.project.mappings_of(entity):
            self._steps
            return self._given[entity]
        return self.pipeline(entity).kept

    @cached_property
    def _steps(self) -> None:
        for s in self.project.steps:
            bound = {v.split(".")[-1]: self.silver(v.split(".")[-1]) for v in (s.get("inputs") or {}).values()}
            self._given |= run_step(self.registry, s, bound)

    def mart(self, name: str, need: set[str] | None = None) -> DataFrame:
        m = self.project.marts[name]
        read = {m.base, *(self.project.relationships[s["via"]].dst for s in M.joins_for(self.project, m, need))}
        return M.flatten(self.project, m, {e: self.silver(e) for e in read}, need)

    def reconcile(self, name: str) -> DataFrame:
        spec = next(s for s in self.project.reconcile if s["name"] == name)
        return A.reconcile(self.project, spec, {e: self.silver(e) for e in A.reconciled(self.project, spec)})

    def coverage(self, name: str) -> DataFrame:
        spec = next(s for s in self.project.coverage if s["name"] == name)
        rel = self.project.relationships[spec["relationship"]]
        return A.coverage(self.project, spec, {e: self.silver(e) for e in (rel.src, rel.dst)})

    def plan(self, request: MetricRequest, policy: RowPolicy | None = None) -> QueryPlan:
        return plan(self.project, request, policy)

    def answer(self, request: MetricRequest, policy: RowPolicy | None = None) -> DataFrame:
        p = self.plan(request, policy)
        return execute(p, self.mart(p.mart.name, p.reads))


class Engine:
    """A checked project with a store: runs are written, audited and replayable."""

    def __init__(self, project: Project, store: Store, registry: Registry | None = None):
        self.registry = registry or Registry()
        self.project, self.store = check(project, self.registry), store

    def _write(self, layer: str, spec: EntitySpec | MartSpec, rows: DataFrame, at: datetime) -> DataFrame:
        if isinstance(spec, EntitySpec) and spec.scd == "type2":
            return self.store.history(layer, spec.name, rows, spec.key, at)
        kind = materialization(spec)
        if kind == "incremental_by_key":
            if not isinstance(spec, EntitySpec):
                raise Unsupported(f"mart {spec.name!r} has no key to go by")
            return self.store.by_key(layer, spec.name, rows, spec.key, spec.partition_by)
        if kind == "incremental_by_partition":
            return self.store.by_partition(layer, spec.name, rows, spec.partition_by)
        return self.store.full(layer, spec.name, rows, spec.partition_by)

    def run(self, bronze: dict[str, DataFrame], run_id: str, at: datetime) -> list[str]:
        """Build all; returns the names of audits that found something without blocking.

        An entity's evaluated rows are written once for the run and read for its table, rejects, audits and counts.
        Blocking audits raise before the entity's table or rejects change.
        """
        p, found, runs = self.project, [], []
        frames = Frames(p, bronze, self.registry)
        for name in build_order(p):
            e = p.entities[name]
            s = frames._pipelines[name] = stored(self.store, f"{name}__run", frames.pipeline(name))
            found += A.enforce(self._audits(s, bronze))
            table = self._write("silver", e, s.kept, at)
            frames._given[name] = table.where("valid_to is null") if e.scd == "type2" else table
            source = p.mappings_of(name)[0].source
            if s.diverted is not None:
                rows = J.reject_rows(s, source)
                layer, reject = "silver", f"{name}__reject"
                self.store.full(layer, reject, J.upsert_rejects(self.store.read(layer, reject), rows) if self.store.exists(layer, reject) else rows)
            counted = Counted(s, source, bronze[source], frames._given[name], self.store.read("silver", f"{name}__reject") if s.diverted is not None else None)
            runs += [counted] if s.rules else []
        frames._steps
        for name in {v.split(".")[-1] for w in p.steps for v in (w.get("outputs") or {}).values()}:
            frames._given[name] = self.store.full("silver", name, frames.silver(name))
        for w in p.steps:
            step, named = self.registry.get(w["use"]), {o: v.split(".")[-1] for o, v in (w.get("outputs") or {}).items()}
            found += A.enforce([A.Audit(n, rows) for n, rows in sibling_audits(step, {o: frames.silver(t) for o, t in named.items()})])
            for q in w.get("quality") or ():
                rows = frames.silver((w.get("applies_to") or {}).get(q["name"]) or next(iter(w["outputs"])))
                found += A.enforce([A.Audit(f"{w['use']}_{q['name']}", rows.where(~F.expr(q["expr"])))])
        checks = []
        for spec in p.reconcile:
            rows = self.store.full("silver", f"{spec['name']}__reconcile", frames.reconcile(spec["name"]))
            left = A.reconciled(p, spec)[0]
            checks.append((spec, rows, left, p.mappings_of(left)[0].source))
            found += A.enforce([A.Audit(spec["name"], rows.where("not agrees"), spec["on_fail"] == "fail")])
        for spec in p.coverage:
            found += A.enforce([A.Audit(spec["name"], frames.coverage(spec["name"]), spec["on_fail"] == "fail")])
        for m in p.marts.values():
            rows = self._write("gold", m, frames.mart(m.name), at)
            found += A.enforce([A.Audit(f"{m.name}_{a['name']}", A.mart_assertion(m, a, rows), a["on_fail"] == "fail") for a in m.asserts])
        if runs or checks:
            self.store.full("gold", "data_quality", quality_mart(runs, checks, run_id, at.date() if isinstance(at, datetime) else date.fromisoformat(str(at))))
        return found

    def _audits(self, s: Silver, bronze: dict[str, DataFrame]) -> list[A.Audit]:
        p, e, out = self.project, s.entity, []
        mappings = p.mappings_of(e.name)
        if e.dedupe or e.quarantine:
            out += [A.Audit(f"{e.name}_ingestion", A.ingestion(bronze[m.source])) for m in mappings]
        if e.quarantine and not any(r.kind == "referential" and r.on_fail == "quarantine" for r in s.rules):
            out.append(A.Audit(f"{e.name}_conservation", A.conservation(s)))
        if len(mappings) > 1:
            out.append(A.Audit(f"{e.name}_collisions", A.collisions(s.kept, e.key)))
        stored = None
        if (e.scd == "type2" or materialization(e) != "full") and self.store.exists("silver", e.name):
            # rows of earlier runs that this one doesn't replace count too
            stored = self.store.read("silver", e.name).join(s.evaluated.select(*e.key), list(e.key), "left_anti")
        return out + A.fail_rules(s, stored) + A.asserts(s)

    def replay(self, entity: str, at: datetime) -> None:
        """Judge an entity's unresolved rejects again and let those that pass into its table."""
        p, e = self.project, self.project.entities[entity]
        rejects, m = self.store.read("silver", f"{entity}__reject"), p.mappings_of(entity)[0]
        columns = sorted({x[2:].split(".")[0] for f in m.all for x in R.sources_of(m, f)} | {x[2:].split(".")[0] for x in m.unmapped})
        parents = {r.params["relationship"].dst: self.store.read("silver", r.params["relationship"].dst) for r in R.rules_of(p, e) if r.kind == "referential"}
        s = stored(self.store, f"{entity}__again", evaluate(p, self.registry, entity, {m.source: J.payload_rows(rejects, columns)}, parents))
        after, settled = J.replay(s, self.store.read("silver", entity), rejects, at)
        # both results read both tables: the second is written to its side before the first is replaced
        held = self.store.full("silver", f"{entity}__reject_next", settled)
        self.store.full("silver", entity, after, e.partition_by)
        self.store.full("silver", f"{entity}__reject", held)

    def answer(self, request: MetricRequest, policy: RowPolicy | None = None, default_limit: int | None = None) -> DataFrame:
        got = plan(self.project, request, policy, default_limit)
        return execute(got, self.store.read("gold", got.mart.name))


def sql_view(frames: Frames, names: dict[str, Callable[[], DataFrame]] | None = None) -> None:
    """Register every mart as a temporary view, for SQL users."""
    for m in frames.project.marts:
        frames.mart(m).createOrReplaceTempView(f"mart_{m}")
    for n, f in (names or {}).items():
        f().createOrReplaceTempView(n)
