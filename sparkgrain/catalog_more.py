"""More registered queries: audits, sinks, inputs, steps, plans as SQL, and what is refused."""

from __future__ import annotations

import atexit
import contextlib
import dataclasses
import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrain.catalog import _CTE, _REFUSALS, ORACLES, QUERIES, _ask, _chain, query
from sparkgrain.errors import SpecError
from sparkgrain.functions.transforms import known_transforms
from sparkgrain.functions.types import DATE, INT, STRING, TIMESTAMP, VARIANT, decimal
from sparkgrain.operators import audits as A
from sparkgrain.operators import rejects as J
from sparkgrain.operators.quality_mart import Counted, quality_mart, quarantine_rate
from sparkgrain.operators.silver import evaluate
from sparkgrain.operators.steps import Registry, StepDef, run_step, sibling_audits
from sparkgrain.plans import retail
from sparkgrain.plans.engine import Frames, stored
from sparkgrain.plans.evolve import diff
from sparkgrain.plans.guard import check
from sparkgrain.plans.request import AnyOf, MetricRequest, OrderSpec, Predicate, RowPolicy, execute, parse_filter_json, parse_page_json, parse_sort_json, plan
from sparkgrain.plans.spec import parse_texts
from sparkgrain.sources.landing import landed
from sparkgrain.sources.store import Naming, Store, shared_dir

#: A second project over the same tables, for what the first has no use for.
AUDITED = {
    "catalog": retail.TEXTS["catalog"],
    "entities": """
spec_version: 1
entities:
  supplier: {grain: one row a supplier, key: [code], fields: {code: {type: string}, name: {type: string}}}
  line:
    grain: one row a line of an order
    key: [order_id, line_no]
    fields:
      order_id: {type: int}
      line_no: {type: int}
      part_id: {type: int}
      list_price: {type: "decimal(18,2)", canonical: list_price}
      discount: {type: "decimal(4,2)", canonical: discount}
      quantity: {type: "decimal(12,2)", canonical: quantity}
      net_price: {type: "decimal(18,4)", canonical: net_price}
  visit:
    grain: one row an event
    key: [event_id]
    quarantine: {retention: 30d}
    quality:
      - {rule: referential, via: visit_of_supplier, on_missing: unknown_member}
    fields:
      event_id: {type: int}
      supplier_code: {type: string}
      kind: {type: string, assert: {enum: [view, click, signup, purchase], regex: "^[a-r]+$"}}
      value: {type: "decimal(18,2)", assert: {min: "1.00", max: "200.00"}}
      k_text: {type: string, assert: {not_null: true}}
relationships:
  - {name: visit_of_supplier, from: visit, to: supplier, via: {supplier_code: code}, cardinality: many_to_one}
""",
    "map_supplier": """
mapping_version: 1
source: supplier
target: supplier
key: {code: {from: $.s_suppkey, transform: [to_string]}}
fields: {name: {from: $.s_name}}
""",
    "map_lineitem": """
mapping_version: 1
source: lineitem
target: line
key: {order_id: {from: $.l_orderkey}, line_no: {from: $.l_linenumber}}
fields:
  part_id: {from: $.l_partkey}
  list_price: {from: $.l_extendedprice}
  discount: {from: $.l_discount}
  quantity: {from: $.l_quantity}
  net_price: {recipe: from_discount, from: {list_price: $.l_extendedprice, discount: $.l_discount}, direct: $.l_extendedprice}
""",
    "map_events": """
mapping_version: 1
source: events
target: visit
key: {event_id: {from: $.event_id}}
fields:
  supplier_code: {from: $.user_id, transform: [to_string]}
  kind: {from: $.event_type, quality: [{rule: in_set, values: [view, click, signup, purchase], on_fail: fail}]}
  value: {from: $.value, quality: [{rule: range, min: "0.50", on_fail: fail}]}
  k_text: {from: $.props.k, transform: [{nullif: "7"}]}
unmapped: [$.ts, $._load_id, $._ingested_at, $._source_row_id]
""",
}
_CTE |= {
    "v_all": "SELECT event_id, CASE WHEN CAST(user_id AS VARCHAR) IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) THEN CAST(user_id AS VARCHAR) ELSE '__unknown__' END AS supplier_code, event_type AS kind, CAST(value AS DECIMAL(18,2)) AS value, nullif(json_extract_string(props, '$.k'), '7') AS k_text FROM events",
    "l_dear": "SELECT order_id, amount, order_date, CAST(date_trunc('month', order_date) AS DATE) AS month FROM s_order WHERE order_date >= DATE '1996-01-01' AND order_date < DATE '1997-01-01' AND amount > 100000.00",
    "r_after": "SELECT *, value < 0.50 OR value > 250.00 AS still FROM e_flags WHERE diverted",
}
_checked: list = []


def audited(fr) -> Frames:
    if not _checked:
        _checked.append(check(parse_texts(AUDITED)))
    return Frames(_checked[0], fr.bronze)


def _store(fr, naming: Naming | None = None) -> Store:
    spark = fr.bronze["region"].sparkSession
    return Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", naming)


def _sweep(store: Store) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        fs, at, _ = store._fs(store.base)
        fs.delete(at, True)


def _named(found: list[A.Audit], *columns: str) -> DataFrame:
    out = None
    for a in found:
        part = a.violations.select(F.lit(a.name).alias("audit"), *columns)
        out = part if out is None else out.unionAll(part)
    return out


def values(rows: list[tuple], *columns: str) -> str:
    """An oracle of literal rows."""
    text = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) t({', '.join(columns)})"


# rules and audits -----------------------------------------------------------------------------------------------------

@query("SELECT event_id, supplier_code FROM v_all")
def referential_unknown_member(fr):
    return audited(fr).silver("visit").select("event_id", "supplier_code")


@query("SELECT event_id FROM (SELECT *, CASE WHEN event_id % 983 = 0 THEN event_id - 1 ELSE event_id END AS row_id FROM events) WHERE event_id % 997 = 0 OR event_id % 991 = 0 OR row_id IN (SELECT CASE WHEN event_id % 983 = 0 THEN event_id - 1 ELSE event_id END FROM events GROUP BY 1 HAVING count(*) > 1)")
def ingestion_audit(fr):
    """Planted defects: no load id, an arrival time that is none, a row id that another row has."""
    e = F.col("event_id")
    bad = fr.bronze["events"].withColumns({"_load_id": F.when(e % 997 != 0, F.col("_load_id")), "_ingested_at": F.when(e % 991 == 0, "soon").otherwise(F.col("_ingested_at").cast("string")), "_source_row_id": F.when(e % 983 == 0, (e - 1).cast("string")).otherwise(F.col("_source_row_id"))})
    return A.ingestion(bad).select("event_id")


@query("SELECT count(*) AS surviving, count(*) FILTER (NOT diverted AND event_id % 500 <> 0) AS kept, count(*) FILTER (diverted AND event_id % 500 <> 0) AS diverted FROM e_flags HAVING count(*) <> count(*) FILTER (event_id % 500 <> 0)")
def conservation_audit(fr):
    """Sound rows give no row; with a planted defect (some rows on neither side) the counts come out."""
    s = fr.pipeline("event")
    broken = dataclasses.replace(s, evaluated=s.evaluated.withColumn("_diverted", F.when(F.col("event_id") % 500 != 0, F.col("_diverted"))))
    return A.conservation(s).unionAll(A.conservation(broken))


@query("SELECT 'visit_kind_in_set' AS audit, event_id FROM v_all WHERE kind NOT IN ('view', 'click', 'signup', 'purchase') UNION ALL SELECT 'visit_value_range_min', event_id FROM v_all WHERE value < 0.50 UNION ALL SELECT 'visit_kind_in_set', -event_id FROM v_all WHERE kind NOT IN ('view', 'click', 'signup', 'purchase') AND event_id % 3 = 1 UNION ALL SELECT 'visit_value_range_min', -event_id FROM v_all WHERE value < 0.50 AND event_id % 3 = 1")
def fail_rule_audit(fr):
    """Keys of this run's rows and of stored ones, each once: some stored rows are this run's, others of an earlier one."""
    s = audited(fr).pipeline("visit")
    again = s.kept.where("event_id % 3 = 0")
    stored = again.unionByName(s.kept.where("event_id % 3 = 1").withColumn("event_id", -F.col("event_id"))).unionByName(again)
    return _named(A.fail_rules(s, stored), "event_id")


@query("SELECT 'visit_k_text_not_null' AS audit, event_id FROM v_all WHERE k_text IS NULL UNION ALL SELECT 'visit_kind_enum', event_id FROM v_all WHERE kind NOT IN ('view', 'click', 'signup', 'purchase') UNION ALL SELECT 'visit_kind_regex', event_id FROM v_all WHERE NOT regexp_full_match(kind, '[a-r]+') UNION ALL SELECT 'visit_value_max', event_id FROM v_all WHERE value > 200.00 UNION ALL SELECT 'visit_value_min', event_id FROM v_all WHERE value < 1.00")
def entity_asserts(fr):
    return _named(A.asserts(audited(fr).pipeline("visit")), "event_id")


@query("SELECT 'line_net_price_reconcile' AS audit, order_id, line_no, net_price, CAST(list_price AS DECIMAL(18,4)) AS direct FROM l_all WHERE net_price <> list_price")
def path_conflict_audit(fr):
    return _named(A.asserts(audited(fr).pipeline("line")), "order_id", "line_no", "net_price", F.col("net_price__direct").alias("direct"))


@query("SELECT CAST(date_trunc('year', order_date) AS DATE) AS placed, order_id, amount, status FROM s_order WHERE status <> 'filled' AND amount < 20000.00")
def expression_flags_kept(fr):
    """An entity rule whose rows stay, told by their flag."""
    texts = {**retail.TEXTS, "entities": retail.TEXTS["entities"].replace("    grain: one row an order\n    key: [order_id]\n", "    grain: one row an order\n    key: [order_id]\n    quarantine: {retention: 30d}\n    quality: [{rule: expression, name: open_and_small, expr: \"not (status <> 'filled' and amount < 20000.00)\", on_fail: flag}]\n"), "map_orders": retail.TEXTS["map_orders"] + "unmapped: [$._load_id, $._ingested_at, $._source_row_id]\n"}
    got = Frames(check(parse_texts(texts), retail.STEPS), fr.bronze, retail.STEPS).silver("order")
    return got.where(F.array_contains("_quality_flags", "open_and_small")).select(F.date_trunc("year", "order_date").cast("date").alias("placed"), "order_id", "amount", "status")


# rejects and the quality mart -----------------------------------------------------------------------------------------

@query("SELECT sha256('S6:events' || 'S' || length(CAST(event_id AS VARCHAR)) || ':' || CAST(event_id AS VARCHAR)) AS reject_id, 'events' AS source_relation, 'events->event' AS mapping, CAST(1 AS INTEGER) AS mapping_version, '{\"event_id\":\"' || CAST(event_id AS VARCHAR) || '\"}' AS key_values, raw_kind AS raw_kind, 'load-1' AS _load_id, seen_at AS _ingested_at, CAST(event_id AS VARCHAR) AS _source_row_id, seen_at AS first_seen, seen_at AS last_seen, CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS TIMESTAMP) AS last_evaluated_at FROM e_flags WHERE diverted")
def reject_columns(fr):
    return J.reject_rows(fr.pipeline("event"), "events").withColumn("raw_kind", F.get_json_object("raw", "$.event_type")).drop("raw", "failed_rules")


def relaxed(fr):
    """The event table, its rejects and the pipeline over them once in_set is a flag, replayed; both pipelines' rows are
    written once, as runs of the engine do, and go when the process ends."""
    texts = {**retail.TEXTS, "map_events": retail.TEXTS["map_events"].replace("signup], on_fail: quarantine", "signup], on_fail: flag")}
    p = check(parse_texts(texts), retail.STEPS)
    store = _store(fr)
    atexit.register(_sweep, store)
    first = stored(store, "event__run", fr.pipeline("event"))
    rejects = J.reject_rows(first, "events")
    s = evaluate(p, fr.registry, "event", {"events": J.payload_rows(rejects, ["event_id", "user_id", "event_type", "value", "props", "ts"])}, {"supplier": fr.silver("supplier")})
    return (*J.replay(stored(store, "event__again", s), first.kept, rejects, datetime(2024, 2, 1)), p)


@query("SELECT sha256('S6:events' || 'S' || length(CAST(event_id AS VARCHAR)) || ':' || CAST(event_id AS VARCHAR)) AS reject_id, CASE WHEN NOT coalesce(still, false) THEN TIMESTAMP '2024-02-01' END AS resolved_at, TIMESTAMP '2024-02-01' AS last_evaluated_at FROM r_after")
def replay_rejects(fr):
    return relaxed(fr)[1].select("reject_id", "resolved_at", "last_evaluated_at")


@query("SELECT '(entity)' AS rule, count(*) AS rows_evaluated, CAST(0 AS BIGINT) AS rows_failed, (SELECT count(*) FROM r_after WHERE coalesce(still, false)) AS rows_quarantined FROM e_flags UNION ALL SELECT 'raw_kind_in_set', 0, count(*) FILTER (r_in_set), 0 FROM e_flags UNION ALL SELECT 'value_range', 0, count(*) FILTER (r_range), 0 FROM e_flags UNION ALL SELECT 'kind_in_enum', 0, count(*) FILTER (r_in_enum), 0 FROM e_flags")
def quality_mart_after_replay(fr):
    """A replayed row counts once, in the entity; the population is the tables', not the last run's."""
    after, settled, p = relaxed(fr)
    s = Frames(p, fr.bronze, fr.registry).pipeline("event")
    got = quality_mart([Counted(s, "events", fr.bronze["events"], after, settled)], [], "run-2", date(2024, 2, 1))
    return got.where(F.col("rule").isin("(entity)", "raw_kind_in_set", "value_range", "kind_in_enum")).select("rule", "rows_evaluated", "rows_failed", "rows_quarantined")


@query("SELECT 'order' AS entity, 'orders->order' AS mapping, 'order_totals' AS rule, 'flag' AS disposition, count(*) FILTER (NOT agrees) AS rows_failed, CAST(0 AS BIGINT) AS rows_evaluated FROM (SELECT coalesce(abs(a - b) <= 1000.00, false) AS agrees FROM (SELECT order_id, sum(amount) AS a FROM s_order GROUP BY 1) FULL JOIN (SELECT order_id, sum(list_price) AS b FROM s_line GROUP BY 1) USING (order_id)) UNION ALL SELECT 'line', 'lineitem->line', '(entity)', '(none)', 0, count(*) FROM s_line")
def quality_mart_reconcile(fr):
    spec = fr.project.reconcile[0]
    got = quality_mart([Counted(fr.pipeline("line"), "lineitem", fr.bronze["lineitem"])], [(spec, fr.reconcile(spec["name"]), "order", "orders")], "run-1", date(2024, 2, 1))
    return got.where("rule in ('order_totals', '(entity)')").select("entity", "mapping", "rule", "disposition", "rows_failed", "rows_evaluated")


@query("SELECT 'event' AS entity, CAST(round(count(*) FILTER (diverted) / count(*), 9) AS DECIMAL(38,9)) AS quality_quarantine_rate, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM s_line) AS lines_deduped FROM e_flags")
def quality_rate(fr):
    runs = [Counted(fr.pipeline("event"), "events", fr.bronze["events"]), Counted(fr.pipeline("line"), "lineitem", fr.bronze["lineitem"])]
    mart = quality_mart(runs, [], "run-1", date(2024, 2, 1))
    gone = mart.where("entity = 'line'").agg(F.sum("rows_deduped").alias("lines_deduped"))
    return quarantine_rate(mart).where("entity = 'event'").crossJoin(gone)


# sinks and inputs ---------------------------------------------------------------------------------------------------

_BY_MONTH = (("months", "order_date"),)


@query("SELECT order_id, order_date, amount FROM s_order")
def sink_full(fr):
    return _store(fr).full("silver", "orders", fr.silver("order").select("order_id", "order_date", "amount"), _BY_MONTH)


@query("SELECT order_id, CASE WHEN order_id % 4 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE amount END AS amount FROM s_order UNION ALL SELECT -order_id - 1, amount FROM s_order WHERE order_id % 5 = 0")
def sink_by_key(fr):
    store, rows = _store(fr), fr.silver("order").select("order_id", "amount")
    store.by_key("silver", "orders", rows, ("order_id",))
    more = rows.where("order_id % 4 = 0").withColumn("amount", F.lit(0).cast("decimal(18,2)")).unionAll(rows.where("order_id % 5 = 0").withColumn("order_id", -F.col("order_id") - 1))
    return store.by_key("silver", "orders", more, ("order_id",))


@query("SELECT order_id, order_date, amount FROM s_order WHERE CAST(date_trunc('month', order_date) AS DATE) NOT IN (SELECT month FROM l_dear) UNION ALL SELECT order_id, order_date, amount FROM l_dear")
def sink_by_partition(fr):
    store, rows = _store(fr), fr.silver("order").select("order_id", "order_date", "amount")
    store.by_partition("silver", "orders", rows, _BY_MONTH)
    return store.by_partition("silver", "orders", rows.where("order_date >= '1996-01-01' and order_date < '1997-01-01' and amount > 100000"), _BY_MONTH)


@query("SELECT c_custkey AS customer_id, c_mktsegment AS segment, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-02-01' END AS valid_to FROM customer UNION ALL SELECT c_custkey, 'moved', TIMESTAMP '2024-02-01', NULL FROM customer WHERE c_custkey % 3 = 0")
def sink_history(fr):
    store, rows = _store(fr), fr.bronze["customer"].select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    store.history("silver", "customers", rows, ("customer_id",), datetime(2024, 1, 1))
    return store.history("silver", "customers", rows.withColumn("segment", F.when(F.col("customer_id") % 3 == 0, "moved").otherwise(F.col("segment"))), ("customer_id",), datetime(2024, 2, 1))


@query("SELECT DISTINCT 'hours' AS transform, strftime(ts, '%Y-%m-%d-%H') AS part FROM events UNION ALL SELECT DISTINCT 'days', strftime(ts, '%Y-%m-%d') FROM events UNION ALL SELECT DISTINCT 'months', strftime(date_trunc('month', ts), '%Y-%m-%d') FROM events UNION ALL SELECT DISTINCT 'years', strftime(date_trunc('year', ts), '%Y-%m-%d') FROM events")
def sink_partition_transforms(fr):
    """The directories that each transform makes."""
    store, out = _store(fr), None
    for fn in ("hours", "days", "months", "years"):
        store.full("silver", fn, fr.bronze["events"].select("event_id", "ts"), ((fn, "ts"),))
        table = store.path("silver", fn)
        (snapshot,) = store._held(table, store._version(table))
        part = store.spark.read.parquet(f"{table}/{snapshot}").select(F.lit(fn).alias("transform"), F.col(f"_{fn}_ts").cast("string").alias("part")).distinct()
        out = part if out is None else out.unionAll(part)
    return out


@query(values([("bronze", "orders", "dev_bronze", "orders"), ("silver", "orders", "dev_silver", "orders"), ("gold", "orders", "dev_gold", "mart_orders")], "layer", "name", "namespace", "relation"))
def naming_policy(fr):
    rows = [(layer, "orders", *Naming("dev_").relation(layer, "orders")) for layer in ("bronze", "silver", "gold")]
    return fr.bronze["region"].sparkSession.createDataFrame(rows, "layer string, name string, namespace string, relation string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name, r_name, CAST(r_regionkey AS BIGINT) AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def seed_csv_json(fr):
    store = _store(fr)
    fr.bronze["nation"].write.option("header", True).csv(f"{store.base}/nation")
    fr.bronze["region"].write.json(f"{store.base}/region")
    n, r = landed(store.spark, f"{store.base}/nation", "csv"), landed(store.spark, f"{store.base}/region", "json")
    return n.join(r, F.col("n_regionkey").cast("bigint") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), "n_name", "r_name", F.col("r_regionkey").alias("region"))


# transforms ---------------------------------------------------------------------------------------------------------

@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(CAST(value AS DECIMAL(18,2)) * 0.25 AS DECIMAL(19,2)) AS quarter, CAST(ts AS DATE) AS day, CAST(date_trunc('second', ts) AS TIMESTAMP) + INTERVAL 182 DAY + INTERVAL 4 HOUR AS summer_utc, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS whole, CAST(event_id % 2 = 0 AS VARCHAR) AS even FROM events")
def transforms_more(fr):
    rows = fr.bronze["events"].withColumns({"dotted": F.date_format("ts", "dd.MM.yyyy"), "summer": F.date_format(F.col("ts") + F.expr("INTERVAL 182 DAY"), "yyyy-MM-dd HH:mm:ss"), "even": (F.col("event_id") % 2 == 0).cast("string"), "k": F.get_json_object("props", "$.k")})
    return rows.select(
        "event_id", _chain("props", [{"json_path": "$.k"}], VARIANT).alias("k"), _chain("value", [{"to_decimal": [18, 2]}, {"divide": 4}], decimal(19, 2)).alias("quarter"), _chain("dotted", [{"parse_date": "%d.%m.%Y"}], DATE).alias("day"),
        _chain("summer", [{"parse_ts": "%Y-%m-%d %H:%M:%S"}, {"to_utc": "America/New_York"}], TIMESTAMP).alias("summer_utc"), _chain("k", ["to_int", "to_string"], STRING).alias("whole"), _chain("even", ["to_bool", "to_string"], STRING).alias("even"),
    )


@query("SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, CAST(l_quantity AS BIGINT) AS units, CAST(l_shipdate AS DATE) AS shipped FROM lineitem")
def strict_casts(fr):
    """Casts outside the quality system: each value is read or the job fails; here all are read."""
    d = fr.bronze["lineitem"].withColumns({"q": F.col("l_quantity").cast("bigint").cast("string"), "s": F.date_format("l_shipdate", "yyyy-MM-dd")})
    return d.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line_no"), _chain("q", ["to_int"], INT).alias("units"), _chain("s", [{"parse_date": "ISO8601"}], DATE).alias("shipped"))


@query(values([(n,) for n in sorted("abs coalesce concat convert divide enum_map json_path lower multiply nullif parse_date parse_ts regex_extract round split_part strip_prefix strip_suffix to_bool to_decimal to_int to_string to_utc trim upper".split())], "transform"))
def transform_whitelist(fr):
    return fr.bronze["region"].sparkSession.createDataFrame([(n,) for n in known_transforms()], "transform string")


# requests -----------------------------------------------------------------------------------------------------------

@query("SELECT customer_segment, CAST(round(avg(amount), 6) AS DECIMAL(38,9)) AS mean_order FROM m_orders GROUP BY 1")
def metric_avg(fr):
    return _ask(fr, ["mean_order"], ["customer_segment"])


@query("SELECT kind, count(event_id) AS events FROM s_event WHERE k_text IS NULL AND kind NOT IN ('buy', 'see') GROUP BY 1")
def filter_null_and_not_in(fr):
    return _ask(fr, ["events"], ["kind"], filters=(Predicate("k_text", "is_null", (True,)), Predicate("kind", "not_in", ("buy", "see"))))


@query("SELECT k_text, count(event_id) AS events FROM s_event GROUP BY 1 ORDER BY k_text NULLS FIRST LIMIT 7")
def sort_nulls_first(fr):
    return _ask(fr, ["events"], ["k_text"], order_by=(OrderSpec("k_text"),), limit=7)


@query("SELECT k_text, count(event_id) AS events FROM s_event GROUP BY 1 ORDER BY k_text DESC NULLS LAST LIMIT 3")
def limit_is_clamped(fr):
    p = plan(fr.project, MetricRequest(("events",), ("k_text",), order_by=(OrderSpec("k_text", "desc"),), limit=500), max_limit=3)
    return execute(p, fr.mart("events", p.reads))


@query(values([("largest_order", "orders"), ("net_revenue", "lines"), ("order_count", "tallies"), ("revenue", "tallies")], "measure", "mart"))
def measure_ownership(fr):
    """The mart of least cost answers: a second, cheaper one takes over the measures that both hold."""
    marts = retail.TEXTS["marts"] + "  tallies: {grain: order, base: order, flatten: [{date: order_date, role: ordered}], measures: [revenue, order_count], cost_hint: 0}\n"
    p = check(parse_texts({**retail.TEXTS, "marts": marts}), retail.STEPS)
    rows = [(m, plan(p, MetricRequest((m,))).mart.name) for m in ("revenue", "order_count", "largest_order", "net_revenue")]
    return fr.bronze["region"].sparkSession.createDataFrame(rows, "measure string, mart string")


def _as_sql(fr, request: MetricRequest, policy: RowPolicy | None = None) -> DataFrame:
    """A request's SQL text, run over its mart."""
    p = plan(fr.project, request, policy)
    mart = fr.mart(p.mart.name, p.reads)
    return mart.sparkSession.sql(p.sql("{mart}"), mart=mart)


@query("SELECT ordered_quarter, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue, CAST(CAST(sum(amount) AS DECIMAL(38,9)) / nullif(count(order_id), 0) AS DECIMAL(38,2)) AS aov, count(*) FILTER (status = 'open') AS open_orders FROM m_orders WHERE region_name IN ('asia', 'europe') AND (customer_segment = 'auto' OR customer_name LIKE '%1') AND priority NOT IN ('5') AND order_date >= DATE '1996-02-01' GROUP BY 1")
def plan_as_sql(fr):
    clauses = (AnyOf((Predicate("customer_segment", "eq", ("auto",)), Predicate("customer_name", "like", ("%1",)))), Predicate("priority", "not_in", ("5",)), Predicate("ordered_day", "gte", ("1996-02-01",)))
    got = _as_sql(fr, MetricRequest(("revenue", "average_order_value", "open_orders"), ("ordered_quarter",), clauses), RowPolicy("region_name", ("asia", "europe")))
    return got.withColumn("average_order_value", F.col("average_order_value").cast("decimal(38,2)")).withColumnRenamed("average_order_value", "aov")


@query("SELECT CAST(date_trunc('month', event_date) AS DATE) AS happened_month, kind, CAST(sum(value) AS DECIMAL(18,2)) AS level FROM (SELECT *, max(event_date) OVER (PARTITION BY date_trunc('month', event_date)) AS last_day FROM s_event WHERE value >= 3.00) WHERE event_date = last_day GROUP BY 1, 2")
def plan_as_sql_semi_additive(fr):
    return _as_sql(fr, MetricRequest(("level",), ("happened_month", "kind"), (Predicate("value", "gte", ("3.00",)),)))


# steps --------------------------------------------------------------------------------------------------------------

def _firsts(tables: dict[str, DataFrame], least: str = "0") -> dict[str, DataFrame]:
    o = tables["orders"].where(F.col("amount") > F.lit(least).cast("decimal(18,2)"))
    return {"firsts": o.groupBy("customer_id").agg(F.min_by("order_id", F.struct("order_date", "order_id")).alias("order_id"), F.min("order_date").alias("since"))}


_FIRSTS = StepDef("firsts", 1, "python_model", run=_firsts, inputs=("orders",), outputs={"firsts": {"columns": {"customer_id": "int", "order_id": "int", "since": "date"}, "key": ["customer_id"], "required": ["since"]}}, parameters={"least": {"type": "decimal(18,2)", "default": "0"}})


@query("SELECT customer_id, arg_min(order_id, (order_date, order_id)) AS order_id, min(order_date) AS since FROM s_order WHERE amount > 1000.00 GROUP BY 1")
def step_python_model(fr):
    wire = {"use": "firsts@1", "inputs": {"orders": "silver.order"}, "outputs": {"firsts": "silver.firsts"}, "parameters": {"least": "1000.00"}}
    return run_step(Registry((_FIRSTS,)), wire, {"order": fr.silver("order")})["firsts"]


@query("SELECT c.segment, count(*) AS customers, min(f.since) AS since FROM (SELECT customer_id, min(order_date) AS since FROM s_order GROUP BY 1) f JOIN s_customer c USING (customer_id) GROUP BY 1")
def step_output_is_an_entity(fr):
    """A wired step's output is a silver table like any other."""
    registry = Registry((retail.STEPS.get("days_after@1"), _FIRSTS))
    steps = "steps_version: 1\nsteps:\n  - {use: firsts@1, inputs: {orders: silver.order}, outputs: {firsts: silver.firsts}}\n"
    frames = Frames(check(parse_texts({**retail.TEXTS, "steps": steps}), registry), fr.bronze, registry)
    return frames.silver("firsts").join(frames.silver("customer"), "customer_id").groupBy("segment").agg(F.count("*").alias("customers"), F.min("since").alias("since"))


@query("SELECT 'step_visits_account_in_accounts' AS audit, c_custkey AS account FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 <> 0")
def step_sibling_audits(fr):
    """Two outputs of one step that disagree: visits of accounts that the other output doesn't hold."""
    def run(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        c = tables["customers"].select(F.col("customer_id").alias("account"))
        return {"accounts": c.where("account % 3 = 0"), "visits": c.where("account % 5 = 0").unionAll(c.limit(1).select(F.lit(None).cast("bigint").alias("account")))}

    step = StepDef("split", 1, "python_model", run=run, inputs=("customers",), outputs={"accounts": {"columns": {"account": "int"}, "key": ["account"]}, "visits": {"columns": {"account": "int"}, "references": {"account": "accounts"}}})
    got = run_step(Registry((step,)), {"use": "split@1", "inputs": {"customers": "silver.customer"}, "outputs": {"accounts": "silver.accounts", "visits": "silver.visits"}}, {"customer": fr.silver("customer")})
    return _named([A.Audit(n, rows) for n, rows in sibling_audits(step, got)], "account")


# what is refused, and what a change of the specs means ---------------------------------------------------------------

def _error(f: Callable[[], object]) -> str:
    """What a call is refused with: the class, or those of its causes."""
    try:
        f()
        return "accepted"
    except SpecError as e:
        return ",".join(sorted({type(x).__name__ for x in e.causes or (e,)}))


def _changed(doc: str, was: str, now: str):
    assert was in retail.TEXTS[doc], (doc, was)
    return parse_texts({**retail.TEXTS, doc: retail.TEXTS[doc].replace(was, now)})


#: Broken projects: a document, what is replaced in it and by what.
_SPECS = {
    "batch": ("marts", "measures: [level, opening_level, events]", "measures: [revenue, level, buyers]"),
    "currencies": ("catalog", "discount: {entity: line, type: \"decimal(4,2)\", unit: ratio}", "discount: {entity: line, type: \"decimal(4,2)\", unit: ratio, currency: EUR}"),
    "history_in_a_mart": ("entities", "  customer:\n    grain", "  customer:\n    scd: type2\n    grain"),
    "no_time_dimension": ("marts", "      - {date: ship_date, role: shipped}\n", ""),
    "assert_typing": ("entities", "amount: {type: \"decimal(18,2)\"}", "amount: {type: \"decimal(18,2)\", assert: {regex: \"^a$\"}}"),
    "redaction": ("entities", "quarantine: {retention: 90d}", "quarantine: {retention: 90d, redact: [$.value]}"),
    "ingestion": ("map_events", "unmapped: [$._load_id, $._ingested_at, $._source_row_id]", ""),
    "one_to_many": ("entities", "from: nation, to: region, via: {region_id: region_id}, cardinality: many_to_one", "from: nation, to: region, via: {region_id: region_id}, cardinality: one_to_many"),
    "grain_of_expression": ("metrics", "expr: quantity}", "expr: amount}"),
    "semi_additive_without_over": ("metrics", "semi_additive: {over: event_date, rule: last}", "semi_additive: {rule: last}"),
    "unknown_template": ("metrics", "net_revenue: {template: net_revenue}", "net_revenue: {template: nothing}"),
    "unknown_step": ("map_orders", "days_after@1", "days_past@1"),
    "unknown_column_in_rule": ("entities", "expr: \"kind <> 'buy' or value >= 1.00\"", "expr: \"price > 1\""),
    "rule_of_no_truth": ("entities", "expr: \"kind <> 'buy' or value >= 1.00\"", "expr: \"value + 1\""),
    "currency_conversion": ("map_orders", "amount: {from: $.o_totalprice}", "amount: {from: $.o_totalprice, transform: [{to_decimal: [18, 2]}, {convert: EUR}]}"),
    "merge_with_rules": ("map_party_customer", "balance: {from: $.c_acctbal}", "balance: {from: $.c_acctbal, quality: [{rule: not_null, on_fail: flag}]}"),
    "unresolved_recipe": ("map_lineitem", "recipe: from_discount", "recipe: from_nothing"),
}


def _expected() -> list[tuple[str, str]]:
    return [
        ("additivity", "AdditivityViolation"), ("assert_typing", "AssertTyping"), ("batch", "AdditivityViolation,GrainViolation"), ("chain_type", "ChainTypeError"), ("currency_conversion", "Unsupported"),
        ("currencies", "CurrencyMismatch"), ("currency_unit", "TaxBasisMismatch,UnitMismatch"), ("duplicate_column", "GuardrailError"), ("fan_out", "FanoutRisk"), ("grain", "GrainViolation"), ("grain_of_expression", "GrainMismatch"), ("history_in_a_mart", "HistoricalFanout"),
        ("ingestion", "IngestionMetadataMissing"), ("merge_with_rules", "ResolutionError"), ("missing_reference", "MissingReference"), ("no_time_dimension", "MissingTimeDimension"), ("one_to_many", "FanoutRisk"),
        ("redaction", "RedactionConflict"), ("retention", "RetentionMissing"), ("rule_of_no_truth", "GuardrailError"), ("semi_additive_without_over", "AdditivityViolation"), ("tie_break", "TieBreakMissing"),
        ("unknown_column_in_rule", "MissingReference"), ("unknown_step", "UnknownStep"), ("unknown_template", "MissingReference"), ("unknown_transform", "UnknownTransform"), ("unresolved_recipe", "MissingReference"),
    ]


def coverage_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One broken project for each refusal, and what it is refused with."""
    cases = {**_REFUSALS, **_SPECS}
    return spark.createDataFrame([(n, _error(lambda x=x: check(_changed(*x), retail.STEPS))) for n, x in sorted(cases.items())], "refusal string, error string")


QUERIES["coverage_refusals"] = coverage_refusals
ORACLES["coverage_refusals"] = values(_expected(), "refusal", "error")

_ask_for = lambda *m, **kw: lambda: plan(retail.project(), MetricRequest(m, **kw))
_wide = {"$or": [{"$and": [{f"x{i}": 1}, {f"y{i}": 1}]} for i in range(8)]}
_REQUESTS: dict[str, tuple[Callable[[], object], str]] = {
    "a_metric_in_no_mart": (_ask_for("buyers"), "UnreachableAtGrain"),
    "across_grains": (_ask_for("revenue", "units"), "UnreachableAtGrain"),
    "a_misspelt_metric": (_ask_for("revenu"), "UnknownMember"),
    "a_misspelt_dimension": (_ask_for("revenue", dimensions=("colour",)), "UnknownMember"),
    "a_bucket_of_two_roles": (_ask_for("revenue", dimensions=("month",)), "AmbiguousDimension"),
    "a_finer_grain": (_ask_for("revenue", dimensions=("ordered_day",), time_grain="hour"), "InvalidRequest"),
    "a_text_for_a_number": (_ask_for("revenue", filters=(Predicate("amount", "eq", ("x",)),)), "FilterType"),
    "a_pattern_for_a_number": (_ask_for("revenue", filters=(Predicate("amount", "like", ("x",)),)), "FilterType"),
    "no_such_day": (_ask_for("revenue", filters=(Predicate("ordered_day", "eq", ("2024-13-01",)),)), "FilterType"),
    "an_offset": (lambda: parse_page_json({"offset": 2}), "UnsupportedPagination"),
    "a_cursor": (lambda: parse_page_json({"after": "x"}), "UnsupportedPagination"),
    "nulls_elsewhere": (lambda: parse_sort_json({"a": {"dir": "asc", "nulls": "last"}}), "UnsupportedSort"),
    "a_regular_expression": (lambda: parse_filter_json({"a": {"$regex": "x"}}), "UnsupportedFilter"),
    "a_negated_pattern": (lambda: parse_filter_json({"$not": {"a": {"$like": "x"}}}), "UnsupportedNegation"),
    "an_unknown_operator": (lambda: parse_filter_json({"a": {"$what": 1}}), "InvalidRequest"),
    "too_many_clauses": (lambda: parse_filter_json(_wide), "FilterTooComplex"),
    "an_open_escape": (lambda: parse_filter_json({"a": {"$like": "x\\"}}), "InvalidRequest"),
    "semi_additive_mean": (lambda: plan(check(_changed("metrics", "semi_additive: {over: event_date, rule: last}", "semi_additive: {over: event_date, rule: avg}"), retail.STEPS), MetricRequest(("level",))), "InvalidRequest"),
    "cumulative_is_read_and_left": (lambda: plan(check(_changed("metrics", "listed: {grain: line,", "listed: {cumulative: {window: 7d}, grain: line,"), retail.STEPS), MetricRequest(("listed",))), "accepted"),
    "a_step_of_chance": (lambda: Registry((StepDef("s", 1, "python_model", determinism="nondeterministic"),)), "StepDeterminism"),
    "a_step_not_there": (lambda: retail.STEPS.get("days_after@2"), "UnknownStep"),
}


@query(values([(n, e) for n, (_, e) in sorted(_REQUESTS.items())], "request", "error"))
def request_refusals(fr):
    return fr.bronze["region"].sparkSession.createDataFrame([(n, _error(f)) for n, (f, _) in sorted(_REQUESTS.items())], "request string, error string")


@query(values([("a_column_more", "StepContract"), ("a_null_key", "StepContract"), ("another_type", "StepContract"), ("as_declared", "accepted"), ("rows_twice", "StepContract")], "output", "error"))
def step_contract(fr):
    """What a step's output is held to."""
    rows = fr.silver("region").select("region_id", "name")
    outputs = {"as_declared": rows, "a_column_more": rows.withColumn("x", F.lit(1)), "another_type": rows.withColumn("region_id", F.col("region_id").cast("string")), "rows_twice": rows.unionAll(rows), "a_null_key": rows.withColumn("region_id", F.nullif("region_id", F.lit(1)))}
    declared = {"o": {"columns": {"region_id": "int", "name": "string"}, "key": ["region_id"]}}
    wire = {"use": "s@1", "inputs": {}, "outputs": {"o": "silver.o"}}
    found = [(n, _error(lambda df=df: run_step(Registry((StepDef("s", 1, "python_model", run=lambda _: {"o": df}, outputs=declared),)), wire, {}))) for n, df in sorted(outputs.items())]
    return rows.sparkSession.createDataFrame(found, "output string, error string")


#: Changes of the specs: a document, what is replaced and by what; the kinds of change, and what they restate and replay.
_CHANGES = {
    "decimal_widened": ("entities", 'amount: {type: "decimal(18,2)"}', 'amount: {type: "decimal(20,2)"}', "widening", "", ""),
    "range_widened": ("map_events", 'max: "250.00"', 'max: "300.00"', "restating", "event", "event"),
    "range_narrowed": ("map_events", 'max: "250.00"', 'max: "200.00"', "restating", "event", ""),
    "rule_relaxed": ("map_events", "signup], on_fail: quarantine", "signup], on_fail: flag", "restating", "event", "event"),
    "retention": ("entities", "retention: 90d", "retention: 30d", "additive", "", ""),
    "grain_text": ("entities", "grain: one row a part", "grain: one row a thing", "breaking", "part", ""),
    "transform": ("map_part", "transform: [upper]", "transform: [lower]", "restating", "part", ""),
    "metric_expression": ("metrics", 'expr: "list_price * quantity"', 'expr: "quantity * list_price"', "restating", "", ""),
    "measure_dropped": ("marts", "measures: [revenue,", "measures: [", "ContractViolation", "", ""),
    "decimal_narrowed": ("entities", 'amount: {type: "decimal(18,2)"}', 'amount: {type: "decimal(10,2)"}', "ContractViolation", "", ""),
    "nothing": ("entities", "grain: one row a part", "grain: one row a part", "", "", ""),
}


@query(values([(n, *x[3:]) for n, x in sorted(_CHANGES.items())], "change", "kinds", "backfill", "replay"))
def spec_diff(fr):
    rows = []
    for n, (doc, was, now, *_) in sorted(_CHANGES.items()):
        try:
            got = diff(fr.project, _changed(doc, was, now))
            rows.append((n, ",".join(sorted({c.kind for c in got.changes})), ",".join(got.backfill), ",".join(got.replay)))
        except SpecError as e:
            rows.append((n, type(e).__name__, "", ""))
    return fr.bronze["region"].sparkSession.createDataFrame(rows, "change string, kinds string, backfill string, replay string")
