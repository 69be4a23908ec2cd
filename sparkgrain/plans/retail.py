"""A worked project over the retail tables: what the registered queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrain.operators.steps import Registry, StepDef
from sparkgrain.plans.engine import Frames
from sparkgrain.plans.guard import check
from sparkgrain.plans.spec import Project, parse_texts
from sparkgrain.sources.landing import acknowledged

TEXTS = {
    "catalog": """
catalog_version: 1
vertical: retail
canonical_fields:
  list_price: {entity: line, type: "decimal(18,2)", unit: currency, tax_basis: net, currency: USD}
  discount: {entity: line, type: "decimal(4,2)", unit: ratio}
  quantity: {entity: line, type: "decimal(12,2)", unit: count}
  net_price:
    entity: line
    type: decimal(18,4)
    unit: currency
    tax_basis: net
    currency: USD
    recipes:
      - {id: direct, requires: [net_price]}
      - {id: from_discount, requires: [list_price, discount], expr: "list_price * (1 - discount)"}
date_dimension: {name: dim_date, grain: day, start_year: 1995, end_year: 2002}
metric_templates:
  net_revenue: {requires: [net_price], grain: line, additivity: additive, agg: sum, expr: net_price}
""",
    "entities": """
spec_version: 1
entities:
  region: {grain: one row a region, key: [region_id], fields: {region_id: {type: int}, name: {type: string}}}
  nation: {grain: one row a nation, key: [nation_id], fields: {nation_id: {type: int}, name: {type: string}, region_id: {type: int}}}
  customer:
    grain: one row a customer
    key: [customer_id]
    fields:
      customer_id: {type: int}
      name: {type: string}
      number: {type: string}
      segment: {type: string}
      balance: {type: "decimal(12,2)"}
      nation_id: {type: int}
  part: {grain: one row a part, key: [part_id], fields: {part_id: {type: int}, name: {type: string}, brand: {type: string}, kind: {type: string}}}
  supplier: {grain: one row a supplier, key: [supplier_id], fields: {supplier_id: {type: int}, name: {type: string}, nation_id: {type: int}}}
  order:
    grain: one row an order
    key: [order_id]
    fields:
      order_id: {type: int}
      customer_id: {type: int}
      status: {type: string}
      priority: {type: string}
      amount: {type: "decimal(18,2)"}
      order_date: {type: date}
      due_date: {type: date}
  line:
    grain: one row a line of an order
    key: [order_id, line_no]
    quarantine: {retention: 30d}
    dedupe: {keep: latest_by, field: ship_date, tie_break: [part_id, supplier_id, quantity, list_price, discount, return_flag, status]}
    fields:
      order_id: {type: int}
      line_no: {type: int}
      part_id: {type: int}
      supplier_id: {type: int}
      quantity: {type: "decimal(12,2)", canonical: quantity}
      list_price: {type: "decimal(18,2)", canonical: list_price}
      discount: {type: "decimal(4,2)", canonical: discount}
      net_price: {type: "decimal(18,4)", canonical: net_price}
      return_flag: {type: string}
      status: {type: string}
      ship_date: {type: date}
  event:
    grain: one row an event
    key: [event_id]
    quarantine: {retention: 90d}
    quality:
      - {rule: expression, name: cheap_purchase, expr: "kind <> 'buy' or value >= 1.00", on_fail: flag}
      - {rule: referential, via: event_by_supplier, on_missing: flag}
    fields:
      event_id: {type: int}
      user_id: {type: int}
      kind: {type: string}
      raw_kind: {type: string}
      value: {type: "decimal(18,2)"}
      k: {type: int}
      k_text: {type: string}
      half: {type: int}
      event_date: {type: date}
      seen_at: {type: timestamp}
  party:
    grain: one row a customer or supplier account
    key: [party, party_id]
    fields: {party: {type: string}, party_id: {type: int}, balance: {type: "decimal(12,2)"}, segment: {type: string}}
  page:
    grain: one row a document
    key: [doc_id]
    quarantine: {retention: 12h}
    fields: {doc_id: {type: int}, body: {type: string}, lang: {type: string}, source: {type: string}}
relationships:
  - {name: nation_in_region, from: nation, to: region, via: {region_id: region_id}, cardinality: many_to_one}
  - {name: customer_in_nation, from: customer, to: nation, via: {nation_id: nation_id}, cardinality: many_to_one}
  - {name: order_of_customer, from: order, to: customer, via: {customer_id: customer_id}, cardinality: many_to_one}
  - {name: line_of_order, from: line, to: order, via: {order_id: order_id}, cardinality: many_to_one}
  - {name: line_of_part, from: line, to: part, via: {part_id: part_id}, cardinality: many_to_one}
  - {name: line_of_supplier, from: line, to: supplier, via: {supplier_id: supplier_id}, cardinality: many_to_one}
  - {name: event_by_supplier, from: event, to: supplier, via: {user_id: supplier_id}, cardinality: many_to_one}
reconcile:
  - {name: order_totals, left: sum(order.amount) by order_id, right: sum(line.list_price) by order_id, tolerance: "1000.00", on_fail: flag}
coverage:
  - {name: orders_have_lines, relationship: line_of_order, min: 1, on_fail: flag}
""",
    "map_region": """
mapping_version: 1
source: region
target: region
key: {region_id: {from: $.r_regionkey}}
fields: {name: {from: $.r_name, transform: [trim, lower]}}
""",
    "map_nation": """
mapping_version: 1
source: nation
target: nation
key: {nation_id: {from: $.n_nationkey}}
fields: {name: {from: $.n_name}, region_id: {from: $.n_regionkey}}
""",
    "map_customer": """
mapping_version: 1
source: customer
target: customer
key: {customer_id: {from: $.c_custkey}}
fields:
  name: {from: $.c_name}
  number: {from: $.c_name, transform: [{split_part: ["#", 2]}]}
  segment: {from: $.c_mktsegment, transform: [{enum_map: [AUTOMOBILE, auto, MACHINERY, machine]}]}
  balance: {from: $.c_acctbal}
  nation_id: {from: $.c_nationkey}
""",
    "map_part": """
mapping_version: 1
source: part
target: part
key: {part_id: {from: $.p_partkey}}
fields:
  name: {from: $.p_name, transform: [upper]}
  brand: {from: $.p_brand, transform: [{strip_prefix: "Brand#"}]}
  kind: {from: $.p_type, transform: [lower, {concat: "!"}]}
""",
    "map_supplier": """
mapping_version: 1
source: supplier
target: supplier
key: {supplier_id: {from: $.s_suppkey}}
fields: {name: {from: $.s_name}, nation_id: {from: $.s_nationkey}}
""",
    "map_orders": """
mapping_version: 1
source: orders
target: order
key: {order_id: {from: $.o_orderkey}}
fields:
  customer_id: {from: $.o_custkey}
  status: {from: $.o_orderstatus, transform: [{enum_map: [F, filled, O, open]}]}
  priority: {from: $.o_orderpriority, transform: [{regex_extract: ["^([0-9])", 1]}]}
  amount: {from: $.o_totalprice}
  order_date: {from: $.o_orderdate}
  due_date: {macro: days_after@1, from: {day: $.o_orderdate}, parameters: {days: 30}}
""",
    "map_lineitem": """
mapping_version: 1
source: lineitem
target: line
key: {order_id: {from: $.l_orderkey}, line_no: {from: $.l_linenumber}}
fields:
  part_id: {from: $.l_partkey}
  supplier_id: {from: $.l_suppkey}
  quantity: {from: $.l_quantity}
  list_price: {from: $.l_extendedprice}
  discount: {from: $.l_discount}
  net_price: {recipe: from_discount, from: {list_price: $.l_extendedprice, discount: $.l_discount}}
  return_flag: {from: $.l_returnflag}
  status: {from: $.l_linestatus}
  ship_date: {from: $.l_shipdate}
unmapped: [$._load_id, $._ingested_at, $._source_row_id]
""",
    "map_events": """
mapping_version: 1
source: events
target: event
key: {event_id: {from: $.event_id}}
fields:
  user_id: {from: $.user_id}
  kind: {from: $.event_type, transform: [{enum_map: [purchase, buy, view, see, click, click]}], quality: [{rule: in_enum, on_fail: flag}]}
  raw_kind: {from: $.event_type, quality: [{rule: pattern, regex: "^[a-r]+$", on_fail: flag}, {rule: in_set, values: [click, view, purchase, signup], on_fail: quarantine}, {rule: length, min: 5, max: 6, on_fail: flag}]}
  value: {from: $.value, quality: [{rule: unique, on_fail: flag}, {rule: range, min: "0.50", max: "250.00", on_fail: quarantine}]}
  k: {from: $.props.k, transform: [to_int], quality: [{rule: range, max: 95, on_fail: flag}]}
  k_text: {from: $.props.k, transform: [{nullif: "7"}], quality: [{rule: not_null, on_fail: flag}, {rule: charset, allow: ["U+0030-U+0038"], on_fail: flag}]}
  half: {from: $.props.k, transform: [{concat: "x"}, {strip_suffix: "0x"}, to_int], quality: [{rule: coercible, on_fail: flag}]}
  event_date: {from: $.ts}
  seen_at: {from: $.ts}
unmapped: [$._load_id, $._ingested_at, $._source_row_id]
""",
    "map_party_customer": """
mapping_version: 1
source: customer
target: party
key: {party: {from: $.c_name, transform: [{split_part: ["#", 1]}]}, party_id: {from: $.c_custkey}}
fields: {balance: {from: $.c_acctbal}, segment: {from: $.c_mktsegment}}
""",
    "map_party_supplier": """
mapping_version: 1
source: supplier
target: party
key: {party: {from: $.s_name, transform: [{split_part: ["#", 1]}]}, party_id: {from: $.s_suppkey}}
fields: {balance: {from: $.s_acctbal}}
""",
    "map_documents": """
mapping_version: 1
source: documents
target: page
key: {doc_id: {from: $.doc_id}}
fields:
  body: {from: $.text, quality: [{rule: normalize, form: nfc, on_fail: flag}, {rule: charset, forbid: ["U+00C0-U+017F"], on_fail: flag}, {rule: length, min: 20, on_fail: quarantine}]}
  lang: {from: $.lang}
  source: {from: $.source}
unmapped: [$._load_id, $._ingested_at, $._source_row_id]
""",
    "metrics": """
metrics_version: 1
metrics:
  revenue: {grain: order, additivity: additive, agg: sum, expr: amount}
  order_count: {grain: order, additivity: additive, agg: count, expr: order_id}
  buyers: {grain: order, additivity: non_additive, agg: count_distinct, expr: customer_id, decomposition: {kind: distinct}}
  largest_order: {grain: order, additivity: additive, agg: max, expr: amount}
  smallest_order: {grain: order, additivity: additive, agg: min, expr: amount}
  mean_order: {grain: order, additivity: additive, agg: avg, expr: amount}
  median_order: {grain: order, additivity: additive, agg: median, expr: amount}
  open_orders: {grain: order, additivity: additive, agg: sum_boolean, expr: "status = 'open'"}
  average_order_value: {additivity: non_additive, requires_metrics: [revenue, order_count], ratio: {numerator: revenue, denominator: order_count}}
  net_revenue: {template: net_revenue}
  units: {requires: [quantity], grain: line, additivity: additive, agg: sum, expr: quantity}
  listed: {grain: line, additivity: additive, agg: sum, expr: "list_price * quantity"}
  price_per_unit: {additivity: non_additive, requires_metrics: [net_revenue, units], ratio: {numerator: net_revenue, denominator: units}}
  level: {grain: event, additivity: semi_additive, agg: sum, expr: value, semi_additive: {over: event_date, rule: last}}
  opening_level: {grain: event, additivity: semi_additive, agg: sum, expr: value, semi_additive: {over: event_date, rule: first}}
  events: {grain: event, additivity: additive, agg: count, expr: event_id}
""",
    "marts": """
marts_version: 1
marts:
  orders:
    grain: order
    base: order
    flatten:
      - {via: order_of_customer, prefix: customer_}
      - {via: customer_in_nation, prefix: nation_}
      - {via: nation_in_region, prefix: region_}
      - {date: order_date, role: ordered}
      - {date: due_date, role: due}
    measures: [revenue, order_count, largest_order, smallest_order, mean_order, median_order, open_orders]
    partition_by: [order_date]
    assert:
      - {name: busy_months, measure: amount, agg: sum, by: [ordered_month], min: "50000000", on_fail: flag}
  lines:
    grain: line
    base: line
    flatten:
      - {via: line_of_order, prefix: order_}
      - {via: line_of_part, prefix: part_}
      - {via: line_of_supplier, prefix: supplier_}
      - {date: ship_date, role: shipped}
    measures: [net_revenue, units, listed]
  events:
    grain: event
    base: event
    flatten:
      - {date: event_date, role: happened}
    measures: [level, opening_level, events]
""",
}

STEPS = Registry((StepDef("days_after", 1, "sql_macro", body="date_add(CAST(:day AS DATE), :days)", parameters={"days": {"type": "int", "min": 0, "max": 366}}),))

_ROW_ID = {
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "events": ("event_id",),
    "documents": ("doc_id",),
}
_ARRIVED = {"lineitem": "l_shipdate", "events": "ts", "documents": None}
_checked: list[Project] = []


def project() -> Project:
    if not _checked:
        _checked.append(check(parse_texts(TEXTS), STEPS))
    return _checked[0]


class Landed(dict):
    """The landed tables, each opened when it is asked for; those under deduplication or quarantine get ingestion
    columns out of their own values."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, t: str) -> DataFrame:
        got = self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet")
        if t in _ROW_ID:
            at = F.col(_ARRIVED[t]) if _ARRIVED[t] else F.lit("2024-01-01 00:00:00")
            got = acknowledged(got, "load-1", at, F.concat_ws("-", *_ROW_ID[t]))
        self[t] = got
        return got


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    return Frames(project(), Landed(spark, sf_dir), STEPS)
