"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrain.functions.transforms import apply_chain, parse_step
from sparkgrain.functions.types import BOOL, DATE, INT, STRING, TIMESTAMP, decimal
from sparkgrain.operators import audits as A
from sparkgrain.operators import marts as M
from sparkgrain.operators import rejects as J
from sparkgrain.operators.quality_mart import Counted, quality_mart
from sparkgrain.plans import retail
from sparkgrain.plans.request import AnyOf, MetricRequest, OrderSpec, Predicate, RowPolicy, parse_filter_json
from sparkgrain.sources.store import scd2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query of (frames) with its SQL, which holds {CTE} names filled from _CTE."""

    def add(f):
        n = name or f.__name__
        QUERIES[n] = lambda spark, sf_dir: f(retail.frames(spark, sf_dir))
        if sql:
            ORACLES[n] = _with(sql)
        return f

    return add


#: The silver tables as SQL; a query gets those that it names.
_CTE = {
    "s_order": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, regexp_extract(o_orderpriority, '^([0-9])', 1) AS priority, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderdate AS DATE) + 30 AS due_date FROM orders",
    "s_customer": "SELECT c_custkey AS customer_id, c_name AS name, split_part(c_name, '#', 2) AS number, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'MACHINERY' THEN 'machine' ELSE c_mktsegment END AS segment, CAST(c_acctbal AS DECIMAL(12,2)) AS balance, CAST(c_nationkey AS BIGINT) AS nation_id FROM customer",
    "l_all": "SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_id, l_suppkey AS supplier_id, CAST(l_quantity AS DECIMAL(12,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS list_price, CAST(l_discount AS DECIMAL(4,2)) AS discount, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS net_price, l_returnflag AS return_flag, l_linestatus AS status, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem",
    "s_line": "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_no ORDER BY ship_date DESC NULLS LAST, part_id DESC NULLS LAST, supplier_id DESC NULLS LAST, quantity DESC NULLS LAST, list_price DESC NULLS LAST, discount DESC NULLS LAST, return_flag DESC NULLS LAST, status DESC NULLS LAST) AS place FROM l_all) WHERE place = 1",
    "e_all": "SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'view' THEN 'see' ELSE event_type END AS kind, event_type AS raw_kind, CAST(value AS DECIMAL(18,2)) AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, nullif(json_extract_string(props, '$.k'), '7') AS k_text, TRY_CAST(CASE WHEN json_extract_string(props, '$.k') || 'x' LIKE '%0x' THEN left(json_extract_string(props, '$.k'), length(json_extract_string(props, '$.k')) - 1) ELSE json_extract_string(props, '$.k') || 'x' END AS BIGINT) AS half, CAST(ts AS DATE) AS event_date, ts AS seen_at FROM events",
    "e_rules": "SELECT *, kind NOT IN ('buy', 'see', 'click') AS r_in_enum, NOT regexp_full_match(raw_kind, '[a-r]+') AS r_pattern, raw_kind NOT IN ('click', 'view', 'purchase', 'signup') AS r_in_set, length(raw_kind) < 5 OR length(raw_kind) > 6 AS r_length, value < 0.50 OR value > 250.00 AS r_range, k > 95 AS r_kmax, k_text IS NULL AS r_not_null, length(translate(k_text, '012345678', '')) > 0 AS r_charset, half IS NULL AS r_coercible, value IS NOT NULL AND count(*) OVER (PARTITION BY value) > 1 AS r_unique, NOT (kind <> 'buy' OR value >= 1.00) AS r_expression, user_id IS NOT NULL AND user_id NOT IN (SELECT s_suppkey FROM supplier) AS r_referential FROM e_all",
    "e_flags": "SELECT *, list_filter([CASE WHEN r_expression THEN 'cheap_purchase' END, CASE WHEN r_referential THEN 'event_by_supplier_referential' END, CASE WHEN r_coercible THEN 'half_coercible' END, CASE WHEN r_kmax THEN 'k_range_max' END, CASE WHEN r_charset THEN 'k_text_charset' END, CASE WHEN r_not_null THEN 'k_text_not_null' END, CASE WHEN r_in_enum THEN 'kind_in_enum' END, CASE WHEN r_length THEN 'raw_kind_length' END, CASE WHEN r_pattern THEN 'raw_kind_pattern' END, CASE WHEN r_unique THEN 'value_unique' END], lambda x: x IS NOT NULL) AS flags, coalesce(r_in_set, false) OR coalesce(r_range, false) AS diverted FROM e_rules",
    "s_event": "SELECT * FROM e_flags WHERE NOT diverted",
    "m_orders": "SELECT o.*, c.name AS customer_name, c.segment AS customer_segment, c.balance AS customer_balance, n.n_name AS nation_name, lower(trim(r.r_name)) AS region_name, CAST(date_trunc('week', order_date) AS DATE) AS ordered_week, CAST(date_trunc('month', order_date) AS DATE) AS ordered_month, CAST(date_trunc('quarter', order_date) AS DATE) AS ordered_quarter, CAST(date_trunc('year', order_date) AS DATE) AS ordered_year, CAST(date_trunc('month', due_date) AS DATE) AS due_month FROM s_order o LEFT JOIN s_customer c USING (customer_id) LEFT JOIN nation n ON c.nation_id = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey",
}


def _with(sql: str) -> str:
    """The SQL with the common tables that it reads, and those that they read, before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for n in _CTE:
            if n not in need and any(f" {n}{end}" in text + " " for end in (" ", ")", "\n", ",")):
                visit(_CTE[n])
                need.append(n)

    visit(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({_CTE[n]})" for n in need) + "\n" if need else "") + sql


def _ask(fr, metrics, by=(), **kw) -> DataFrame:
    policy = kw.pop("policy", None)
    return fr.answer(MetricRequest(tuple(metrics), tuple(by), **kw), policy)


# scans and projections ------------------------------------------------------------------------------------------------

@query("SELECT * FROM (SELECT split_part(c_name, '#', 1) AS party, c_custkey AS party_id, CAST(c_acctbal AS DECIMAL(12,2)) AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT split_part(s_name, '#', 1), s_suppkey, CAST(s_acctbal AS DECIMAL(12,2)), NULL, 'supplier' FROM supplier)")
def scan_union_merge(fr):
    return fr.silver("party").select("party", "party_id", "balance", "segment", F.col("_source").alias("source"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_props(fr):
    return fr.pipeline("event").evaluated.select("event_id", "k")


@query("SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS net_price FROM lineitem")
def recipe_projection(fr):
    from sparkgrain.operators.silver import branch

    p = fr.project
    rows = branch(p, fr.registry, p.entities["line"], p.mappings_of("line")[0], fr.bronze["lineitem"], False, False)
    return rows.select("order_id", "line_no", "net_price")


@query("SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) + 30 AS due_date FROM orders")
def macro_projection(fr):
    return fr.silver("order").select("order_id", "due_date")


def _chain(col: str, chain: list, to, lenient: bool = False):
    return apply_chain(F.col(col).cast("string"), [parse_step(x, col) for x in chain], to, lenient)


@query("SELECT p_partkey, upper(p_name) AS upper_name, lower(p_type) AS lower_type, split_part(p_name, ' ', 2) AS second_word, regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_no, CASE WHEN starts_with(p_brand, 'Brand#') THEN substring(p_brand, 7) ELSE p_brand END AS bare_brand, CASE WHEN ends_with(p_name, 'et') THEN left(p_name, length(p_name) - 2) ELSE p_name END AS bare_name, p_type || '-x' AS tagged, CASE p_type WHEN 'PROMO' THEN 'offer' WHEN 'ECONOMY' THEN 'basic' ELSE p_type END AS mapped, trim('  ' || p_name || ' ') AS trimmed FROM part")
def transforms_string(fr):
    padded = fr.bronze["part"].withColumn("padded", F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return padded.select(
        "p_partkey", _chain("p_name", ["upper"], STRING).alias("upper_name"), _chain("p_type", ["lower"], STRING).alias("lower_type"), _chain("p_name", [{"split_part": [" ", 2]}], STRING).alias("second_word"),
        _chain("p_brand", [{"regex_extract": ["#([0-9]+)", 1]}], STRING).alias("brand_no"), _chain("p_brand", [{"strip_prefix": "Brand#"}], STRING).alias("bare_brand"), _chain("p_name", [{"strip_suffix": "et"}], STRING).alias("bare_name"),
        _chain("p_type", [{"concat": "-x"}], STRING).alias("tagged"), _chain("p_type", [{"enum_map": ["PROMO", "offer", "ECONOMY", "basic"]}], STRING).alias("mapped"), _chain("padded", ["trim"], STRING).alias("trimmed"),
    )


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 1.25 AS DECIMAL(15,4)) AS up, round(CAST(c_acctbal AS DECIMAL(12,2)), 1) AS rounded, abs(CAST(c_acctbal AS DECIMAL(12,2))) AS size, CAST(c_nationkey AS BIGINT) <> 0 AS abroad, coalesce(CAST(nullif(c_nationkey, 3) AS BIGINT), -1) AS filled FROM customer")
def transforms_decimal(fr):
    d = {"to_decimal": [12, 2]}
    return fr.bronze["customer"].select(
        "c_custkey", _chain("c_acctbal", [d, {"multiply": "1.25"}], decimal(15, 4)).alias("up"), _chain("c_acctbal", [d, {"round": 1}], decimal(12, 1)).alias("rounded"), _chain("c_acctbal", [d, "abs"], decimal(12, 2)).alias("size"),
        _chain("c_nationkey", ["to_int", "to_bool"], BOOL).alias("abroad"), _chain("c_nationkey", ["to_int", {"nullif": 3}, {"coalesce": -1}], INT).alias("filled"),
    )


@query("SELECT event_id, ts AS seen, CAST(ts AS DATE) AS day, CAST(date_trunc('second', ts) AS TIMESTAMP) - INTERVAL 1 HOUR AS utc FROM events")
def transforms_dates(fr):
    text = fr.bronze["events"].withColumn("s", F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).withColumn("iso", F.col("ts").cast("string"))
    return text.select("event_id", _chain("iso", [{"parse_ts": "ISO8601"}], TIMESTAMP).alias("seen"), F.col("ts").cast("date").alias("day"), _chain("s", [{"parse_ts": "%d/%m/%Y %H:%M:%S"}, {"to_utc": "Europe/Berlin"}], TIMESTAMP).alias("utc"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'today' WHEN event_id % 5 = 0 THEN '2024-13-01' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS day FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 7 = 0")
def lenient_casts(fr):
    raw = fr.bronze["events"].withColumn("s", F.when(F.col("event_id") % 7 == 0, "today").when(F.col("event_id") % 5 == 0, "2024-13-01").otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return raw.select("event_id", _chain("s", [{"parse_date": "ISO8601"}], DATE, True).alias("day"))


@query("SELECT customer_id, segment FROM s_customer")
def enum_map_passthrough(fr):
    return fr.silver("customer").select("customer_id", "segment")


# the silver pipeline --------------------------------------------------------------------------------------------------

@query("SELECT order_id, line_no, part_id, supplier_id, quantity, list_price, discount, net_price, return_flag, status, ship_date FROM s_line")
def dedupe_latest_by(fr):
    return fr.silver("line").select("order_id", "line_no", "part_id", "supplier_id", "quantity", "list_price", "discount", "net_price", "return_flag", "status", "ship_date")


@query("SELECT event_id, array_to_string(flags, ',') AS flags, len(flags) = 0 AS ok FROM s_event")
def flags_single_pass(fr):
    return fr.silver("event").select("event_id", F.array_join("_quality_flags", ",").alias("flags"), F.col("_quality_ok").alias("ok"))


@query("SELECT event_id, user_id, kind, value FROM s_event")
def route_kept(fr):
    return fr.silver("event").select("event_id", "user_id", "kind", "value")


@query("SELECT event_id AS source_row, sha256('S6:events' || 'S' || length(CAST(event_id AS VARCHAR)) || ':' || CAST(event_id AS VARCHAR)) AS reject_id, array_to_string(list_sort(list_concat(flags, list_filter([CASE WHEN r_in_set THEN 'raw_kind_in_set' END, CASE WHEN r_range THEN 'value_range' END], lambda x: x IS NOT NULL))), ',') AS failed_rules FROM e_flags WHERE diverted")
def route_rejects(fr):
    rows = J.reject_rows(fr.pipeline("event"), "events")
    return rows.select(F.col("_source_row_id").cast("bigint").alias("source_row"), "reject_id", F.array_join("failed_rules", ",").alias("failed_rules"))


def _rule(name: str, rule: str, column: str) -> None:
    query(f"SELECT event_id FROM e_rules WHERE {column}", f"rule_{name}")(lambda fr: fr.pipeline("event").evaluated.where(F.array_contains("_failed", rule)).select("event_id"))


for _n, _r, _c in (("in_enum", "kind_in_enum", "r_in_enum"), ("pattern", "raw_kind_pattern", "r_pattern"), ("in_set", "raw_kind_in_set", "r_in_set"), ("length", "raw_kind_length", "r_length"), ("range", "value_range", "r_range"), ("range_max", "k_range_max", "r_kmax"), ("not_null", "k_text_not_null", "r_not_null"), ("charset", "k_text_charset", "r_charset"), ("coercible", "half_coercible", "r_coercible"), ("unique", "value_unique", "r_unique"), ("expression", "cheap_purchase", "r_expression"), ("referential", "event_by_supplier_referential", "r_referential")):
    _rule(_n, _r, _c)


@query("SELECT doc_id, nfc_normalize(text) <> text AS not_nfc, length(translate(text, (SELECT string_agg(chr(CAST(i AS INTEGER)), '') FROM range(192, 384) t(i)), '')) < length(text) AS accented, length(text) < 20 AS short FROM documents")
def rule_normalize_and_forbid(fr):
    fired = lambda rule: F.array_contains("_failed", rule)
    return fr.pipeline("page").evaluated.select("doc_id", fired("body_normalize").alias("not_nfc"), fired("body_charset").alias("accented"), fired("body_length_min").alias("short"))


# audits ---------------------------------------------------------------------------------------------------------------

@query("SELECT id, count(DISTINCT src) AS n_sources FROM (SELECT c_custkey AS id, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier) GROUP BY id HAVING count(DISTINCT src) > 1")
def collision_audit(fr):
    return A.collisions(fr.silver("party").select(F.col("party_id").alias("id"), "_source"), ("id",))


@query("SELECT order_id, left_value, right_value, coalesce(abs(left_value - right_value) <= 1000.00, false) AS agrees FROM (SELECT order_id, sum(amount) AS left_value FROM s_order GROUP BY 1) FULL JOIN (SELECT order_id, sum(list_price) AS right_value FROM s_line GROUP BY 1) USING (order_id)")
def reconcile_null_safe(fr):
    return fr.reconcile("order_totals")


@query("SELECT o_orderkey AS order_id, CAST(0 AS BIGINT) AS n_dependents FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def coverage_audit(fr):
    return fr.coverage("orders_have_lines")


@query("SELECT ordered_month, sum(amount) AS value FROM m_orders GROUP BY 1 HAVING sum(amount) < 50000000")
def mart_assert_groups(fr):
    m = fr.project.marts["orders"]
    return A.mart_assertion(m, m.asserts[0], fr.mart("orders"))


@query("SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_totalprice > 400000 OR o_orderstatus NOT IN ('F', 'O')")
def row_audit_predicates(fr):
    bad = A.assertion("amount", "max", "400000", decimal(18, 2)) | A.assertion("status", "enum", ["filled", "open"], STRING)
    return fr.silver("order").where(bad).select("order_id", "amount")


# marts ----------------------------------------------------------------------------------------------------------------

@query("SELECT order_id, customer_name, customer_segment, nation_name, region_name, amount FROM m_orders")
def mart_flatten_two_hop(fr):
    return fr.mart("orders").select("order_id", "customer_name", "customer_segment", "nation_name", "region_name", "amount")


@query("SELECT order_id, ordered_week, ordered_month, ordered_quarter, ordered_year, due_month FROM m_orders")
def mart_role_dates(fr):
    return fr.mart("orders").select("order_id", "ordered_week", "ordered_month", "ordered_quarter", "ordered_year", "due_month")


@query("SELECT CAST(d AS DATE) AS day, CAST(date_trunc('week', d) AS DATE) AS week, CAST(date_trunc('month', d) AS DATE) AS month, CAST(date_trunc('quarter', d) AS DATE) AS quarter, CAST(date_trunc('year', d) AS DATE) AS year FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) t(d)")
def dim_date(fr):
    d = fr.project.catalog.date_dimension
    return M.calendar(fr.bronze["region"].sparkSession, d["start_year"], d["end_year"])


# metric requests ------------------------------------------------------------------------------------------------------

@query("SELECT ordered_month, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM m_orders GROUP BY 1")
def metric_additive_by_month(fr):
    return _ask(fr, ["revenue"], ["ordered_month"])


@query("SELECT CAST(sum(amount) AS DECIMAL(18,2)) AS revenue, count(order_id) AS order_count FROM m_orders")
def metric_ungrouped(fr):
    return _ask(fr, ["revenue", "order_count"])


@query("SELECT ordered_year, CAST(date_trunc('year', due_date) AS DATE) AS due_year, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM m_orders GROUP BY 1, 2")
def metric_two_roles(fr):
    return _ask(fr, ["revenue"], ["ordered_day", "due_day"], time_grain="year")


@query("SELECT customer_segment, CAST(CAST(sum(amount) AS DECIMAL(38,9)) / nullif(count(order_id), 0) AS DECIMAL(38,2)) AS aov FROM m_orders GROUP BY 1")
def metric_ratio_by_segment(fr):
    return _ask(fr, ["average_order_value"], ["customer_segment"]).select("customer_segment", F.col("average_order_value").cast("decimal(38,2)").alias("aov"))


@query("SELECT month AS happened_month, CAST(sum(value) FILTER (event_date = last_day) AS DECIMAL(18,2)) AS level, CAST(sum(value) FILTER (event_date = first_day) AS DECIMAL(18,2)) AS opening_level, count(event_id) AS events FROM (SELECT *, CAST(date_trunc('month', event_date) AS DATE) AS month, max(event_date) OVER (PARTITION BY date_trunc('month', event_date)) AS last_day, min(event_date) OVER (PARTITION BY date_trunc('month', event_date)) AS first_day FROM s_event) GROUP BY 1")
def metric_semi_additive_last(fr):
    return _ask(fr, ["level", "opening_level", "events"], ["happened_month"])


@query("SELECT kind, k, CAST(sum(value) AS DECIMAL(18,2)) AS level FROM s_event WHERE event_date = (SELECT max(event_date) FROM s_event WHERE event_date <= DATE '2024-01-20') GROUP BY 1, 2")
def metric_semi_additive_by_kind(fr):
    """Most groups have no row on the last day, and none in the result."""
    return _ask(fr, ["level"], ["kind", "k"], filters=(Predicate("happened_day", "lte", ("2024-01-20",)),))


@query("SELECT region_name, min(amount) AS smallest_order, max(amount) AS largest_order, CAST(median(CAST(amount AS DECIMAL(38,9))) AS DECIMAL(38,9)) AS median_order, count(*) FILTER (status = 'open') AS open_orders FROM m_orders GROUP BY 1")
def metric_other_aggregates(fr):
    return _ask(fr, ["smallest_order", "largest_order", "median_order", "open_orders"], ["region_name"])


@query("SELECT count(DISTINCT customer_id) AS buyers, ordered_year FROM m_orders GROUP BY 2")
def metric_count_distinct(fr):
    from sparkgrain.plans.request import aggregate, merged

    return fr.mart("orders").groupBy("ordered_year").agg(aggregate(merged(fr.project, "buyers")).alias("buyers"))


@query("SELECT order_status, CAST(sum(net_price) AS DECIMAL(18,4)) AS net_revenue, CAST(sum(quantity) AS DECIMAL(12,2)) AS units, CAST(sum(list_price * quantity) AS DECIMAL(38,9)) AS listed FROM (SELECT l.*, o.status AS order_status FROM s_line l LEFT JOIN s_order o USING (order_id)) GROUP BY 1")
def metric_line_expressions(fr):
    return _ask(fr, ["net_revenue", "units", "listed"], ["order_status"])


@query("SELECT ordered_quarter, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM m_orders WHERE (customer_segment = 'auto' OR region_name = 'asia') AND priority IN ('1', '2') AND order_date >= DATE '1997-01-01' GROUP BY 1")
def filter_cnf_anyof(fr):
    clauses = (AnyOf((Predicate("customer_segment", "eq", ("auto",)), Predicate("region_name", "eq", ("asia",)))), Predicate("priority", "in", ("1", "2")), Predicate("ordered_day", "gte", (date(1997, 1, 1),)))
    return _ask(fr, ["revenue"], ["ordered_quarter"], filters=clauses)


@query("SELECT nation_name, count(order_id) AS order_count FROM m_orders WHERE NOT (customer_segment IN ('auto', 'BUILDING') AND amount > 100000.00) AND (nation_name LIKE 'NATION\\_1%' ESCAPE '\\' OR lower(nation_name) LIKE 'nation_2') GROUP BY 1")
def filter_json_and_like_escape(fr):
    doc = {"$and": [{"$not": {"customer_segment": {"$in": ["auto", "BUILDING"]}, "amount": {"$gt": "100000.00"}}}, {"$or": [{"nation_name": {"$like": "NATION\\_1%"}}, {"nation_name": {"$ilike": "Nation_2"}}]}]}
    return _ask(fr, ["order_count"], ["nation_name"], filters=parse_filter_json(doc))


@query("SELECT customer_segment, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM m_orders WHERE region_name IN ('asia', 'europe') AND status <> 'open' GROUP BY 1")
def row_policy(fr):
    return _ask(fr, ["revenue"], ["customer_segment"], filters=(Predicate("status", "ne", ("open",)),), policy=RowPolicy("region_name", ("asia", "europe")))


@query("SELECT customer_name, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM m_orders GROUP BY 1 ORDER BY revenue DESC NULLS LAST, customer_name NULLS FIRST LIMIT 25")
def topk_metric(fr):
    return _ask(fr, ["revenue"], ["customer_name"], order_by=(OrderSpec("revenue", "desc"), OrderSpec("customer_name")), limit=25)


# rejects, history, quality mart -----------------------------------------------------------------------------------------

@query("SELECT 'event' AS entity, 'events->event' AS mapping, rule, disposition, rows_evaluated, rows_failed, rows_quarantined, CAST(0 AS BIGINT) AS rows_deduped FROM (SELECT '(entity)' AS rule, '(none)' AS disposition, count(*) AS rows_evaluated, CAST(0 AS BIGINT) AS rows_failed, count(*) FILTER (diverted) AS rows_quarantined FROM e_flags UNION ALL " + " UNION ALL ".join(f"SELECT '{r}', '{how}', CAST(0 AS BIGINT), count(*) FILTER ({c}), CAST(0 AS BIGINT) FROM e_flags" for r, how, c in (("seen_at_coercible", "quarantine", "false"), ("value_unique", "flag", "r_unique"), ("cheap_purchase", "flag", "r_expression"), ("event_by_supplier_referential", "flag", "r_referential"), ("event_date_coercible", "quarantine", "false"), ("event_id_coercible", "quarantine", "false"), ("half_coercible", "flag", "r_coercible"), ("k_coercible", "quarantine", "false"), ("k_range_max", "flag", "r_kmax"), ("k_text_charset", "flag", "r_charset"), ("k_text_not_null", "flag", "r_not_null"), ("kind_coercible", "quarantine", "false"), ("kind_in_enum", "flag", "r_in_enum"), ("raw_kind_coercible", "quarantine", "false"), ("raw_kind_in_set", "quarantine", "r_in_set"), ("raw_kind_length", "flag", "r_length"), ("raw_kind_pattern", "flag", "r_pattern"), ("user_id_coercible", "quarantine", "false"), ("value_coercible", "quarantine", "false"), ("value_range", "quarantine", "r_range"))) + ")")
def quality_mart_counts(fr):
    got = quality_mart([Counted(fr.pipeline("event"), "events", fr.bronze["events"])], [], "run-1", date(2024, 2, 1))
    return got.drop("run_id", "run_date")


@query("SELECT event_id, kind, value FROM e_flags WHERE NOT coalesce(value < 0.50 OR value > 250.00, false)")
def replay_merge(fr):
    """The event table after the in_set rule was relaxed to a flag and its rejects were replayed."""
    from sparkgrain.catalog_more import relaxed

    return relaxed(fr)[0].select("event_id", "kind", "value")


@query("SELECT r_id AS reject_id, CASE WHEN late THEN 'load-2' ELSE 'load-1' END AS load_id, ts AS first_seen FROM (SELECT sha256('S6:events' || 'S' || length(CAST(event_id AS VARCHAR)) || ':' || CAST(event_id AS VARCHAR)) AS r_id, seen_at AS ts, event_id % 3 = 0 AS late FROM e_flags WHERE diverted)")
def reject_upsert(fr):
    """The reject table when a third of its rows are delivered again a day later: ids and first_seen stay."""
    first = J.reject_rows(fr.pipeline("event"), "events")
    day = F.expr("INTERVAL 1 DAY")
    again = first.where(F.col("_source_row_id").cast("bigint") % 3 == 0).withColumns({"_load_id": F.lit("load-2"), "last_seen": F.col("last_seen") + day, "first_seen": F.col("first_seen") + day})
    return J.upsert_rejects(first, again).select("reject_id", F.col("_load_id").alias("load_id"), "first_seen")


@query("SELECT customer_id, segment, balance, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN customer_id % 10 = 0 THEN TIMESTAMP '2024-02-01' END AS valid_to FROM s_customer UNION ALL SELECT customer_id, 'moved', balance, TIMESTAMP '2024-02-01', NULL FROM s_customer WHERE customer_id % 10 = 0")
def scd2_history(fr):
    rows = fr.silver("customer").select("customer_id", "segment", "balance")
    old = scd2(None, rows, ("customer_id",), datetime(2024, 1, 1))
    new = rows.withColumn("segment", F.when(F.col("customer_id") % 10 == 0, "moved").otherwise(F.col("segment")))
    return scd2(old, new, ("customer_id",), datetime(2024, 2, 1))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'two' ELSE 'one' END AS batch, o_orderkey AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders")
def upsert_by_key(fr):
    rows = fr.silver("order").select(F.lit("one").alias("batch"), "order_id", "amount")
    new = rows.where("order_id % 4 = 0").withColumns({"batch": F.lit("two"), "amount": F.lit(0).cast("decimal(18,2)")})
    return J.upsert(rows, new, ("order_id",))


# steps, refusals --------------------------------------------------------------------------------------------------------

@query("SELECT customer_id, count(*) AS n_orders, CAST(sum(amount) AS DECIMAL(28,2)) AS spent FROM s_order GROUP BY 1")
def step_sql_model(fr):
    from sparkgrain.operators.steps import Registry, StepDef, run_step

    out = {"totals": {"columns": {"customer_id": "int", "n_orders": "int", "spent": "decimal(28,2)"}, "key": ["customer_id"]}}
    reg = Registry((StepDef("spending", 1, "sql_model", body="SELECT customer_id, count(*) AS n_orders, CAST(sum(amount) AS DECIMAL(28,2)) AS spent FROM {orders} WHERE amount > :least GROUP BY customer_id", inputs=("orders",), outputs=out, parameters={"least": {"type": "decimal(18,2)", "default": "0"}}),))
    got = run_step(reg, {"use": "spending@1", "inputs": {"orders": "silver.order"}, "outputs": {"totals": "silver.spending"}}, {"order": fr.silver("order")})
    return got["spending"]


@query("SELECT l_orderkey AS order_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def step_sibling_consistency(fr):
    from sparkgrain.operators.steps import siblings_consistent

    return siblings_consistent(fr.silver("order").where("status = 'filled'"), fr.silver("line").select("order_id").distinct(), "order_id", "order_id")


_REFUSALS = {
    "fan_out": ("marts", "{via: line_of_order, prefix: order_}", "{via: nation_in_region, prefix: order_}"),
    "grain": ("marts", "measures: [level,", "measures: [revenue, level,"),
    "unknown_transform": ("map_region", "[trim, lower]", "[trimm, lower]"),
    "chain_type": ("map_orders", "{from: $.o_totalprice}", "{from: $.o_totalprice, transform: [{multiply: 2}]}"),
    "retention": ("entities", "    quarantine: {retention: 90d}\n", ""),
    "tie_break": ("entities", ", tie_break: [part_id, supplier_id, quantity, list_price, discount, return_flag, status]", ""),
    "additivity": ("metrics", ", ratio: {numerator: revenue, denominator: order_count}", ""),
    "currency_unit": ("metrics", 'expr: "list_price * quantity"', 'expr: "list_price + quantity"'),
    "missing_reference": ("marts", "base: line", "base: lines"),
    "duplicate_column": ("marts", "prefix: nation_}", "prefix: customer_}"),
}


from sparkgrain import catalog_more  # noqa: E402,F401: registers the rest
