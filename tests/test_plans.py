"""Specs, refusals, requests and spec diffs: no job runs."""

import pytest

from sparkgrain import catalog
from sparkgrain import errors as E
from sparkgrain.functions.transforms import check_chain, java_pattern, parse_step
from sparkgrain.functions.types import INT, STRING, assignable, decimal, parse_type
from sparkgrain.operators.rules import code_points, portable_pattern
from sparkgrain.plans import retail
from sparkgrain.plans.evolve import diff
from sparkgrain.plans.guard import check, columns_of, evidence
from sparkgrain.plans.request import AnyOf, MetricRequest, OrderSpec, Predicate, RowPolicy, parse_filter_json, parse_page_json, parse_sort_json, plan, reachable
from sparkgrain.plans.spec import fingerprint, load_yaml, parse_texts


def changed(doc, was, now):
    assert was in retail.TEXTS[doc]
    return parse_texts({**retail.TEXTS, doc: retail.TEXTS[doc].replace(was, now)})


def test_types():
    assert str(parse_type("decimal(12, 4)")) == "decimal(12,4)"
    assert assignable(decimal(10, 2), decimal(12, 4)) and not assignable(decimal(12, 4), decimal(12, 2))
    for bad in ("float", "decimal(39,1)", "decimal(2,3)"):
        with pytest.raises(E.ParseError):
            parse_type(bad)


def test_yaml_refuses_repeated_keys_and_unknown_ones():
    with pytest.raises(E.ParseError):
        load_yaml("a: 1\na: 2", "x")
    with pytest.raises(E.ParseError):
        parse_texts({"m": "marts_version: 1\nmarts: {}\nmore: 1"})


@pytest.mark.parametrize("name,error", [("fan_out", E.FanoutRisk), ("grain", E.GrainViolation), ("unknown_transform", E.UnknownTransform), ("chain_type", E.ChainTypeError), ("retention", E.RetentionMissing), ("tie_break", E.TieBreakMissing), ("additivity", E.AdditivityViolation), ("currency_unit", E.GuardrailError), ("missing_reference", E.MissingReference)])
def test_refusals(name, error):
    with pytest.raises(error):
        check(changed(*catalog._REFUSALS[name]), retail.STEPS)


@pytest.mark.parametrize("doc,was,now,error", [
    ("marts", "  - {date: ship_date, role: shipped}", "", E.MissingTimeDimension),
    ("entities", "  customer:\n    grain", "  customer:\n    scd: type2\n    grain", E.HistoricalFanout),
    ("map_events", "unmapped: [$._load_id, $._ingested_at, $._source_row_id]", "", E.IngestionMetadataMissing),
    ("entities", "from: nation, to: region, via: {region_id: region_id}, cardinality: many_to_one", "from: nation, to: region, via: {region_id: region_id}, cardinality: one_to_many", E.FanoutRisk),
    ("entities", "quarantine: {retention: 90d}", "quarantine: {retention: 90d, redact: [$.value]}", E.RedactionConflict),
    ("metrics", "semi_additive: {over: event_date, rule: last}", "semi_additive: {rule: last}", E.AdditivityViolation),
    ("metrics", "expr: quantity}", "expr: amount}", E.GrainMismatch),
    ("entities", "amount: {type: \"decimal(18,2)\"}", "amount: {type: \"decimal(18,2)\", assert: {regex: \"^a$\"}}", E.AssertTyping),
    ("metrics", "net_revenue: {template: net_revenue}", "net_revenue: {template: nothing}", E.MissingReference),
    ("map_orders", "days_after@1", "days_past@1", E.UnknownStep),
    ("entities", "expr: \"kind <> 'buy' or value >= 1.00\"", "expr: \"price > 1\"", E.MissingReference),
    ("entities", "expr: \"kind <> 'buy' or value >= 1.00\"", "expr: \"value + 1\"", E.GuardrailError),
])
def test_more_refusals(doc, was, now, error):
    with pytest.raises(E.SpecError) as got:
        check(changed(doc, was, now), retail.STEPS)
    assert isinstance(got.value, error) or any(isinstance(c, error) for c in got.value.causes)


def test_refusals_come_in_one_batch():
    texts = {**retail.TEXTS}
    texts["marts"] = texts["marts"].replace("prefix: nation_}", "prefix: customer_}").replace("measures: [level,", "measures: [revenue, level,")
    with pytest.raises(E.GuardrailError) as got:
        check(parse_texts(texts), retail.STEPS)
    assert {type(c) for c in got.value.causes} >= {E.GrainViolation, E.GuardrailError}


def test_cycles_are_named():
    texts = {**retail.TEXTS, "metrics": retail.TEXTS["metrics"] + "  a: {additivity: non_additive, requires_metrics: [b, b2], expr: b, ratio: {numerator: b, denominator: a}}\n  b: {additivity: non_additive, requires_metrics: [a], ratio: {numerator: a, denominator: a}}\n  b2: {grain: order, additivity: additive, agg: sum, expr: amount}\n"}
    with pytest.raises(E.CircularDerivation):
        check(parse_texts(texts))


def test_patterns_and_sets():
    assert portable_pattern("^[a-z]+$") == r"\A[a-z]+\z"
    for bad in ("[a-z]+", "^(a)$", "^(?:a+)+$", "^a|b$", r"^\b$", "^(?=a)$"):
        with pytest.raises(E.ParseError):
            portable_pattern(bad)
    assert code_points(["U+0041-U+0043", "z"]) == "ABCz"
    with pytest.raises(E.ParseError):
        code_points(["U+D800"])


def test_chains():
    steps = [parse_step(x, "") for x in ("trim", {"to_decimal": [10, 2]}, {"multiply": "1.5"})]
    assert str(check_chain(steps, decimal(13, 4))) == "decimal(12,3)"
    assert check_chain([parse_step("to_int", "")], INT) == INT
    with pytest.raises(E.ChainTypeError):
        check_chain([parse_step("abs", "")], STRING)
    assert java_pattern("%Y-%m-%d T %H") == "yyyy-MM-dd 'T' HH"


def test_columns_of_an_expression():
    assert columns_of("sum(a * b) + coalesce(c, 0) - 'd'", "") == ["a", "b", "c"]


def test_filters_from_json():
    assert parse_filter_json({}) == ()
    assert parse_filter_json({"a": 1, "b": [1, 2], "c": None}) == (Predicate("a", "eq", (1,)), Predicate("b", "in", (1, 2)), Predicate("c", "is_null", (True,)))
    assert parse_filter_json({"$or": [{"a": 1}, {"$and": [{"b": 2}, {"c": 3}]}]}) == (AnyOf((Predicate("a", "eq", (1,)), Predicate("b", "eq", (2,)))), AnyOf((Predicate("a", "eq", (1,)), Predicate("c", "eq", (3,)))))
    assert parse_filter_json({"$not": {"a": {"$gt": 1}, "b": {"$null": True}}}) == (AnyOf((Predicate("a", "lte", (1,)), Predicate("b", "is_null", (False,)))),)
    for doc, error in (({"a": {"$regex": "x"}}, E.UnsupportedFilter), ({"$not": {"a": {"$like": "x"}}}, E.UnsupportedNegation), ({"a": {"$what": 1}}, E.InvalidRequest), ({"$or": [{"$and": [{f"x{i}": 1}, {f"y{i}": 1}]} for i in range(8)]}, E.FilterTooComplex), ({"a": {"$like": "x\\"}}, E.InvalidRequest), ({"a": float("nan")}, E.InvalidRequest)):
        with pytest.raises(error):
            parse_filter_json(doc)
    deep = {"a": 1}
    for _ in range(70):
        deep = {"$not": deep}
    with pytest.raises(E.FilterTooComplex):
        parse_filter_json(deep)


def test_sort_and_page():
    assert parse_sort_json({"a": "desc", "b": {"dir": "asc", "nulls": "first"}}) == (OrderSpec("a", "desc"), OrderSpec("b"))
    with pytest.raises(E.UnsupportedSort):
        parse_sort_json({"a": {"dir": "asc", "nulls": "last"}})
    assert parse_page_json({"limit": 5, "offset": 0}) == 5
    for doc in ({"offset": 2}, {"after": "x"}):
        with pytest.raises(E.UnsupportedPagination):
            parse_page_json(doc)


def test_planning():
    p = retail.project()
    got = plan(p, MetricRequest(("average_order_value", "revenue"), ("ordered_day",), time_grain="month", limit=90_000), RowPolicy("region_name", ("asia",)))
    assert got.mart.name == "orders" and list(got.columns) == ["ordered_month", "average_order_value", "revenue"] and got.limit == 50_000 and got.warnings
    assert got.fingerprint == plan(p, got.request, RowPolicy("region_name", ("asia",)), max_limit=50_000).fingerprint
    for request, error in (
        (MetricRequest(("revenu",)), E.UnknownMember), (MetricRequest(("revenue", "units")), E.UnreachableAtGrain), (MetricRequest(("revenue",), ("month",)), E.AmbiguousDimension),
        (MetricRequest(("revenue",), ("colour",)), E.UnknownMember), (MetricRequest(("revenue",), ("ordered_day",), time_grain="hour"), E.InvalidRequest), (MetricRequest(("buyers",)), E.UnreachableAtGrain),
        (MetricRequest(("revenue",), filters=(Predicate("amount", "eq", ("x",)),)), E.FilterType), (MetricRequest(("revenue",), filters=(Predicate("ordered_day", "eq", ("2024-13-01",)),)), E.FilterType), (MetricRequest(("revenue",), filters=(Predicate("amount", "like", ("x",)),)), E.FilterType),
    ):
        with pytest.raises(error):
            plan(p, request)
    assert plan(p, MetricRequest(("events",), ("week",))).dimensions[0].column == "happened_week"
    for kw in ({"metrics": ()}, {"metrics": ("a", "a")}, {"metrics": ("a",), "limit": 0}, {"metrics": ("a",), "order_by": (OrderSpec("b"),)}):
        with pytest.raises(E.InvalidRequest):
            MetricRequest(**kw)


def test_reach_and_evidence():
    p = retail.project()
    assert reachable(p, "net_revenue") == []
    got = evidence(changed("map_lineitem", "  net_price: {recipe: from_discount, from: {list_price: $.l_extendedprice, discount: $.l_discount}}\n", ""), retail.STEPS)
    assert got["unreachable"]["net_revenue"] == ["net_price"] and "revenue" in got["reachable"]
    assert evidence(changed(*catalog._REFUSALS["retention"]))["refusals"][0][0] == "RetentionMissing"


def test_fingerprint_minds_meaning_only():
    p = retail.project()
    assert fingerprint(p) == fingerprint(parse_texts(dict(reversed(retail.TEXTS.items()))))
    assert fingerprint(p) != fingerprint(changed("entities", "retention: 90d", "retention: 91d"))


def test_diff():
    p = retail.project()
    assert diff(p, p).changes == ()
    assert all(c.kind == "additive" or c.detail == "required field added" for c in diff(None, p).changes)
    cases = (
        ("entities", 'amount: {type: "decimal(18,2)"}', 'amount: {type: "decimal(20,2)"}', "widening", (), ()),
        ("map_events", "max: \"250.00\"", "max: \"300.00\"", "restating", ("event",), ("event",)),
        ("map_events", "max: \"250.00\"", "max: \"200.00\"", "restating", ("event",), ()),
        ("map_events", "signup], on_fail: quarantine", "signup], on_fail: flag", "restating", ("event",), ("event",)),
        ("entities", "retention: 90d", "retention: 30d", "additive", (), ()),
        ("entities", "brand: {type: string}", "label: {type: string, renamed_from: brand}", "rename", (), ()),
        ("entities", "grain: one row a part", "grain: one row a thing", "breaking", ("part",), ()),
        ("map_part", "transform: [upper]", "transform: [lower]", "restating", ("part",), ()),
        ("metrics", "expr: \"list_price * quantity\"", "expr: \"quantity * list_price\"", "restating", (), ()),
        ("marts", "measures: [revenue,", "measures: [", "breaking", None, None),
    )
    for doc, was, now, kind, backfill, replay in cases:
        new = changed(doc, was, now)
        if doc == "entities" and "renamed_from" in now:
            new = parse_texts({**retail.TEXTS, doc: retail.TEXTS[doc].replace(was, now), "map_part": retail.TEXTS["map_part"].replace("  brand:", "  label:")})
        if backfill is None:
            with pytest.raises(E.ContractViolation):
                diff(p, new)
            continue
        got = diff(p, new)
        assert kind in {c.kind for c in got.changes}, (was, got)
        assert got.backfill == backfill and got.replay == replay, (was, got)
    with pytest.raises(E.ContractViolation):
        diff(p, changed("entities", 'amount: {type: "decimal(18,2)"}', 'amount: {type: "decimal(10,2)"}'))
    assert diff(p, changed("map_orders", "amount: {from: $.o_totalprice}", "amount: {from: $.o_total}")).metrics >= ("average_order_value",)


def test_cli(tmp_path, capsys):
    from sparkgrain.cli import main, spec_json_schema

    for name, text in retail.TEXTS.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    assert main(["check", str(tmp_path)]) == 0 and main(["fingerprint", str(tmp_path)]) == 0
    assert main(["explain", str(tmp_path), "--metrics", "revenue", "--by", "ordered_month", "--where", '{"status": "open"}', "--policy", "region_name=asia"]) == 0
    capsys.readouterr()
    assert main(["compile", str(tmp_path), "--metrics", "revenue", "--by", "ordered_month", "--where", '{"status": {"$neq": "o\'pen"}}']) == 0
    text = capsys.readouterr().out
    assert "FROM mart_orders" in text and "`status` <> 'o\\'pen'" in text and "GROUP BY asked.`ordered_month`" in text
    assert main(["resolve", str(tmp_path)]) == 0 and '"recipe": "from_discount"' in capsys.readouterr().out
    assert main(["explain", str(tmp_path), "--metrics", "nothing"]) == 1 and main(["explain"]) == 2
    assert main(["plan", str(tmp_path), str(tmp_path)]) == 0 and '"changes": []' in capsys.readouterr().out
    assert spec_json_schema("mart")["additionalProperties"] is False
