"""A planned request as Spark SQL text over its mart's table."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from sparkgrain.plans.request import Dimension, Predicate, QueryPlan
from sparkgrain.plans.spec import MetricSpec

_SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def _name(x: str) -> str:
    return "`" + x.replace("`", "``") + "`"


def _text(x: object) -> str:
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _value(v: object, d: Dimension) -> str:
    kind = d.type.name
    if kind == "bool":
        return str(bool(v)).upper()
    if kind == "int":
        return f"{v}L"
    if kind == "decimal":
        return f"{Decimal(v):f}BD"
    if kind == "date":
        return f"DATE'{v if isinstance(v, date) else date.fromisoformat(v)}'"
    if kind == "timestamp":
        return f"TIMESTAMP_NTZ'{v if isinstance(v, datetime) else datetime.fromisoformat(v)}'"
    return _text(v)


def _condition(p: Predicate, d: Dimension) -> str:
    col = _name(d.column)
    if p.op == "is_null":
        return f"{col} IS {'' if p.values[0] else 'NOT '}NULL"
    if p.op in ("like", "ilike"):
        subject = col if p.op == "like" else f"lower({col})"
        return "(" + " OR ".join(f"{subject} LIKE {_text(v if p.op == 'like' else v.lower())} ESCAPE '\\\\'" for v in p.values) + ")"
    if p.op in ("in", "not_in"):
        return f"{col} {'NOT ' * (p.op == 'not_in')}IN ({', '.join(_value(v, d) for v in p.values)})"
    return f"{col} {_SIGNS[p.op]} {_value(p.values[0], d)}"


def _aggregate(m: MetricSpec, where: str | None) -> str:
    x = m.expr or "1"
    if m.agg == "sum_boolean":
        x = f"CASE WHEN {x} THEN 1 ELSE 0 END"
    if where:
        x = f"CASE WHEN {where} THEN {x} END"
    f = {"sum_boolean": "sum", "average": "avg", "count_distinct": "count"}.get(m.agg or "sum", m.agg or "sum")
    return f"{f}({'DISTINCT ' * (m.agg == 'count_distinct')}{x})"


def sql_of(p: QueryPlan, table: str) -> str:
    """The statement that execute() runs as DataFrame operations: filters, edge dates, one aggregation, order, limit."""
    where = "".join(f"\n  {'AND' if i else 'WHERE'} ({' OR '.join(_condition(x, d) for x, d in clause)})" for i, clause in enumerate(p.filters))
    ctes = [f"asked AS (\n  SELECT * FROM {table}{where}\n)"]
    stocks = {m.name: (m.semi_additive["over"], m.semi_additive["rule"]) for m in p._parts.values() if m.semi_additive}
    joins, at = "", {}
    for i, over in enumerate(sorted({o for o, _ in stocks.values()})):
        buckets = [d.column for d in p.dimensions if d.source == over]
        rules = [r for r in ("last", "first") if (over, r) in stocks.values()]
        picks = [f"{'max' if r == 'last' else 'min'}({_name(over)}) AS edge_{r}" for r in rules]
        ctes.append(f"edge_{i} AS (\n  SELECT {', '.join([*map(_name, buckets), *picks])} FROM asked" + (f" GROUP BY {', '.join(map(_name, buckets))}" if buckets else "") + "\n)")
        on = " AND ".join(f"asked.{_name(b)} <=> edge_{i}.{_name(b)}" for b in buckets)
        joins += f" LEFT JOIN edge_{i} ON {on}" if buckets else f" CROSS JOIN edge_{i}"
        at |= {(over, r): f"asked.{_name(over)} = edge_{i}.edge_{r}" for r in rules}
    only = f" WHERE {' OR '.join(at.values())}" if stocks and len(stocks) == len(p._parts) else ""
    by = [d.column for d in p.dimensions]
    cols = [f"asked.{_name(b)}" for b in by] + [f"{_aggregate(m, at[stocks[m.name]] if m.name in stocks else None)} AS {_name('m_' + m.name)}" for m in p._parts.values()]
    ctes.append(f"summed AS (\n  SELECT {', '.join(cols)} FROM asked{joins}{only}" + (f" GROUP BY {', '.join(f'asked.{_name(b)}' for b in by)}" if by else "") + "\n)")
    out = [_name(b) for b in by]
    for m in p.metrics:
        value = _name("m_" + m.name)
        if m.ratio:
            num, den = (f"CAST({_name('m_' + m.ratio[k])} AS DECIMAL(38,9))" for k in ("numerator", "denominator"))
            value = f"{num} / nullif({den}, CAST(0 AS DECIMAL(38,9)))"
        out.append(f"CAST({value} AS {p.columns[m.name].spark.simpleString()}) AS {_name(m.name)}")
    named = {n: d.column for n, d in zip(p.request.dimensions, p.dimensions)}
    order = ", ".join(f"{_name(named.get(o.field, o.field))} {'ASC NULLS FIRST' if o.direction == 'asc' else 'DESC NULLS LAST'}" for o in p.request.order_by)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {', '.join(out)} FROM summed" + (f"\nORDER BY {order}" if order else "") + (f"\nLIMIT {p.limit}" if p.limit is not None else "")
