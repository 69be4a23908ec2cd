"""Typed transforms: the whitelist that mapping chains are made of, as Column builders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgrain.errors import ChainTypeError, SpecError, TransformRegistration, Unsupported, UnknownTransform, nearest
from sparkgrain.functions.types import BOOL, DATE, INT, STRING, TIMESTAMP, VARIANT, Logical, assignable, decimal

#: Texts that a Spark cast would read off the clock, or as an epoch; they must not become dates.
CLOCK_WORDS = ("now", "today", "tomorrow", "yesterday", "epoch")


@dataclass(frozen=True)
class Transform:
    """build(column, its type, lenient, *args); out(type, *args) checks arguments and gives the result's type."""

    name: str
    domain: tuple[str, ...]
    least: int
    most: int | None
    out: Callable[..., Logical]
    build: Callable[..., Column]
    nullifies: bool = False


_REGISTRY: dict[str, Transform] = {}


def register_transform(t: Transform) -> None:
    """Add a transform to the whitelist; a name is taken once."""
    if t.name in _REGISTRY:
        raise TransformRegistration(f"transform {t.name!r} exists")
    if not t.name.isidentifier() or not t.domain:
        raise TransformRegistration(f"transform {t.name!r} needs a plain name and a domain")
    _REGISTRY[t.name] = t


def known_transforms() -> dict[str, Transform]:
    return dict(_REGISTRY)


def cast(col: Column, to: Logical, lenient: bool) -> Column:
    """A cast that fails loudly, or gives null; dates and times never come from the clock."""
    if to not in (TIMESTAMP, DATE):
        return col.try_cast(to.spark) if lenient else col.cast(to.spark)
    kind = "timestamp_ltz" if to == TIMESTAMP else "date"
    got = (col.try_cast(kind) if lenient else col.cast(kind)).cast(to.spark)
    clock = F.lower(F.trim(col.cast("string"))).isin(*CLOCK_WORDS)
    if lenient:
        return F.when(~clock, got)
    return F.when(clock, F.raise_error(F.concat(F.lit("[CAST_INVALID_INPUT] no date or time: "), col.cast("string")))).otherwise(got)


def _add(name: str, domain: tuple[str, ...], out: Callable[..., Logical] | Logical, build: Callable[..., Column], least: int = 0, most: int | None = 0, nullifies: bool = False) -> None:
    register_transform(Transform(name, domain, least, most, out if callable(out) else (lambda t, *a, o=out: o), build, nullifies))


def _same(t: Logical, *args) -> Logical:
    return t


def _text(*which: int) -> Callable[..., Logical]:
    def out(t: Logical, *args) -> Logical:
        for i in which:
            if not isinstance(args[i], str):
                raise ChainTypeError(f"argument {i + 1} must be text, not {args[i]!r}")
        return STRING

    return out


def _number(x: object) -> Decimal:
    try:
        if isinstance(x, bool):
            raise InvalidOperation
        d = Decimal(str(x))
        if not d.is_finite():
            raise InvalidOperation
        return d
    except InvalidOperation:
        raise ChainTypeError(f"{x!r} is no number") from None


def _split_out(t: Logical, *args) -> Logical:
    if not isinstance(args[0], str) or not args[0] or isinstance(args[1], bool) or not isinstance(args[1], int) or args[1] < 1:
        raise ChainTypeError("split_part takes a delimiter and a place from 1")
    return STRING


def _regex_out(t: Logical, *args) -> Logical:
    if not isinstance(args[0], str) or (len(args) > 1 and (isinstance(args[1], bool) or not isinstance(args[1], int) or args[1] < 0)):
        raise ChainTypeError("regex_extract takes a pattern and a group")
    return STRING


def _enum_out(t: Logical, *args) -> Logical:
    if len(args) % 2 or not all(isinstance(a, str) for a in args):
        raise ChainTypeError("enum_map takes pairs of texts")
    return STRING


def _enum(col: Column, t: Logical, lenient: bool, *args: str) -> Column:
    out = None
    for a, b in zip(args[::2], args[1::2]):
        out = F.when(col == a, b) if out is None else out.when(col == a, b)
    return out.otherwise(col)


def _decimal_out(t: Logical, *args) -> Logical:
    if any(isinstance(a, bool) or not isinstance(a, int) for a in args):
        raise ChainTypeError("to_decimal takes a precision and a scale")
    return decimal(*args)


def _suffix(col: Column, s: str) -> Column:
    return F.when(F.endswith(col, F.lit(s)), F.left(col, F.length(col) - len(s))).otherwise(col) if s else col


#: strftime directives in Java's letters.
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "b": "MMM", "B": "MMMM", "p": "a", "I": "hh", "j": "DDD", "z": "XX", "%": "%"}


def java_pattern(fmt: str) -> str:
    """A strftime format in Java's pattern letters."""
    out, i, quoted = "", 0, ""
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            if i + 1 >= len(fmt) or fmt[i + 1] not in _STRFTIME:
                raise ChainTypeError(f"format {fmt!r} has an unknown directive")
            if quoted:
                out, quoted = out + f"'{quoted}'", ""
            out += _STRFTIME[fmt[i + 1]]
            i += 2
            continue
        if ch.isalpha():
            quoted += ch
        else:
            if quoted:
                out, quoted = out + f"'{quoted}'", ""
            out += "''" if ch == "'" else ch
        i += 1
    return out + (f"'{quoted}'" if quoted else "")


def _fmt_out(o: Logical) -> Callable[..., Logical]:
    def out(t: Logical, *args) -> Logical:
        if not isinstance(args[0], str):
            raise ChainTypeError("a format is text")
        if args[0] != "ISO8601":
            java_pattern(args[0])
        return o

    return out


def _parse_ts(col: Column, t: Logical, lenient: bool, fmt: str) -> Column:
    if fmt == "ISO8601":
        return cast(col, TIMESTAMP, lenient)
    p = F.lit(java_pattern(fmt))
    return (F.try_to_timestamp(col, p) if lenient else F.to_timestamp(col, java_pattern(fmt))).cast("timestamp_ntz")


def _parse_date(col: Column, t: Logical, lenient: bool, fmt: str) -> Column:
    return cast(col, DATE, lenient) if fmt == "ISO8601" else _parse_ts(col, t, lenient, fmt).cast("date")


def _literal(v: object, t: Logical) -> Column:
    return cast(F.lit(str(v) if t.name == "decimal" else v), t, False)


def _literal_out(t: Logical, v: object) -> Logical:
    ok = {"string": isinstance(v, str), "int": isinstance(v, int) and not isinstance(v, bool), "bool": isinstance(v, bool), "decimal": isinstance(v, (int, float, str, Decimal)) and not isinstance(v, bool)}.get(t.name, isinstance(v, str))
    if not ok:
        raise ChainTypeError(f"{v!r} is no {t}")
    if t.name == "decimal":
        _number(v)
    return t


def _product(t: Logical, n: object) -> Logical:
    d = _number(n)
    scale = max(0, -d.as_tuple().exponent)
    digits = max(len(d.as_tuple().digits), scale, 1)
    return decimal(min(38, t.precision + digits), min(t.scale + scale, min(38, t.precision + digits)))


def _quotient(t: Logical, n: object) -> Logical:
    if _number(n) == 0:
        raise ChainTypeError("division by zero")
    return _product(t, n)


def _operand(n: object) -> Column:
    return F.expr(f"{_number(n):f}BD")


def _round_out(t: Logical, d: object = 0) -> Logical:
    if isinstance(d, bool) or not isinstance(d, int) or d < 0:
        raise ChainTypeError("round takes a number of places from 0")
    return t if t == INT else decimal(min(38, t.precision - t.scale + min(d, t.scale) + 1), min(d, t.scale))


def _refuse_convert(*_):
    raise Unsupported("currency conversion needs rates that vary in time; it is refused")


_S, _ANY = ("string",), ("string", "int", "decimal", "bool", "date", "timestamp", "variant")
_add("trim", _S, STRING, lambda c, t, l: F.trim(c))
_add("upper", _S, STRING, lambda c, t, l: F.upper(c))
_add("lower", _S, STRING, lambda c, t, l: F.lower(c))
_add("split_part", _S, _split_out, lambda c, t, l, d, n: F.split_part(c, F.lit(d), F.lit(n)), 2, 2, nullifies=True)
_add("regex_extract", _S, _regex_out, lambda c, t, l, p, g=0: F.regexp_extract(c, p, g), 1, 2, nullifies=True)
_add("strip_prefix", _S, _text(0), lambda c, t, l, s: F.when(F.startswith(c, F.lit(s)), F.substring(c, len(s) + 1, 1 << 30)).otherwise(c), 1, 1)
_add("strip_suffix", _S, _text(0), lambda c, t, l, s: _suffix(c, s), 1, 1)
_add("concat", _S, _text(0), lambda c, t, l, s: F.concat(c, F.lit(s)), 1, 1)
_add("enum_map", _S, _enum_out, _enum, 2, None)
_add("to_string", _ANY, STRING, lambda c, t, l: c.cast("string"))
_add("to_int", ("string", "int", "decimal", "bool"), INT, lambda c, t, l: cast(c, INT, l))
_add("to_decimal", ("string", "int", "decimal"), _decimal_out, lambda c, t, l, p, s: cast(c, decimal(p, s), l), 2, 2)
_add("to_bool", ("string", "int", "bool"), BOOL, lambda c, t, l: c != 0 if t == INT else cast(c, BOOL, l))
_add("parse_ts", _S, _fmt_out(TIMESTAMP), _parse_ts, 1, 1)
_add("parse_date", _S, _fmt_out(DATE), _parse_date, 1, 1)
_add("to_utc", ("timestamp",), lambda t, z: _text(0)(t, z) and TIMESTAMP, lambda c, t, l, z: F.convert_timezone(F.lit(z), F.lit("UTC"), c), 1, 1)
_add("coalesce", _ANY, _literal_out, lambda c, t, l, v: F.coalesce(c, _literal(v, t)), 1, 1)
_add("nullif", _ANY, _literal_out, lambda c, t, l, v: F.nullif(c, _literal(v, t)), 1, 1, nullifies=True)
_add("json_path", ("string", "variant"), lambda t, p: _text(0)(t, p) and VARIANT, lambda c, t, l, p: F.get_json_object(c, p), 1, 1, nullifies=True)
_add("multiply", ("decimal",), _product, lambda c, t, l, n: (c * _operand(n)).cast(_product(t, n).spark), 1, 1)
_add("divide", ("decimal",), _quotient, lambda c, t, l, n: (c / _operand(n)).cast(_quotient(t, n).spark), 1, 1)
_add("round", ("int", "decimal"), _round_out, lambda c, t, l, d=0: F.round(c, d).cast(_round_out(t, d).spark), 0, 1)
_add("abs", ("int", "decimal"), _same, lambda c, t, l: F.abs(c).cast(t.spark))
_add("convert", ("decimal",), _refuse_convert, _refuse_convert, 1, 1)


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()


def parse_step(raw: object, at: str) -> Step:
    """A transform as a bare name, or as one name with its argument or arguments."""
    if isinstance(raw, str):
        return Step(raw)
    if isinstance(raw, dict) and len(raw) == 1:
        (name, args), = raw.items()
        return Step(str(name), tuple(args) if isinstance(args, list) else tuple(x for kv in args.items() for x in kv) if isinstance(args, dict) else (args,))
    raise ChainTypeError(f"{raw!r} is no transform", at)


def check_chain(steps: list[Step], to: Logical, at: str = "", start: Logical = STRING) -> Logical:
    """The type that a chain ends in; it must be assignable to the declared one."""
    t = start
    for s in steps:
        tr = _REGISTRY.get(s.name)
        if not tr:
            raise UnknownTransform(f"no transform {s.name!r}{nearest(s.name, _REGISTRY)}", at)
        if t.name not in tr.domain:
            raise ChainTypeError(f"{s.name} takes {' or '.join(tr.domain)}, not {t}", at)
        if len(s.args) < tr.least or (tr.most is not None and len(s.args) > tr.most):
            raise ChainTypeError(f"{s.name} takes {tr.least} to {tr.most} arguments, not {len(s.args)}", at)
        try:
            t = tr.out(t, *s.args)
        except SpecError as e:
            raise type(e)(str(e), at) from None
    if steps and not assignable(t, to):
        raise ChainTypeError(f"the chain ends in {t}, the field is {to}", at)
    return t


def apply_chain(col: Column, steps: list[Step], to: Logical, lenient: bool, start: Logical = STRING) -> Column:
    """The chain over a column, cast to the declared type."""
    t = start
    for s in steps:
        tr = _REGISTRY[s.name]
        col, t = tr.build(col, t, lenient, *s.args), tr.out(t, *s.args)
    return col if steps and t == to else cast(col, to, lenient)


def nullifying(steps: list[Step]) -> bool:
    return any(_REGISTRY[s.name].nullifies for s in steps if s.name in _REGISTRY)


def enum_targets(steps: list[Step]) -> list[str] | None:
    """The texts an enum_map ends in, if the chain ends in one (or in to_string after it)."""
    out: list[str] | None = None
    for s in steps:
        if s.name == "enum_map":
            out = list(s.args[1::2])
        elif s.name != "to_string":
            out = None
    return out
