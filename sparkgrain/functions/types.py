"""The seven logical types and what they are in Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from sparkgrain.errors import ParseError

_DECIMAL = re.compile(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)")
_PLAIN = {"string": T.StringType(), "int": T.LongType(), "bool": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "variant": T.StringType()}


@dataclass(frozen=True)
class Logical:
    """A logical type; precision and scale are set for decimals alone."""

    name: str
    precision: int = 0
    scale: int = 0

    def __str__(self) -> str:
        return f"decimal({self.precision},{self.scale})" if self.name == "decimal" else self.name

    @property
    def spark(self) -> T.DataType:
        """variant is held as JSON text, which can be grouped by."""
        return T.DecimalType(self.precision, self.scale) if self.name == "decimal" else _PLAIN[self.name]

    @property
    def numeric(self) -> bool:
        return self.name in ("int", "decimal")

    @property
    def temporal(self) -> bool:
        return self.name in ("date", "timestamp")


STRING, INT, BOOL, DATE, TIMESTAMP, VARIANT = (Logical(x) for x in ("string", "int", "bool", "date", "timestamp", "variant"))


def decimal(precision: int, scale: int, at: str = "") -> Logical:
    if not 1 <= precision <= 38 or not 0 <= scale <= precision:
        raise ParseError(f"decimal({precision},{scale}) is out of bounds", at)
    return Logical("decimal", precision, scale)


def parse_type(text: str, at: str = "") -> Logical:
    text = str(text).strip()
    if text in _PLAIN:
        return Logical(text)
    if m := _DECIMAL.fullmatch(text):
        return decimal(int(m[1]), int(m[2]), at)
    raise ParseError(f"no such type: {text!r}", at)


def assignable(src: Logical, to: Logical) -> bool:
    """Whether values go over unchanged: equal types, anything to variant, decimals that lose nothing."""
    if src == to or to == VARIANT:
        return True
    return src.name == to.name == "decimal" and to.scale >= src.scale and to.precision - to.scale >= src.precision - src.scale
