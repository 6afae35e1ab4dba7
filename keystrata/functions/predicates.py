"""Every leaf predicate, as a function of a column, a value and flags that returns a Column.

Null rules: a comparison with null drops the row, except that "not equal" keeps rows whose value is
null. Calendar parts and negated string tests drop nulls. Nothing here negates a nullable test.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Operand:
    """The column side of a condition."""

    column: Column
    kind: T.DataType

    def literal(self, value: Any) -> Column:
        """The value in the column's own type where it has to be parsed, so that filters reach the scan."""
        if isinstance(value, str) and isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.lit(value).cast(self.kind)
        if isinstance(value, dt.datetime) and isinstance(self.kind, T.TimestampNTZType):
            return F.lit(value.isoformat(sep=" ")).cast(self.kind)
        if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            return F.lit(value.isoformat()).cast(self.kind if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)) else T.DateType())
        return F.lit(value)


Test = Callable[[Operand, Any, bool], Column]

COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "Equal": lambda c, v: c == v,
    "GreaterThan": lambda c, v: c > v,
    "GreaterThanOrEqual": lambda c, v: c >= v,
    "LessThan": lambda c, v: c < v,
    "LessThanOrEqual": lambda c, v: c <= v,
}


def _equal(x: Operand, v: Any, _: bool) -> Column:
    return x.column.isNull() if v is None else x.column == x.literal(v)


def _not_equal(x: Operand, v: Any, _: bool) -> Column:
    return x.column.isNotNull() if v is None else ~x.column.eqNullSafe(x.literal(v))


def _is_in(x: Operand, values: Any, _: bool) -> Column:
    known = [v for v in values if v is not None]
    test = x.column.isin([x.literal(v) for v in known]) if known else F.lit(False)
    return test | x.column.isNull() if len(known) < len(values) else test


def _ordered(op: str) -> Test:
    return lambda x, v, _: COMPARE[op](x.column, x.literal(v))


def _text(test: Callable[[Column, Any], Column], negated: bool = False) -> Test:
    def apply(x: Operand, v: Any, case_sensitive: bool) -> Column:
        found = test(x.column, v) if case_sensitive else test(F.lower(x.column), str(v).lower())
        return ~found if negated else found

    return apply


def _string_equals(x: Operand, v: Any, case_sensitive: bool) -> Column:
    if v is None or case_sensitive or not isinstance(x.kind, T.StringType):
        return _equal(x, v, True)
    return F.lower(x.column) == str(v).lower()


def _not_string_equals(x: Operand, v: Any, case_sensitive: bool) -> Column:
    if v is None or case_sensitive or not isinstance(x.kind, T.StringType):
        return _not_equal(x, v, True)
    return ~F.lower(x.column).eqNullSafe(F.lit(str(v).lower()))


def _length(op: str) -> Test:
    def apply(x: Operand, v: Any, _: bool) -> Column:
        size = F.size(x.column) if isinstance(x.kind, T.ArrayType) else F.length(x.column)
        size = F.when(x.column.isNotNull(), size)
        return size != v if op == "NotEqual" else COMPARE[op](size, v)

    return apply


def _year(op: str) -> Test:
    """A year comparison as a range of the raw column, which the Parquet reader can use."""

    def apply(x: Operand, v: Any, _: bool) -> Column:
        first, after = (x.literal(dt.date(int(v) + k, 1, 1)) for k in (0, 1))
        c = x.column
        return {
            "Equal": lambda: (c >= first) & (c < after),
            "NotEqual": lambda: (c < first) | (c >= after),
            "GreaterThan": lambda: c >= after,
            "GreaterThanOrEqual": lambda: c >= first,
            "LessThan": lambda: c < first,
            "LessThanOrEqual": lambda: c < after,
        }[op]()

    return apply


def _part(part: Callable[[Column], Column], op: str) -> Test:
    return lambda x, v, _: part(x.column) != int(v) if op == "NotEqual" else COMPARE[op](part(x.column), int(v))


#: Sunday is 0, as in the application's enumeration; Spark counts from 1.
PARTS: dict[str, Callable[[Column], Column]] = {
    "Month": F.month,
    "Day": F.dayofmonth,
    "DayOfYear": F.dayofyear,
    "DayOfWeek": lambda c: F.dayofweek(c) - 1,
}

#: A stored type decides a type test; no stored type is a file.
KINDS: dict[str, tuple[type, ...]] = {
    "Number": (T.NumericType,),
    "String": (T.StringType,),
    "Date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "Array": (T.ArrayType,),
    "Object": (T.StructType,),
    "Blob": (T.BinaryType,),
    "ArrayBuffer": (T.BinaryType,),
    "File": (),
}


def _kind(kinds: tuple[type, ...], negated: bool) -> Test:
    def apply(x: Operand, _v: Any, _: bool) -> Column:
        match = isinstance(x.kind, kinds)
        if negated:
            return x.column.isNull() if match else F.lit(True)
        return x.column.isNotNull() if match else F.lit(False)

    return apply


def _operations() -> dict[str, Test]:
    out: dict[str, Test] = {
        "Equal": _equal,
        "NotEqual": _not_equal,
        "NotEquals": _not_string_equals,
        "StringEquals": _string_equals,
        "In": _is_in,
        "IsNull": lambda x, _v, _: x.column.isNull(),
        "IsNotNull": lambda x, _v, _: x.column.isNotNull(),
        "StartsWith": _text(lambda c, v: c.startswith(v)),
        "EndsWith": _text(lambda c, v: c.endswith(v)),
        "Contains": _text(lambda c, v: c.contains(v)),
        "NotStartsWith": _text(lambda c, v: c.startswith(v), negated=True),
        "NotEndsWith": _text(lambda c, v: c.endswith(v), negated=True),
        "NotContains": _text(lambda c, v: c.contains(v), negated=True),
        "ArrayContains": lambda x, v, _: F.array_contains(x.column, v),
    }
    orders = ["GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"]
    out |= {op: _ordered(op) for op in orders}
    for op in ["Equal", "NotEqual", *orders]:
        named = lambda part, op=op: f"Not{part}Equal" if op == "NotEqual" else part + op
        out[named("Length")] = _length(op)
        out[named("Year")] = _year(op)
        for part, f in PARTS.items():
            out[named(part)] = _part(f, op)
    for name, kinds in KINDS.items():
        out[f"TypeOf{name}"] = _kind(kinds, negated=False)
        out[f"NotTypeOf{name}"] = _kind(kinds, negated=True)
    return out


OPERATIONS: dict[str, Test] = _operations()

#: What each operation becomes under NOT. An ordering test on null stays unmatched.
INVERSE: dict[str, str] = {
    "Equal": "NotEqual",
    "NotEqual": "Equal",
    "GreaterThan": "LessThanOrEqual",
    "LessThanOrEqual": "GreaterThan",
    "LessThan": "GreaterThanOrEqual",
    "GreaterThanOrEqual": "LessThan",
    "StringEquals": "NotEquals",
    "NotEquals": "StringEquals",
    "IsNull": "IsNotNull",
    "IsNotNull": "IsNull",
    "Contains": "NotContains",
    "NotContains": "Contains",
    "StartsWith": "NotStartsWith",
    "NotStartsWith": "StartsWith",
    "EndsWith": "NotEndsWith",
    "NotEndsWith": "EndsWith",
}
for _part_name in ["Length", "Year", *PARTS]:
    INVERSE |= {f"{_part_name}Equal": f"Not{_part_name}Equal", f"Not{_part_name}Equal": f"{_part_name}Equal"}
    INVERSE |= {_part_name + a: _part_name + b for a, b in list(INVERSE.items()) if a in ("GreaterThan", "LessThanOrEqual", "LessThan", "GreaterThanOrEqual")}
for _kind_name in KINDS:
    INVERSE |= {f"TypeOf{_kind_name}": f"NotTypeOf{_kind_name}", f"NotTypeOf{_kind_name}": f"TypeOf{_kind_name}"}
