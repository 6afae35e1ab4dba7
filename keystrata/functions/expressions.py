"""A small expression language whose values are portable filter trees (plain dicts)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from typing import Any

from keystrata.functions.predicates import INVERSE

Node = dict[str, Any]
LOGICAL, CONDITION = 0, 1
AND, OR = 0, 1
CONSTANT = "__constant"


def condition(name: str, operation: str, value: Any = None, case_sensitive: bool = False) -> Node:
    return {"nodeType": CONDITION, "condition": {"property": name, "operation": operation, "value": value, "isString": isinstance(value, str), "caseSensitive": case_sensitive}}


def logical(operator: int, children: list[Node]) -> Node:
    return {"nodeType": LOGICAL, "operator": operator, "children": children}


def constant(value: bool) -> Node:
    return condition(CONSTANT, "Equal", value)


def negate(node: Node) -> Node:
    """NOT, pushed to the leaves, where each operation has an inverse with its own null rule."""
    if is_logical(node):
        return logical(OR if is_and(node) else AND, [negate(x) for x in node["children"]])
    c = node["condition"]
    if c["property"] == CONSTANT:
        return constant(not c["value"])
    if c["operation"] == "In":
        return logical(AND, [condition(c["property"], "NotEqual", v) for v in c["value"]]) if c["value"] else constant(True)
    if c["operation"] not in INVERSE:
        raise ValueError(f"{c['operation']} can't be negated")
    return {"nodeType": CONDITION, "condition": c | {"operation": INVERSE[c["operation"]]}}


def is_logical(node: Node) -> bool:
    kind = node.get("nodeType", CONDITION)
    return kind == LOGICAL or (isinstance(kind, str) and kind.lower() in ("logical", "0"))


def is_and(node: Node) -> bool:
    kind = node.get("operator", AND)
    return kind == AND or (isinstance(kind, str) and kind.lower() in ("and", "0"))


class Predicate:
    """A filter tree with ``&``, ``|`` and ``~``."""

    def __init__(self, node: Node) -> None:
        self.node = node

    def __and__(self, other: Any) -> Predicate:
        return Predicate(logical(AND, [self.node, as_node(other)]))

    def __or__(self, other: Any) -> Predicate:
        return Predicate(logical(OR, [self.node, as_node(other)]))

    def __rand__(self, other: Any) -> Predicate:
        return Predicate(logical(AND, [as_node(other), self.node]))

    def __ror__(self, other: Any) -> Predicate:
        return Predicate(logical(OR, [as_node(other), self.node]))

    def __invert__(self) -> Predicate:
        return Predicate(negate(self.node))

    def __bool__(self) -> bool:
        raise TypeError("combine predicates with & | ~, not with and, or, not")


class _Comparable:
    """Comparison operators over a family of operation names."""

    __hash__ = None  # type: ignore[assignment]

    def _compare(self, operation: str, value: Any) -> Predicate:
        raise NotImplementedError

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return self._compare("Equal", value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return self._compare("NotEqual", value)

    def __gt__(self, value: Any) -> Predicate:
        return self._compare("GreaterThan", value)

    def __ge__(self, value: Any) -> Predicate:
        return self._compare("GreaterThanOrEqual", value)

    def __lt__(self, value: Any) -> Predicate:
        return self._compare("LessThan", value)

    def __le__(self, value: Any) -> Predicate:
        return self._compare("LessThanOrEqual", value)


class _Part(_Comparable):
    """A calendar part or the length of a field."""

    def __init__(self, name: str, part: str) -> None:
        self.name, self.part = name, part

    def _compare(self, operation: str, value: Any) -> Predicate:
        return Predicate(condition(self.name, f"Not{self.part}Equal" if operation == "NotEqual" else self.part + operation, int(value)))


class _Date(_Comparable):
    """The calendar day of a timestamp, compared through ranges of the timestamp itself."""

    def __init__(self, name: str) -> None:
        self.name = name

    def _compare(self, operation: str, value: Any) -> Predicate:
        day = value.date() if isinstance(value, dt.datetime) else dt.date.fromisoformat(value[:10]) if isinstance(value, str) else value
        start, after = day.isoformat(), (day + dt.timedelta(days=1)).isoformat()
        leaf = lambda op, v: condition(self.name, op, v)
        if operation == "Equal":
            return Predicate(logical(AND, [leaf("GreaterThanOrEqual", start), leaf("LessThan", after)]))
        if operation == "NotEqual":
            return Predicate(logical(OR, [leaf("LessThan", start), leaf("GreaterThanOrEqual", after), leaf("IsNull", None)]))
        return Predicate({"LessThan": leaf("LessThan", start), "LessThanOrEqual": leaf("LessThan", after), "GreaterThan": leaf("GreaterThanOrEqual", after), "GreaterThanOrEqual": leaf("GreaterThanOrEqual", start)}[operation])


class Field(_Comparable):
    """A named column in a predicate."""

    def __init__(self, name: str) -> None:
        self.name = name

    def _compare(self, operation: str, value: Any) -> Predicate:
        if isinstance(value, (Field, _Part, _Date)):
            raise TypeError("a field is compared with a value, not with another field")
        return Predicate(condition(self.name, operation, value))

    def _leaf(self, operation: str, value: Any = None, case_sensitive: bool = False) -> Predicate:
        return Predicate(condition(self.name, operation, value, case_sensitive))

    def starts_with(self, value: str, ignore_case: bool = False) -> Predicate:
        return self._leaf("StartsWith", value, not ignore_case)

    def ends_with(self, value: str, ignore_case: bool = False) -> Predicate:
        return self._leaf("EndsWith", value, not ignore_case)

    def contains(self, value: str, ignore_case: bool = False) -> Predicate:
        return self._leaf("Contains", value, not ignore_case)

    def equals(self, value: str, ignore_case: bool = False) -> Predicate:
        return self._leaf("StringEquals", value, not ignore_case)

    def is_in(self, values: Iterable[Any]) -> Predicate:
        return self._leaf("In", list(values))

    def is_in_ignoring_case(self, values: Iterable[str]) -> Predicate:
        return any_of(values, lambda v: self.equals(v, ignore_case=True))

    def none_of(self, values: Iterable[Any]) -> Predicate:
        return all_of(values, lambda v: self != v)

    def starts_with_any_of(self, values: Iterable[str], ignore_case: bool = False) -> Predicate:
        return any_of(values, lambda v: self.starts_with(v, ignore_case))

    def between(self, low: Any, high: Any, include_low: bool = True, include_high: bool = False) -> Predicate:
        return (self >= low if include_low else self > low) & (self <= high if include_high else self < high)

    def in_any_range(self, ranges: Iterable[tuple[Any, Any]], include_low: bool = True, include_high: bool = False) -> Predicate:
        return any_of(ranges, lambda r: self.between(*r, include_low, include_high))

    def has(self, value: Any) -> Predicate:
        return self._leaf("ArrayContains", value)

    def is_null(self) -> Predicate:
        return self._leaf("IsNull")

    def is_not_null(self) -> Predicate:
        return self._leaf("IsNotNull")

    def type_of(self, kind: str) -> Predicate:
        return self._leaf(f"TypeOf{kind}")

    def is_true(self) -> Predicate:
        return self._leaf("Equal", True)

    @property
    def date(self) -> _Date:
        return _Date(self.name)

    def __getattr__(self, part: str) -> _Part:
        names = {"length": "Length", "year": "Year", "month": "Month", "day": "Day", "day_of_year": "DayOfYear", "day_of_week": "DayOfWeek"}
        if part not in names:
            raise AttributeError(part)
        return _Part(self.name, names[part])


def field(name: str) -> Field:
    return Field(name)


def as_node(x: Any) -> Node:
    """A predicate, a bool, a field that stands for "is true", a raw tree, or attributes with the values they all must have."""
    if isinstance(x, Predicate):
        return x.node
    if isinstance(x, bool):
        return constant(x)
    if isinstance(x, Field):
        return x.is_true().node
    if isinstance(x, dict) and not {"nodeType", "condition", "children"} & set(x):
        return all_of(x.items(), lambda pair: field(pair[0]) == pair[1]).node
    if isinstance(x, dict):
        return x
    raise TypeError(f"not a predicate: {x!r}")


def any_of(values: Iterable[Any], test: Callable[[Any], Predicate]) -> Predicate:
    """The OR of a test over a collection; of an empty one, false."""
    return _fold(values, test, any_=True)


def all_of(values: Iterable[Any], test: Callable[[Any], Predicate]) -> Predicate:
    """The AND of a test over a collection; of an empty one, true."""
    return _fold(values, test, any_=False)


def _fold(values: Iterable[Any], test: Callable[[Any], Predicate], any_: bool) -> Predicate:
    nodes = [as_node(test(v)) for v in values]
    if not nodes:
        return Predicate(constant(not any_))
    return Predicate(logical(OR if any_ else AND, nodes)) if len(nodes) > 1 else Predicate(nodes[0])
