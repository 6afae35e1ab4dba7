"""Filter trees to Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions.expressions import CONSTANT, Node, is_and, is_logical
from keystrata.functions.predicates import OPERATIONS, Operand
from keystrata.schema import TableDef


def compile_filter(node: Node, table: TableDef) -> Column:
    """The tree as one Column. It stays as compact as it came: Catalyst factors and folds it."""
    if is_logical(node):
        parts = [compile_filter(x, table) for x in node.get("children") or []]
        if not parts:
            return F.lit(True)
        return reduce(lambda a, b: a & b if is_and(node) else a | b, parts)
    c = node["condition"]
    if c["property"] == CONSTANT:
        return F.lit(bool(c["value"]))
    if c["operation"] not in OPERATIONS:
        raise ValueError(f"unknown operation {c['operation']}")
    if c["property"] in table.not_mapped:
        return F.lit(False)
    if not table.has(c["property"]):
        raise ValueError(f"{table.name} has no column {c['property']}")
    name = table.column(c["property"])
    return OPERATIONS[c["operation"]](Operand(F.col(f"`{name}`"), table.data_type(c["property"])), c.get("value"), bool(c.get("caseSensitive")))


def columns_in_order(node: Node, table: TableDef) -> list[str]:
    """Stored columns that the tree names, by first appearance, left to right."""
    if is_logical(node):
        return list(dict.fromkeys(c for x in node.get("children") or [] for c in columns_in_order(x, table)))
    name = node["condition"]["property"]
    return [table.column(name)] if name != CONSTANT and table.has(name) else []
