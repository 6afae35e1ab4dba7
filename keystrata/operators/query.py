"""The fluent query: immutable, lazy, one DataFrame at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from keystrata.functions.expressions import AND, Field, Node, as_node, logical
from keystrata.plans.additions import Shape, apply_shape, rows_before
from keystrata.plans.filters import columns_in_order, compile_filter
from keystrata.schema import TableDef
from keystrata.streaming.rows import iterate

#: What may follow each stage when ``strict`` is on.
GRAMMAR: dict[str, frozenset[str]] = {
    "table": frozenset({"where", "cursor", "take", "takeLast", "skip", "order", "single", "singleWhere"}),
    "where": frozenset({"where", "take", "takeLast", "skip", "single"}),
    "order": frozenset({"take", "takeLast", "skip", "single", "singleWhere", "filterAfter"}),
    "take": frozenset({"skip", "filterAfter"}),
    "takeLast": frozenset({"filterAfter"}),
    "skip": frozenset({"filterAfter"}),
    "cursor": frozenset({"cursor", "take", "takeLast", "skip", "order", "stable", "single"}),
    "cursorOrder": frozenset({"take", "takeLast", "skip", "single"}),
    "cursorTake": frozenset({"skip", "single"}),
    "cursorSkip": frozenset({"single"}),
    "end": frozenset(),
}


def _next(stage: str, step: str) -> str:
    if stage.startswith("cursor"):
        return {"cursor": "cursor", "order": "cursorOrder", "stable": "cursorOrder", "take": "cursorTake", "takeLast": "cursorTake", "skip": "cursorSkip"}.get(step, "end")
    return {"where": "where", "cursor": "cursor", "order": "order", "take": "take", "takeLast": "takeLast", "skip": "skip"}.get(step, "end")


@dataclass(frozen=True)
class Query:
    """Rows of one table.

    Steps may come in any order and have one meaning each; ``strict=True`` admits only the typed grammar.
    ``tie_break`` decides how equal rows of a descending order follow: by descending key ("same") or
    by ascending key ("asc").
    """

    table: TableDef
    source: Callable[[], DataFrame]
    predicates: tuple[Node, ...] = ()
    shape: Shape = Shape()
    forced_cursor: bool = False
    strict: bool = False
    tie_break: str = "same"
    stage: str = "table"

    # steps
    def _step(self, step: str, **changes: Any) -> Query:
        if self.strict and step not in GRAMMAR[self.stage]:
            raise ValueError(f"{step} can't follow {self.stage}")
        return replace(self, stage=_next(self.stage, step), **changes)

    def where(self, predicate: Any) -> Query:
        return self._step("where", predicates=(*self.predicates, as_node(predicate)))

    def cursor(self, predicate: Any = True) -> Query:
        return self._step("cursor", predicates=(*self.predicates, as_node(predicate)), forced_cursor=True)

    def order_by(self, column: str | Field) -> Query:
        return self._step("order", shape=self.shape.add("orderBy", column=_name(column)))

    def order_by_descending(self, column: str | Field) -> Query:
        return self._step("order", shape=self.shape.add("orderByDescending", column=_name(column)))

    def stable_ordering(self) -> Query:
        return self._step("stable", shape=self.shape.add("stableOrdering"))

    def take(self, n: int) -> Query:
        return self._step("take", shape=self.shape.add("take", n))

    def take_last(self, n: int) -> Query:
        return self._step("takeLast", shape=self.shape.add("takeLast", n))

    def skip(self, n: int) -> Query:
        return self._step("skip", shape=self.shape.add("skip", n))

    def additions(self, additions: Iterable[dict[str, Any]]) -> Query:
        return replace(self, shape=Shape.of(additions))

    # plans
    @property
    def node(self) -> Node | None:
        if not self.predicates:
            return None
        return self.predicates[0] if len(self.predicates) == 1 else logical(AND, list(self.predicates))

    def condition(self) -> Column | None:
        return reduce(lambda a, b: a & b, (compile_filter(x, self.table) for x in self.predicates)) if self.predicates else None

    def to_df(self) -> DataFrame:
        df, condition = self.source(), self.condition()
        mentioned = columns_in_order(self.node, self.table) if self.node else []
        df = df if condition is None else df.filter(condition)
        return apply_shape(df, self.table, self.shape, mentioned, self.tie_break)

    def first_df(self, predicate: Any = None) -> DataFrame:
        return self._single("first", predicate).to_df()

    def last_df(self, predicate: Any = None) -> DataFrame:
        return self._single("last", predicate).to_df()

    def _single(self, which: str, predicate: Any) -> Query:
        more = () if predicate is None else (as_node(predicate),)
        return self._step("singleWhere" if more else "single", predicates=(*self.predicates, *more), shape=self.shape.add(which))

    def filter_after(self, test: Column | Callable[[DataFrame], Column]) -> DataFrame:
        """A filter on what the window left: it never widens the window."""
        if self.strict and "filterAfter" not in GRAMMAR[self.stage]:
            raise ValueError(f"filterAfter can't follow {self.stage}")
        df = self.to_df()
        return df.filter(test(df) if callable(test) else test)

    def until(self, predicate: Any) -> DataFrame:
        """The rows of the result, in its order, before the first that meets the predicate."""
        mentioned = columns_in_order(self.node, self.table) if self.node else []
        return rows_before(self.to_df(), self.table, self.shape, mentioned, compile_filter(as_node(predicate), self.table), self.tie_break)

    def primary_keys(self) -> DataFrame:
        return self.to_df().select(*(F.col(f"`{c}`") for c in self.table.primary_key))

    def keys(self, column: str | Field, unique: bool = False) -> DataFrame:
        """The values of one column that aren't null, each row's or each once; of a multi-entry index, the elements."""
        name = self.table.column(_name(column))
        values = self.to_df().select(F.explode(f"`{name}`").alias(name) if name in self.table.multi_entry else F.col(f"`{name}`")).dropna()
        return values.distinct() if unique else values

    def get_many(self, keys: Iterable[tuple]) -> DataFrame:
        """The rows with these keys."""
        df = self.source()
        wanted = df.sparkSession.createDataFrame([tuple(k) for k in keys], ", ".join(f"`{c}` {self.table.schema[c].dataType.simpleString()}" for c in self.table.primary_key)).distinct()
        return df.join(wanted, list(self.table.primary_key), "left_semi")

    def count_df(self) -> DataFrame:
        """The size of the whole table, as one row."""
        return self.source().agg(F.count(F.lit(1)).alias("count"))

    # results
    def to_list(self) -> list[Row]:
        return self.to_df().collect()

    def rows(self) -> Iterator[Row]:
        return iterate(self.to_df())

    def first_or_default(self, predicate: Any = None) -> Row | None:
        return next(iter(self.first_df(predicate).collect()), None)

    def last_or_default(self, predicate: Any = None) -> Row | None:
        return next(iter(self.last_df(predicate).collect()), None)

    def count(self) -> int:
        return self.source().count()

    def get(self, *key: Any) -> Row | None:
        """The row with this key."""
        return self.by_key(*key).first_or_default()

    def by_key(self, *key: Any) -> Query:
        if len(key) != len(self.table.primary_key):
            raise ValueError(f"the key of {self.table.name} is {self.table.primary_key}")
        return replace(self, predicates=(*self.predicates, *(as_node(Field(c) == v) for c, v in zip(self.table.primary_key, key, strict=True))))


def _name(column: str | Field) -> str:
    return column.name if isinstance(column, Field) else column
