"""Ordering, windows and single rows: a list of additions becomes one normal form, and that a plan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.schema import TableDef

ADDITIONS = ("orderBy", "orderByDescending", "stableOrdering", "take", "takeLast", "skip", "first", "last")


@dataclass(frozen=True)
class Shape:
    """What is asked of the filtered rows. Skip is applied before take, whatever the call order."""

    order: str | None = None
    descending: bool = False
    stable: bool = False
    skip: int = 0
    take: int | None = None
    tail: int | None = None
    single: str | None = None

    def add(self, name: str, number: int = 0, column: str | None = None) -> Shape:
        if name in ("orderBy", "orderByDescending"):
            if self.order is not None:
                raise ValueError("only one ordering is possible")
            return replace(self, order=column, descending=name == "orderByDescending")
        if name == "stableOrdering":
            return replace(self, stable=True)
        if name in ("take", "takeLast", "skip") and number < 0:
            raise ValueError(f"{name} needs a number of rows that isn't negative")
        if name == "take":
            return replace(self, take=number if self.take is None else min(number, self.take))
        if name == "takeLast":
            return replace(self, tail=number if self.tail is None else min(number, self.tail))
        if name == "skip":
            return replace(self, skip=self.skip + number)
        if name in ("first", "last"):
            return replace(self, single=name)
        raise ValueError(f"unknown addition {name}")

    @classmethod
    def of(cls, additions: Iterable[dict[str, Any]]) -> Shape:
        """From the wire form: additionFunction, intValue, property."""
        out = cls()
        for x in additions:
            out = out.add(x["additionFunction"], int(x.get("intValue") or 0), x.get("property"))
        return out

    @property
    def windowed(self) -> bool:
        return bool(self.skip) or self.take is not None or self.tail is not None or self.single is not None


def sort_keys(table: TableDef, shape: Shape, mentioned: list[str], tie_break: str = "same") -> list[tuple[str, bool]]:
    """The effective order, as (column, descending). It always ends with the key, so it is total."""
    if shape.order is not None:
        keys = [(table.column(shape.order), shape.descending)]
        tie = shape.descending and tie_break == "same"
    else:
        keys = [] if shape.stable else [(c, False) for c in mentioned if c in table.indexed]
        tie = False
    seen = {c for c, _ in keys}
    return keys + [(c, tie) for c in table.primary_key if c not in seen]


def _columns(keys: list[tuple[str, bool]], flipped: bool = False) -> list[Column]:
    """Nulls are smallest: first in ascending order, last in descending."""
    return [F.col(f"`{c}`").desc_nulls_last() if d != flipped else F.col(f"`{c}`").asc_nulls_first() for c, d in keys]


def apply_shape(df: DataFrame, table: TableDef, shape: Shape, mentioned: list[str], tie_break: str = "same") -> DataFrame:
    """The rows asked for.

    Every bounded window plans as a top-k (no global sort). A skip without a bound would bring all rows
    to one task as OFFSET; here the skipped head is a top-k whose keys are anti-joined away.
    """
    if not shape.windowed and shape.order is None and not shape.stable:
        return df
    keys = sort_keys(table, shape, mentioned, tie_break)
    forward, backward = _columns(keys), _columns(keys, flipped=True)
    if shape.tail is not None:
        if shape.take is not None:
            raise ValueError("take and takeLast can't be combined")
        df = df.orderBy(*backward).limit(shape.tail).orderBy(*forward)
        if shape.skip:
            df = df.offset(shape.skip)
    elif shape.take is not None:
        df = df.orderBy(*forward).offset(shape.skip).limit(shape.take) if shape.skip else df.orderBy(*forward).limit(shape.take)
    elif shape.skip and shape.single == "first":
        df = df.orderBy(*forward).offset(shape.skip).limit(1)
    elif shape.skip:
        head = df.orderBy(*forward).limit(shape.skip).select(*(F.col(f"`{c}`").alias(f"__head_{i}") for i, c in enumerate(table.primary_key)))
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__head_{i}")) for i, c in enumerate(table.primary_key)]
        df = df.join(head, same, "left_anti")
        df = df if shape.single else df.orderBy(*forward)
    elif not shape.single:
        df = df.orderBy(*forward)
    if shape.single:
        df = df.orderBy(*(forward if shape.single == "first" else backward)).limit(1)
    return df


def not_before(keys: list[tuple[str, bool]], other: list[Column]) -> Column:
    """The row is at or after the other place in the order, nulls smallest."""
    after, same = F.lit(False), F.lit(True)
    for (name, down), there in zip(keys, other, strict=True):
        here = F.col(f"`{name}`")
        small, large = (here, there) if down else (there, here)
        above = F.coalesce(large > small, large.isNotNull() & small.isNull())
        after, same = after | (same & above), same & here.eqNullSafe(there)
    return after | same


def rows_before(df: DataFrame, table: TableDef, shape: Shape, mentioned: list[str], stop: Column, tie_break: str = "same") -> DataFrame:
    """In the effective order, the rows before the first that meets ``stop``. Only that row's keys are joined back."""
    keys = sort_keys(table, shape, mentioned, tie_break)
    first = df.filter(stop).orderBy(*_columns(keys)).limit(1).select(*(F.col(f"`{c}`").alias(f"__stop_{i}") for i, (c, _) in enumerate(keys)))
    return df.join(F.broadcast(first), not_before(keys, [F.col(f"__stop_{i}") for i in range(len(keys))]), "left_anti").orderBy(*_columns(keys))
