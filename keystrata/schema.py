"""Table definitions: columns, keys, indexes, naming and validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A table definition that breaks one of the rules of ``TableDef.validate``."""


@dataclass(frozen=True)
class DatabaseRef:
    """A named database; a registry lists the ones an application uses."""

    name: str


@dataclass(frozen=True)
class TableDef:
    """A keyed table with an explicit schema.

    ``schema`` has the stored columns under their stored names. ``column_names`` maps attribute
    names of the application to stored names; ``not_mapped`` are attributes which are never stored.
    """

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    auto_increment: bool = False
    indexes: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    compound_indexes: tuple[tuple[str, ...], ...] = ()
    #: Array columns of which each element is an index entry of the row.
    multi_entry: tuple[str, ...] = ()
    column_names: dict[str, str] = field(default_factory=dict)
    not_mapped: frozenset[str] = frozenset()
    databases: tuple[DatabaseRef, ...] = (DatabaseRef("default"),)

    def column(self, attribute: str) -> str:
        return self.column_names.get(attribute, attribute)

    def has(self, attribute: str) -> bool:
        return attribute not in self.not_mapped and self.column(attribute) in self.schema.names

    def data_type(self, attribute: str) -> T.DataType:
        return self.schema[self.column(attribute)].dataType

    @property
    def default_database(self) -> DatabaseRef:
        return self.databases[0]

    @property
    def indexed(self) -> frozenset[str]:
        """Columns with an index of their own or as members of a compound one; the key counts."""
        return frozenset((*self.primary_key, *self.indexes, *self.unique, *self.multi_entry, *(c for x in self.compound_indexes for c in x)))

    def store_schema(self) -> dict:
        """What the catalogue keeps of this table, as plain JSON."""
        return {
            "name": self.name,
            "columns": self.schema.jsonValue(),
            "primary_key": list(self.primary_key),
            "auto_increment": self.auto_increment,
            "indexes": list(self.indexes),
            "unique": list(self.unique),
            "multi_entry": list(self.multi_entry),
            "compound_indexes": [list(x) for x in self.compound_indexes],
        }

    def validate(self) -> TableDef:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise SchemaError(f"{self.name}: {what}")

        names = self.schema.names
        need(bool(names), "a table needs at least one column")
        need(len(set(names)) == len(names), "column names must differ")
        need(bool(self.primary_key), "a table needs a primary key")
        need(len(set(self.primary_key)) == len(self.primary_key), "a key column is listed twice")
        need(not set(self.primary_key) & self.not_mapped, "key columns must be stored")
        for c in self.indexed:
            need(c in names, f"{c} is a key or index but no stored column")
        for c in self.primary_key:
            kind = self.schema[c].dataType
            need(not isinstance(kind, (T.StructType, T.ArrayType)), f"key column {c} is nested")
            need(c not in self.unique, f"key column {c} is also a unique index")
        single = len(self.primary_key) == 1
        if single:
            need(not self.schema[self.primary_key[0]].nullable, "a single primary key can't be nullable")
        else:
            need(not self.auto_increment, "a compound key can't be auto-incremented")
            need("id" not in {c.lower() for c in self.primary_key}, "a compound key can't contain id")
        if self.auto_increment and single:
            kind = self.schema[self.primary_key[0]].dataType
            need(isinstance(kind, T.IntegralType), "an auto-incremented key must be an integer")
        for c in self.multi_entry:
            need(isinstance(self.schema[c].dataType, T.ArrayType), f"multi-entry index {c} is no array")
        for x in self.compound_indexes:
            need(len(set(x)) >= 2 and len(set(x)) == len(x), "a compound index needs two or more different columns")
        need(len({tuple(sorted(x)) for x in self.compound_indexes}) == len(self.compound_indexes), "a compound index is defined twice")
        role = [*self.indexes, *self.unique, *self.multi_entry]
        need(len(set(role)) == len(role), "a column has more than one index of its own")
        return self


class Registry:
    """The table definitions and databases of an application."""

    def __init__(self, *tables: TableDef) -> None:
        self._tables = {t.name: t for t in tables}
        if len(self._tables) != len(tables):
            raise SchemaError("two tables share a name")

    def table(self, name: str) -> TableDef:
        return self._tables[name]

    def tables(self) -> list[TableDef]:
        return list(self._tables.values())

    def databases(self) -> list[DatabaseRef]:
        return list(dict.fromkeys(d for t in self._tables.values() for d in t.databases))

    def validate(self) -> Registry:
        for t in self._tables.values():
            t.validate()
        return self
