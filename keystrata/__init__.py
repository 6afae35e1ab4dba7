"""keystrata: typed, keyed-table queries that compile to Spark DataFrames."""

from keystrata.functions.expressions import all_of, any_of, field
from keystrata.operators.query import Query
from keystrata.schema import DatabaseRef, Registry, SchemaError, TableDef
from keystrata.sources.store import Engine

__all__ = ["DatabaseRef", "Engine", "Query", "Registry", "SchemaError", "TableDef", "all_of", "any_of", "field"]
