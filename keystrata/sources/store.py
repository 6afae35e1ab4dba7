"""Databases of keyed tables on Parquet.

A table is a list of immutable Parquet files named by a numbered manifest. A write reads one manifest, adds files,
and publishes the next number; it fails if another writer has published that number first, so no write is lost.
Inserts add files; updates and deletes rewrite the files that hold a row they concern, and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.expressions import as_node
from keystrata.operators.query import Query
from keystrata.plans.filters import compile_filter
from keystrata.schema import DatabaseRef, Registry, TableDef
from keystrata.sources.files import Files


class KeyExists(ValueError):
    """An inserted key or unique value is there already, or twice in the input."""


class KeyMissing(ValueError):
    """A row without a key, for a table that doesn't number its rows."""


class Conflict(FileExistsError):
    """Another writer has published since this write read the table. Nothing has changed; the call may be repeated."""


@dataclass(frozen=True)
class Snapshot:
    """A version of a table: its files as "folder/file"; version -1 is the table before its first write."""

    version: int
    files: tuple[str, ...]


@dataclass(frozen=True)
class Quota:
    quota: int
    usage: int

    @property
    def quota_mb(self) -> float:
        return self.quota / 2**20

    @property
    def usage_mb(self) -> float:
        return self.usage / 2**20


def numbered(df: DataFrame, column: str, start: int, spark_type: T.DataType) -> DataFrame:
    """Consecutive numbers from ``start`` without bringing rows together: counts by partition, then offsets."""
    tagged = df.withColumn("__at", F.monotonically_increasing_id())
    part, local = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    sizes = tagged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    joined = tagged.withColumn("__part", part).join(offsets, "__part")
    return joined.withColumn(column, (F.lit(start) + F.col("__before") + local).cast(spark_type)).drop("__at", "__part", "__before", "__n")


class Table:
    """Reads and row-level writes of one stored table."""

    def __init__(self, engine: Engine, database: DatabaseRef, definition: TableDef) -> None:
        self.engine, self.definition = engine, definition
        self.path = f"{engine.root}/{database.name}/{definition.name}"

    # snapshots
    def snapshot(self) -> Snapshot:
        names = [x for x in self.engine.files.names(f"{self.path}/_manifests") if x.endswith(".json")]
        if not names:
            return Snapshot(-1, ())
        return Snapshot(int(names[-1].split(".")[0]), tuple(json.loads(self.engine.files.read(f"{self.path}/_manifests/{names[-1]}"))["files"]))

    def _publish(self, read: Snapshot, files: Iterable[str]) -> None:
        """The version after the one that was read."""
        try:
            self.engine.files.create(f"{self.path}/_manifests/{read.version + 1:012d}.json", json.dumps({"files": list(files)}))
        except FileExistsError as error:
            raise Conflict(f"{self.definition.name}: version {read.version} is no longer the newest") from error

    def _write(self, df: DataFrame) -> list[str]:
        part = f"part-{uuid.uuid4().hex}"
        df.select(*(F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in self.definition.schema)).write.parquet(f"{self.path}/{part}")
        return [f"{part}/{x}" for x in self.engine.files.names(f"{self.path}/{part}") if x.endswith(".parquet")]

    def _read(self, files: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{x}" for x in files]
        if not paths:
            return self.engine.spark.createDataFrame([], self.definition.schema)
        return self.engine.spark.read.schema(self.definition.schema).parquet(*paths)

    def df(self) -> DataFrame:
        return self._read(self.snapshot().files)

    def query(self, strict: bool = False) -> Query:
        return Query(self.definition, self.df, strict=strict)

    # rows in
    def _frame(self, rows: Any) -> DataFrame:
        """Rows as dicts under attribute names, or a DataFrame under stored names; missing columns are null."""
        t = self.definition
        if isinstance(rows, DataFrame):
            missing = [c for c in t.schema if c.name not in rows.columns]
            return rows.select(*(F.col(f"`{c.name}`") if c not in missing else F.lit(None).cast(c.dataType).alias(c.name) for c in t.schema))
        loose = T.StructType([T.StructField(c.name, c.dataType, True) for c in t.schema])
        named = [{t.column(k): v for k, v in r.items() if t.has(k)} for r in rows]
        return self.engine.spark.createDataFrame([tuple(r.get(c.name) for c in t.schema) for r in named], loose).coalesce(1)

    @contextmanager
    def _staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """The rows, written once, for a call that reads them more than once."""
        path = f"{self.path}/_stage/{uuid.uuid4().hex}"
        df.write.parquet(path)
        try:
            yield self.engine.spark.read.schema(df.schema).parquet(path)
        finally:
            self.engine.files.delete(path)

    def _keyed(self, rows: DataFrame, read: Snapshot) -> DataFrame:
        """Rows with their keys: numbered where the table does so and they have none, refused where it doesn't."""
        t = self.definition
        if t.auto_increment:
            key, kind = t.primary_key[0], t.schema[t.primary_key[0]].dataType
            none = F.coalesce(F.col(key), F.lit(0)) == 0
            given, fresh = rows.filter(~none), rows.filter(none)
            if fresh.limit(1).isEmpty():
                return given
            top = max(x or 0 for x in (self._read(read.files).agg(F.max(key)).first()[0], given.agg(F.max(key)).first()[0]))
            return given.unionByName(numbered(fresh, key, top + 1, kind).select(*given.columns))
        if not rows.filter(" OR ".join(f"`{c}` IS NULL" for c in t.primary_key)).limit(1).isEmpty():
            raise KeyMissing(f"{t.name}: a row has no {', '.join(t.primary_key)}")
        return rows

    def _check_unique(self, new: DataFrame, read: Snapshot, columns: Iterable[str]) -> None:
        """No unique value twice among the new rows, nor in a stored row of another key. Nulls aren't indexed."""
        key, stored = list(self.definition.primary_key), self._read(read.files)
        for c in columns:
            known = new.select(*key, c).filter(F.col(f"`{c}`").isNotNull())
            others = stored.select(c, *(F.col(f"`{k}`").alias(f"__{n}") for n, k in enumerate(key)))
            same = reduce(Column.__and__, (F.col(f"`{k}`").eqNullSafe(F.col(f"__{n}")) for n, k in enumerate(key)))
            if not known.groupBy(c).count().filter("count > 1").limit(1).isEmpty() or not known.join(others, c).filter(~same).limit(1).isEmpty():
                raise KeyExists(f"{self.definition.name}: {c} would not be unique")

    def _holding(self, read: Snapshot, found: Callable[[DataFrame], DataFrame]) -> list[str]:
        """The files with a row that ``found`` keeps: one name a file."""
        if not read.files:
            return []
        paths = found(self._read(read.files).select("*", F.col("_metadata.file_path").alias("__path"))).select("__path").distinct()
        return ["/".join(r[0].rsplit("/", 2)[1:]) for r in paths.toLocalIterator()]

    def _replace(self, read: Snapshot, keys: DataFrame, new: DataFrame | None) -> None:
        """Publishes the table without the rows of these keys, and with the new ones."""
        names = list(self.definition.primary_key)
        keys = keys.select(*names).distinct()
        touched = set(self._holding(read, lambda df: df.join(keys, names, "left_semi")))
        files = [x for x in read.files if x not in touched]
        if touched:
            files += self._write(self._read(sorted(touched)).join(keys, names, "left_anti"))
        self._publish(read, files + (self._write(new) if new is not None else []))

    def add(self, row: dict[str, Any]) -> int:
        return self.add_range([row])

    def add_range(self, rows: Iterable[dict[str, Any]] | DataFrame) -> int:
        """Inserts; an existing or repeated key or unique value, or a missing key, refuses the whole call. Returns the count."""
        t, read = self.definition, self.snapshot()
        with self._staged(self._frame(rows)) as staged:
            files = self._write(self._keyed(staged, read))
        added, key = self._read(files), list(t.primary_key)
        try:
            if not added.groupBy(*key).count().filter("count > 1").limit(1).isEmpty() or not added.join(self._read(read.files).select(*key), key, "left_semi").limit(1).isEmpty():
                raise KeyExists(f"{t.name}: {key} would not be unique")
            self._check_unique(added, read, t.unique)
            self._publish(read, (*read.files, *files))
        except Exception:
            self._drop(files)
            raise
        return added.count()

    def _drop(self, files: Iterable[str]) -> None:
        for folder in {x.split("/")[0] for x in files}:
            self.engine.files.delete(f"{self.path}/{folder}")

    def update(self, row: dict[str, Any]) -> int:
        """Replaces the row with this key; 0 if there is none."""
        key, read, new = list(self.definition.primary_key), self.snapshot(), self._frame([row])
        found = new.join(self._read(read.files).select(*key), key, "left_semi").count()
        if found:
            self._check_unique(new, read, self.definition.unique)
            self._replace(read, new, new)
        return found

    def update_range(self, rows: Iterable[dict[str, Any]] | DataFrame) -> int:
        """Puts every row: replaces or inserts. Returns the number of input rows; of equal keys one stays."""
        read, key = self.snapshot(), list(self.definition.primary_key)
        with self._staged(self._frame(rows)) as staged, self._staged(self._keyed(staged, read).dropDuplicates(key)) as new:
            n = staged.count()
            self._check_unique(new, read, self.definition.unique)
            self._replace(read, new, new)
        return n

    put = update_range

    def update_many(self, rows: Iterable[dict[str, Any]]) -> int:
        """Sets, for the key in each dict, its other attributes; what a dict leaves out stays. Later ones win. Returns how many keys were found."""
        t, read, merged = self.definition, self.snapshot(), {}
        for r in rows:
            named = {t.column(k): v for k, v in r.items() if t.has(k)}
            if any(named.get(k) is None for k in t.primary_key):
                raise KeyMissing(f"{t.name}: a change names no {', '.join(t.primary_key)}")
            merged.setdefault(tuple(named[k] for k in t.primary_key), {}).update(named)
        rest = [c for c in t.schema if c.name not in t.primary_key]
        loose = T.StructType([*(T.StructField(k, t.schema[k].dataType) for k in t.primary_key), *(T.StructField(f"__{n}", T.StructType([T.StructField("to", c.dataType)])) for n, c in enumerate(rest))])
        changes = self.engine.spark.createDataFrame([(*key, *(((named[c.name],) if c.name in named else None) for c in rest)) for key, named in merged.items()], loose).coalesce(1)
        changed = self._read(read.files).join(changes, list(t.primary_key))
        changed = changed.select(*t.primary_key, *(F.when(F.col(f"__{n}").isNotNull(), F.col(f"__{n}.to")).otherwise(F.col(f"`{c.name}`")).alias(c.name) for n, c in enumerate(rest)))
        with self._staged(changed) as new:
            n = new.count()
            if n:
                self._check_unique(new, read, t.unique)
                self._replace(read, new, new)
        return n

    def delete(self, row: dict[str, Any]) -> int:
        return self.delete_range([row])

    def delete_range(self, rows: Iterable[dict[str, Any]] | DataFrame) -> int:
        """Deletes by key; missing keys are no error. Returns the number of input rows."""
        read, gone = self.snapshot(), self._frame(rows)
        n = gone.count()
        self._replace(read, gone, None)
        return n

    def modify(self, predicate: Any, changes: dict[str, Any]) -> int:
        """Sets attributes (values or Columns, not of the key) of all rows that meet the predicate; returns how many."""
        t, read = self.definition, self.snapshot()
        named = {t.column(k): v if isinstance(v, Column) else F.lit(v) for k, v in changes.items()}
        if set(named) & set(t.primary_key) or not all(map(t.has, changes)):
            raise ValueError("only stored columns outside the key can be modified")
        test = F.coalesce(compile_filter(as_node(predicate), t), F.lit(False))
        n = self._read(read.files).filter(test).count()
        if n:
            columns = [F.when(test, named[c.name].cast(c.dataType)).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in named else F.col(f"`{c.name}`") for c in t.schema]
            self._check_unique(self._read(read.files).filter(test).select(*columns), read, [c for c in t.unique if c in named])
            touched = set(self._holding(read, lambda df: df.filter(test)))
            self._publish(read, [x for x in read.files if x not in touched] + self._write(self._read(sorted(touched)).select(*columns)))
        return n

    def delete_where(self, predicate: Any) -> int:
        """Deletes all rows that meet the predicate; returns how many."""
        read = self.snapshot()
        test = F.coalesce(compile_filter(as_node(predicate), self.definition), F.lit(False))
        n = self._read(read.files).filter(test).count()
        if n:
            touched = set(self._holding(read, lambda df: df.filter(test)))
            self._publish(read, [x for x in read.files if x not in touched] + self._write(self._read(sorted(touched)).filter(~test)))
        return n

    def clear(self) -> None:
        self._publish(self.snapshot(), [])

    def vacuum(self) -> int:
        """Removes folders of which the newest manifest names no file. Only while nobody reads or writes older versions."""
        keep = {*(x.split("/")[0] for x in self.snapshot().files), "_manifests"}
        gone = [x for x in self.engine.files.names(self.path) if x not in keep]
        for x in gone:
            self.engine.files.delete(f"{self.path}/{x}")
        return len(gone)


class Database:
    """Administration of one database."""

    def __init__(self, engine: Engine, ref: DatabaseRef) -> None:
        self.engine, self.ref, self.path = engine, ref, f"{engine.root}/{ref.name}"

    def create(self) -> None:
        files = self.engine.files
        if not files.exists(f"{self.path}/_schema.json"):
            files.make(self.path)
            files.create(f"{self.path}/_schema.json", json.dumps({"name": self.ref.name, "version": 1, "tables": [t.store_schema() for t in self.engine.registry.tables()]}))
        self.open()

    def open(self) -> None:
        if not self.exists():
            raise FileNotFoundError(self.ref.name)
        self.engine.opened.add(self.ref.name)

    def close(self) -> None:
        self.engine.opened.discard(self.ref.name)

    def delete(self) -> None:
        self.close()
        self.engine.files.delete(self.path)

    def is_open(self) -> bool:
        return self.ref.name in self.engine.opened

    def exists(self) -> bool:
        return self.engine.files.exists(f"{self.path}/_schema.json")

    def schema(self) -> dict:
        return json.loads(self.engine.files.read(f"{self.path}/_schema.json"))

    def table(self, name: str) -> Table:
        return Table(self.engine, self.ref, self.engine.registry.table(name))


class Engine:
    """A root folder, a registry of tables and a session."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry, debug: bool = False) -> None:
        self.spark, self.root, self.registry = spark, root.rstrip("/"), registry.validate() if debug else registry
        self.files = Files(spark, self.root)
        self.opened: set[str] = set()

    def database(self, ref: DatabaseRef | str) -> Database:
        return Database(self, ref if isinstance(ref, DatabaseRef) else DatabaseRef(ref))

    def create_databases(self) -> None:
        for ref in self.registry.databases():
            self.database(ref).create()

    def table(self, name: str, database: DatabaseRef | str | None = None) -> Table:
        """The table in its default database or in another; the database is created at first use."""
        definition = self.registry.table(name)
        db = self.database(database or definition.default_database)
        if not db.is_open():
            db.create()
        return db.table(name)

    def query(self, name: str, database: DatabaseRef | str | None = None, strict: bool = False) -> Query:
        return self.table(name, database).query(strict)

    def open_databases(self) -> list[str]:
        return sorted(self.opened)

    def close_all(self) -> None:
        self.opened.clear()

    def delete_all(self) -> None:
        """Deletes the databases below the root; folders that are none stay."""
        for name in self.files.names(self.root):
            if self.database(name).exists():
                self.database(name).delete()

    def storage_estimate(self) -> Quota:
        return Quota(self.files.capacity(), self.files.size(self.root))
