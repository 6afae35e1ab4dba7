"""The registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.expressions import Predicate, all_of, any_of, condition, field
from keystrata.operators.query import Query
from keystrata.schema import DatabaseRef, Registry, TableDef
from keystrata.sources.shared import fresh_folder
from keystrata.sources.store import Engine

Run = Callable[[SparkSession, str], DataFrame]

KEYS = {
    "orders": ("o_orderkey",),
    "customer": ("c_custkey",),
    "part": ("p_partkey",),
    "events": ("event_id",),
    "embeddings": ("vec_id",),
    "conversations": ("conv_id", "turn"),
}
INDEXES = {"part": ("p_size", "p_brand"), "orders": ("o_custkey",)}


def table(spark: SparkSession, sf_dir: str, name: str, strict: bool = False) -> Query:
    """One of the driver's tables as a keyed table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Query(TableDef(name, df.schema, KEYS[name], indexes=INDEXES.get(name, ())), lambda: df, strict=strict)


QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run: Run, sql: str) -> None:
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name], ORACLES[name] = run, sql


def _filter(name: str, source: str, columns: str, predicate: Predicate | bool | dict, where: str) -> None:
    """A filtered table, all matching rows, chosen columns."""
    cols = columns.split()
    _add(name, lambda s, d: table(s, d, source).where(predicate).to_df().select(*cols), f"SELECT {', '.join(cols)} FROM {source} WHERE {where}")


SYMBOLS = {"eq": ("Equal", "="), "ne": ("NotEqual", "IS DISTINCT FROM"), "gt": ("GreaterThan", ">"), "ge": ("GreaterThanOrEqual", ">="), "lt": ("LessThan", "<"), "le": ("LessThanOrEqual", "<=")}
ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate"
PART_COLUMNS = "p_partkey p_name p_brand p_size"
EVENT_COLUMNS = "event_id ts user_id event_type"


def _leaf(name: str, operation: str, value: object = None, case_sensitive: bool = True) -> Predicate:
    return Predicate(condition(name, operation, value, case_sensitive))


def _comparisons() -> None:
    for short, (op, sql) in SYMBOLS.items():
        _filter(f"cmp_{short}", "orders", ORDER_COLUMNS, _leaf("o_custkey", op, 700), f"o_custkey {sql} 700")
        _filter(f"len_{short}", "part", PART_COLUMNS, _leaf("p_name", "NotLengthEqual" if short == "ne" else f"Length{op}", 14), f"length(p_name) {sql} 14")
        day = dt.date(2024, 1, 15)
        compare = {"eq": lambda x: x == day, "ne": lambda x: x != day, "gt": lambda x: x > day, "ge": lambda x: x >= day, "lt": lambda x: x < day, "le": lambda x: x <= day}[short]
        _filter(f"date_{short}", "events", EVENT_COLUMNS, compare(field("ts").date), f"CAST(ts AS DATE) {sql} DATE '2024-01-15'")
        for part, prefix, value, source in (("Year", "year", 1997, "orders"), ("Month", "month", 6, "orders"), ("Day", "day", 15, "events"), ("DayOfYear", "doy", 20, "events"), ("DayOfWeek", "dow", 3, "orders")):
            column, columns = ("o_orderdate", ORDER_COLUMNS) if source == "orders" else ("ts", EVENT_COLUMNS)
            function = {"Year": "year", "Month": "month", "Day": "day", "DayOfYear": "dayofyear", "DayOfWeek": "dayofweek"}[part]
            _filter(f"{prefix}_{short}", source, columns, _leaf(column, f"Not{part}Equal" if short == "ne" else part + op, value), f"{function}({column}) {sql} {value}")


def _strings_and_kinds() -> None:
    f = field
    texts = {"starts": ("StartsWith", "starts_with({c}, '{v}')", "p_type", "ECO"), "ends": ("EndsWith", "ends_with({c}, '{v}')", "p_name", "7"), "contains": ("Contains", "contains({c}, '{v}')", "p_name", "art")}
    for short, (op, sql, column, value) in texts.items():
        columns = f"p_partkey {column} p_size"
        folded = sql.format(c=f"lower({column})", v=value.lower())
        _filter(f"str_{short}", "part", columns, _leaf(column, op, value), sql.format(c=column, v=value))
        _filter(f"str_{short}_ci", "part", columns, _leaf(column, op, value.swapcase(), False), folded)
        _filter(f"not_{short}", "part", columns, _leaf(column, f"Not{op}", value), f"NOT {sql.format(c=column, v=value)}")
        _filter(f"not_{short}_ci", "part", columns, _leaf(column, f"Not{op}", value.swapcase(), False), f"NOT {folded}")
    _filter("str_equals", "customer", "c_custkey c_mktsegment", f("c_mktsegment").equals("BUILDING"), "c_mktsegment = 'BUILDING'")
    _filter("str_equals_ci", "customer", "c_custkey c_mktsegment", f("c_mktsegment").equals("building", ignore_case=True), "lower(c_mktsegment) = 'building'")
    _filter("not_equals", "customer", "c_custkey c_mktsegment", ~f("c_mktsegment").equals("BUILDING"), "c_mktsegment IS DISTINCT FROM 'BUILDING'")
    _filter("in_list", "part", PART_COLUMNS, f("p_size").is_in([1, 7, 23, 42]), "p_size IN (1, 7, 23, 42)")
    _filter("in_empty", "part", PART_COLUMNS, f("p_size").is_in([]), "false")
    derived = lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    sub = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders)"
    for name, predicate, where in (
        ("is_null", f("status").is_null(), "status IS NULL"),
        ("is_not_null", f("status").is_not_null(), "status IS NOT NULL"),
        ("equal_null", f("status") == None, "status IS NULL"),  # noqa: E711
        ("not_equal_null", f("status") != None, "status IS NOT NULL"),  # noqa: E711
        ("not_equal_keeps_null", f("status") != "O", "status IS DISTINCT FROM 'O'"),
        ("in_list_null", f("status").is_in(["O", None]), "status = 'O' OR status IS NULL"),
        ("not_contains_null", ~f("status").contains("O"), "NOT contains(status, 'O')"),
    ):
        def run(s: SparkSession, d: str, predicate: Predicate = predicate) -> DataFrame:
            df = derived(s, d)
            return Query(TableDef("orders", df.schema, ("o_orderkey",)), lambda: df).where(predicate).to_df()

        _add(name, run, f"SELECT o_orderkey, status FROM {sub} WHERE {where}")
    for kind, column, source, columns, holds in (
        ("Number", "p_size", "part", PART_COLUMNS, True), ("String", "p_name", "part", PART_COLUMNS, True), ("Date", "ts", "events", EVENT_COLUMNS, True), ("Array", "embedding", "embeddings", "vec_id label", True),
        ("Object", "p_name", "part", PART_COLUMNS, False), ("Blob", "p_name", "part", PART_COLUMNS, False), ("ArrayBuffer", "p_name", "part", PART_COLUMNS, False), ("File", "p_name", "part", PART_COLUMNS, False),
    ):
        _filter(f"typeof_{kind.lower()}", source, columns, f(column).type_of(kind), str(holds).lower())
        _filter(f"not_typeof_{kind.lower()}", source, columns, ~f(column).type_of(kind), str(not holds).lower())

    def words(s: SparkSession, d: str) -> DataFrame:
        df = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.split("p_type", " ").alias("words"))
        return Query(TableDef("part", df.schema, ("p_partkey",)), lambda: df).where(f("words").has("ECONOMY")).to_df().select("p_partkey", F.array_join("words", " ").alias("words"))

    def entries(s: SparkSession, d: str) -> DataFrame:
        df = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.split("p_type", " ").alias("words"))
        return Query(TableDef("part", df.schema, ("p_partkey",), multi_entry=("words",)), lambda: df).keys("words", unique=True)

    _add("multi_entry_keys", entries, "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS words FROM part")
    _add("array_contains", words, "SELECT p_partkey, p_type AS words FROM part WHERE list_contains(string_split(p_type, ' '), 'ECONOMY')")


def _composition() -> None:
    f = field
    nested = ((f("o_totalprice") > 150000) & (f("o_orderstatus") == "O")) | ((f("o_orderdate").year == 1998) & ((f("o_custkey") < 100) | (f("o_orderpriority").starts_with("1"))))
    sql = "(o_totalprice > 150000 AND o_orderstatus = 'O') OR (year(o_orderdate) = 1998 AND (o_custkey < 100 OR starts_with(o_orderpriority, '1')))"
    _filter("and_or_nested", "orders", ORDER_COLUMNS, nested, sql)
    _filter("where_object", "orders", ORDER_COLUMNS, {"o_orderstatus": "O", "o_custkey": 700}, "o_orderstatus = 'O' AND o_custkey = 700")
    _filter("raw_tree", "orders", ORDER_COLUMNS, nested.node, sql)
    _filter("not_demorgan", "orders", ORDER_COLUMNS, ~((f("o_custkey") > 500) & (f("o_orderstatus") == "O")), "NOT (o_custkey > 500 AND o_orderstatus = 'O')")
    _filter("not_or", "orders", ORDER_COLUMNS, ~((f("o_custkey") > 500) | (f("o_orderstatus") == "O")), "NOT (o_custkey > 500 OR o_orderstatus = 'O')")
    _filter("not_comparison", "orders", ORDER_COLUMNS, ~(f("o_custkey") > 500), "o_custkey <= 500")
    _filter("any_all", "part", PART_COLUMNS, any_of(["1", "2"], lambda v: f("p_brand").ends_with(v)) & all_of(["a", "r"], lambda v: f("p_name").contains(v)), "(ends_with(p_brand, '1') OR ends_with(p_brand, '2')) AND contains(p_name, 'a') AND contains(p_name, 'r')")
    _filter("const_true", "part", PART_COLUMNS, True, "true")
    _filter("const_false", "part", PART_COLUMNS, False, "false")
    _filter("reversed_operands", "orders", ORDER_COLUMNS, 500 < f("o_custkey"), "500 < o_custkey")
    _filter("between", "orders", ORDER_COLUMNS, f("o_custkey").between(300, 600), "o_custkey >= 300 AND o_custkey < 600")
    _filter("none_of", "part", PART_COLUMNS, f("p_size").none_of([1, 2, 3]), "p_size NOT IN (1, 2, 3)")
    _filter("in_any_range", "part", PART_COLUMNS, f("p_size").in_any_range([(1, 4), (20, 30)], include_high=True), "p_size BETWEEN 1 AND 4 OR p_size BETWEEN 20 AND 30")
    _filter("starts_with_any_of", "part", "p_partkey p_type", f("p_type").starts_with_any_of(["eco", "std"], ignore_case=True), "starts_with(lower(p_type), 'eco') OR starts_with(lower(p_type), 'std')")
    _filter("in_list_ci", "customer", "c_custkey c_mktsegment", f("c_mktsegment").is_in_ignoring_case(["building", "Machinery"]), "lower(c_mktsegment) IN ('building', 'machinery')")
    cols = ORDER_COLUMNS.split()
    _add("chained_where", lambda s, d: table(s, d, "orders").where(f("o_custkey") > 200).where(f("o_orderstatus") == "F").to_df().select(*cols), f"SELECT {', '.join(cols)} FROM orders WHERE o_custkey > 200 AND o_orderstatus = 'F'")
    _add("cursor_filter", lambda s, d: table(s, d, "orders").cursor(f("o_custkey") > 200).cursor(f("o_totalprice") < 90000).to_df().select(*cols), f"SELECT {', '.join(cols)} FROM orders WHERE o_custkey > 200 AND o_totalprice < 90000")

    def flagged(s: SparkSession, d: str) -> DataFrame:
        df = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("large"))
        return Query(TableDef("orders", df.schema, ("o_orderkey",)), lambda: df).where(f("large")).to_df()

    _add("boolean_member", flagged, "SELECT o_orderkey, o_totalprice > 100000 AS large FROM orders WHERE o_totalprice > 100000")


def _windows() -> None:
    f, cols = field, ORDER_COLUMNS.split()
    listed = ", ".join(cols)

    def add(name: str, run: Callable[[Query], DataFrame], sql: str, source: str = "orders", columns: list[str] | None = None) -> None:
        _add(name, lambda s, d: run(table(s, d, source)).select(*(columns or cols)), sql)

    up, down = "o_totalprice ASC NULLS FIRST, o_orderkey", "o_totalprice DESC NULLS LAST, o_orderkey DESC"
    add("full_scan", lambda q: q.to_df(), f"SELECT {listed} FROM orders")
    add("order_asc", lambda q: q.order_by("o_totalprice").to_df(), f"SELECT {listed} FROM orders ORDER BY {up}")
    add("order_desc", lambda q: q.order_by_descending("o_totalprice").to_df(), f"SELECT {listed} FROM orders ORDER BY {down}")
    add("take", lambda q: q.order_by("o_totalprice").take(25).to_df(), f"SELECT {listed} FROM orders ORDER BY {up} LIMIT 25")
    add("take_by_key", lambda q: q.take(25).to_df(), f"SELECT {listed} FROM orders ORDER BY o_orderkey LIMIT 25")
    add("skip", lambda q: q.order_by_descending("o_totalprice").skip(40).to_df(), f"SELECT {listed} FROM orders ORDER BY {down} OFFSET 40")
    add("take_skip", lambda q: q.order_by("o_orderstatus").take(10).skip(5).to_df(), f"SELECT {listed} FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 10 OFFSET 5")
    add("skip_take_desc", lambda q: q.order_by_descending("o_orderstatus").take(10).skip(5).to_df(), f"SELECT {listed} FROM orders ORDER BY o_orderstatus DESC, o_orderkey DESC LIMIT 10 OFFSET 5")
    add("take_last", lambda q: q.order_by("o_totalprice").take_last(20).to_df(), f"SELECT {listed} FROM orders ORDER BY {down} LIMIT 20")
    add("take_last_skip", lambda q: q.cursor(f("o_custkey") > 100).order_by("o_totalprice").take_last(20).skip(6).to_df(), f"SELECT {listed} FROM (SELECT * FROM orders WHERE o_custkey > 100 ORDER BY {down} LIMIT 20) ORDER BY {up} OFFSET 6")
    add("first", lambda q: q.order_by("o_totalprice").first_df(), f"SELECT {listed} FROM orders ORDER BY {up} LIMIT 1")
    add("last", lambda q: q.order_by("o_totalprice").last_df(), f"SELECT {listed} FROM orders ORDER BY {down} LIMIT 1")
    add("first_where", lambda q: q.first_df(f("o_custkey") > 300), f"SELECT {listed} FROM orders WHERE o_custkey > 300 ORDER BY o_custkey, o_orderkey LIMIT 1")
    add("last_where", lambda q: q.last_df(f("o_totalprice") > 100000), f"SELECT {listed} FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey DESC LIMIT 1")
    add("last_in_window", lambda q: q.cursor(f("o_custkey") > 100).order_by("o_totalprice").take(30).skip(10).last_df(), f"SELECT {listed} FROM (SELECT * FROM orders WHERE o_custkey > 100 ORDER BY {up} LIMIT 30 OFFSET 10) ORDER BY {down} LIMIT 1")
    add("where_async", lambda q: q.order_by("o_totalprice").take(200).filter_after(F.col("o_orderstatus") == "O"), f"SELECT {listed} FROM (SELECT * FROM orders ORDER BY {up} LIMIT 200) WHERE o_orderstatus = 'O'")
    add("until", lambda q: q.where(f("o_totalprice") > 1000).order_by_descending("o_totalprice").until(f("o_orderstatus") == "P"), f"WITH s AS (SELECT *, row_number() OVER (ORDER BY {down}) AS n FROM orders WHERE o_totalprice > 1000) SELECT {listed} FROM s WHERE n < coalesce((SELECT min(n) FROM s WHERE o_orderstatus = 'P'), 1000000000)")
    add("bulk_get", lambda q: q.get_many([(3,), (77,), (77,), (-5,)]), f"SELECT {listed} FROM orders WHERE o_orderkey IN (3, 77)")
    add("primary_keys", lambda q: q.where(f("o_custkey") < 50).primary_keys(), "SELECT o_orderkey FROM orders WHERE o_custkey < 50", columns=["o_orderkey"])
    add("index_keys", lambda q: q.where(f("o_custkey") < 50).keys("o_custkey"), "SELECT o_custkey FROM orders WHERE o_custkey < 50", columns=["o_custkey"])
    add("unique_keys", lambda q: q.keys("o_custkey", unique=True), "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL", columns=["o_custkey"])
    add("get_by_key", lambda q: q.by_key(77).to_df(), f"SELECT {listed} FROM orders WHERE o_orderkey = 77")
    add("additions_list", lambda q: q.additions([{"additionFunction": "orderBy", "intValue": 0, "property": "o_custkey"}, {"additionFunction": "take", "intValue": 30}, {"additionFunction": "skip", "intValue": 7}]).to_df(), f"SELECT {listed} FROM orders ORDER BY o_custkey, o_orderkey LIMIT 30 OFFSET 7")
    part, parts = PART_COLUMNS.split(), PART_COLUMNS.replace(" ", ", ")
    add("implicit_order_take", lambda q: q.where(f("p_size") > 10).take(50).to_df(), f"SELECT {parts} FROM part WHERE p_size > 10 ORDER BY p_size, p_partkey LIMIT 50", "part", part)
    add("implicit_order_take_last", lambda q: q.where((f("p_brand") > "Brand#1") & (f("p_size") > 10)).take_last(50).to_df(), f"SELECT {parts} FROM part WHERE p_brand > 'Brand#1' AND p_size > 10 ORDER BY p_brand DESC, p_size DESC, p_partkey DESC LIMIT 50", "part", part)
    add("stable_order_take", lambda q: q.cursor(f("p_size") > 10).stable_ordering().take(50).to_df(), f"SELECT {parts} FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 50", "part", part)
    add("compound_key_take", lambda q: q.where(f("role") == "user").take(40).skip(3).to_df(), "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 40 OFFSET 3", "conversations", ["conv_id", "turn", "role"])
    _add("count_all", lambda s, d: table(s, d, "orders").count_df(), "SELECT count(*) AS count FROM orders")
    _add("flagship", flagship, f"SELECT {listed} FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice > 100000 ORDER BY {down} LIMIT 10 OFFSET 5")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dear orders of one year, the second half-page by price."""
    f = field
    q = table(spark, sf_dir, "orders").cursor((f("o_orderdate").year == 1997) & (f("o_totalprice") > 100000))
    return q.order_by_descending("o_totalprice").take(10).skip(5).to_df().select(*ORDER_COLUMNS.split())


def _mutations() -> None:
    def empty(s: SparkSession, d: str):
        df = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
        engine = Engine(s, fresh_folder(s, "engine"), Registry(TableDef("customer", df.schema, ("c_custkey",))))
        return engine.table("customer"), df

    def stored(s: SparkSession, d: str):
        t, df = empty(s, d)
        t.add_range(df)
        return t, df

    def add_range(s: SparkSession, d: str) -> DataFrame:
        t, df = empty(s, d)
        t.add_range(df.filter("c_acctbal > 2000"))
        t.add_range(df.filter("NOT c_acctbal > 2000"))
        return t.df()

    def add_one(s: SparkSession, d: str) -> DataFrame:
        t, _ = stored(s, d)
        t.add({"c_custkey": -1, "c_name": "added", "c_nationkey": 3, "c_acctbal": 1.5})
        return t.df()

    def put_one(s: SparkSession, d: str) -> DataFrame:
        t, _ = stored(s, d)
        t.put([{"c_custkey": 10, "c_name": "put", "c_nationkey": 3, "c_acctbal": 1.5}])
        t.put([{"c_custkey": -1, "c_name": "put", "c_nationkey": 3, "c_acctbal": 1.5}])
        return t.df()

    def update(s: SparkSession, d: str) -> DataFrame:
        t, _ = stored(s, d)
        t.update({"c_custkey": 10, "c_name": "renamed", "c_nationkey": 3, "c_acctbal": 1.5})
        t.update({"c_custkey": -1, "c_name": "absent", "c_nationkey": 3, "c_acctbal": 1.5})
        return t.df()

    def update_many(s: SparkSession, d: str) -> DataFrame:
        t, _ = stored(s, d)
        t.update_many([{"c_custkey": 10, "c_name": "renamed"}, {"c_custkey": 20, "c_acctbal": None}, {"c_custkey": 10, "c_acctbal": 2.5}, {"c_custkey": -1, "c_name": "absent"}])
        return t.df()

    def upsert(s: SparkSession, d: str) -> DataFrame:
        t, df = empty(s, d)
        t.add_range(df.filter("c_acctbal > 2000"))
        t.update_range(df.filter("NOT c_acctbal > 4000").withColumn("c_acctbal", F.lit(0.0)))
        return t.df()

    def delete_one(s: SparkSession, d: str) -> DataFrame:
        t, _ = stored(s, d)
        t.delete({"c_custkey": 10})
        t.delete({"c_custkey": -1})
        return t.df()

    def delete(s: SparkSession, d: str) -> DataFrame:
        t, df = stored(s, d)
        t.delete_range(df.filter("c_acctbal < 3000"))
        return t.df()

    def clear(s: SparkSession, d: str) -> DataFrame:
        t, _ = stored(s, d)
        t.clear()
        return t.df()

    def modify(s: SparkSession, d: str) -> DataFrame:
        t, _ = stored(s, d)
        t.modify(field("c_nationkey") == 7, {"c_acctbal": F.col("c_acctbal") + 1, "c_name": "seven"})
        t.delete_where(field("c_nationkey") == 8)
        return t.df()

    head = "c_custkey, c_name, c_nationkey"
    one = "10 AS c_custkey, '{}' AS c_name, 3 AS c_nationkey, 1.5::DOUBLE AS c_acctbal"
    _add("add_range", add_range, f"SELECT {head}, c_acctbal FROM customer")
    _add("add_one", add_one, f"SELECT {head}, c_acctbal FROM customer UNION ALL SELECT {one.format('added').replace('10', '-1', 1)}")
    _add("put_one", put_one, f"SELECT {head}, c_acctbal FROM customer WHERE c_custkey <> 10 UNION ALL SELECT {one.format('put')} UNION ALL SELECT {one.format('put').replace('10', '-1', 1)}")
    _add("update_one", update, f"SELECT {head}, c_acctbal FROM customer WHERE c_custkey <> 10 UNION ALL SELECT {one.format('renamed')}")
    _add("update_many", update_many, "SELECT c_custkey, CASE WHEN c_custkey = 10 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, CASE c_custkey WHEN 10 THEN 2.5::DOUBLE WHEN 20 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
    _add("upsert_range", upsert, f"SELECT {head}, CASE WHEN c_acctbal > 4000 THEN c_acctbal ELSE 0.0::DOUBLE END AS c_acctbal FROM customer")
    _add("delete_one", delete_one, f"SELECT {head}, c_acctbal FROM customer WHERE c_custkey <> 10")
    _add("delete_range", delete, f"SELECT {head}, c_acctbal FROM customer WHERE NOT c_acctbal < 3000")
    _add("modify_where", modify, "SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'seven' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_nationkey = 7 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 8")
    _add("clear_table", clear, f"SELECT {head}, c_acctbal FROM customer WHERE false")


def _administration() -> None:
    """What engine, databases and handles answer, as small tables."""

    def engine_of(s: SparkSession, d: str) -> tuple[Engine, DataFrame]:
        df = s.read.parquet(f"{d}/nation.parquet")
        tables = Registry(TableDef("nation", df.schema, ("n_nationkey",), unique=("n_name",), databases=(DatabaseRef("client"), DatabaseRef("archive"))), TableDef("copy", df.schema, ("n_nationkey",)))
        return Engine(s, fresh_folder(s, "engine"), tables), df

    def counted(s: SparkSession, opened: dict) -> DataFrame:
        return s.createDataFrame([(how, t.query().count()) for how, t in opened.items()], "opened string, n long")

    def opened(s: SparkSession, d: str) -> DataFrame:
        engine, df = engine_of(s, d)
        engine.table("nation").add_range(df)
        engine.table("nation", "archive").add_range(df.filter("n_regionkey = 1"))
        return counted(s, {"default": engine.table("nation"), "chosen": engine.table("nation", DatabaseRef("archive")), "by set": engine.table("nation", engine.registry.table("nation").databases[1]), "by name": engine.table("nation", "archive"), "handle": engine.database("client").table("nation"), "other": engine.table("copy")})

    def states(s: SparkSession, d: str) -> DataFrame:
        engine, _ = engine_of(s, d)
        out, db = [], engine.database("client")
        note = lambda step: out.append((step, db.exists(), db.is_open(), ",".join(engine.open_databases())))
        note("before")
        engine.create_databases()
        note("all created")
        db.close()
        note("closed")
        db.open()
        note("opened")
        db.delete()
        note("deleted")
        db.create()
        note("created again")
        engine.close_all()
        note("all closed")
        engine.delete_all()
        note("all deleted")
        return s.createDataFrame(out, "step string, present boolean, is_open boolean, all_open string")

    def introspected(s: SparkSession, d: str) -> DataFrame:
        engine, _ = engine_of(s, d)
        engine.create_databases()
        rows = [(t["name"], c["name"], c["type"], c["name"] in t["primary_key"], c["name"] in t["unique"]) for t in engine.database("client").schema()["tables"] for c in t["columns"]["fields"]]
        return s.createDataFrame(rows, "table_name string, column_name string, kind string, is_key boolean, is_unique boolean")

    def estimated(s: SparkSession, d: str) -> DataFrame:
        engine, df = engine_of(s, d)
        before = engine.storage_estimate().usage
        engine.table("nation").add_range(df)
        after = engine.storage_estimate()
        return s.createDataFrame([(after.usage > before, after.quota >= after.usage)], "grew boolean, within_quota boolean")

    def iterated(s: SparkSession, d: str) -> DataFrame:
        pulled = table(s, d, "orders").where(field("o_custkey") == 7).order_by("o_totalprice").rows()
        return s.createDataFrame([(r.o_orderkey, r.o_custkey) for r in pulled], "o_orderkey long, o_custkey long")

    def folded(s: SparkSession, d: str) -> DataFrame:
        least, states_ = 100_000 + 50_000, ["O", "P"]
        return table(s, d, "orders").where((field("o_totalprice") > least) & field("o_orderstatus").is_in(states_)).to_df().select(*ORDER_COLUMNS.split())

    _add("table_handles", opened, "SELECT * FROM (VALUES ('default', 25), ('handle', 25), ('chosen', (SELECT count(*) FROM nation WHERE n_regionkey = 1)), ('by set', (SELECT count(*) FROM nation WHERE n_regionkey = 1)), ('by name', (SELECT count(*) FROM nation WHERE n_regionkey = 1)), ('other', 0)) AS t(opened, n)")
    _add("database_states", states, """SELECT * FROM (VALUES ('before', false, false, ''), ('all created', true, true, 'archive,client,default'), ('closed', true, false, 'archive,default'), ('opened', true, true, 'archive,client,default'),
        ('deleted', false, false, 'archive,default'), ('created again', true, true, 'archive,client,default'), ('all closed', true, false, ''), ('all deleted', false, false, '')) AS t(step, present, is_open, all_open)""")
    _add("database_schema", introspected, "SELECT t AS table_name, c AS column_name, k AS kind, c = 'n_nationkey' AS is_key, t = 'nation' AND c = 'n_name' AS is_unique FROM (VALUES ('nation'), ('copy')) a(t), (VALUES ('n_nationkey', 'integer'), ('n_name', 'string'), ('n_regionkey', 'integer')) b(c, k)")
    _add("storage_estimate", estimated, "SELECT true AS grew, true AS within_quota")
    _add("pull_rows", iterated, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
    _add("captured_values", folded, f"SELECT {ORDER_COLUMNS.replace(' ', ', ')} FROM orders WHERE o_totalprice > 150000 AND o_orderstatus IN ('O', 'P')")


for _group in (_comparisons, _strings_and_kinds, _composition, _windows, _mutations, _administration):
    _group()
