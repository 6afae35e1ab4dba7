import pytest
from people import PERSON, rows
from pyspark.sql import types as T

from keystrata import DatabaseRef, Engine, Registry, SchemaError, TableDef, field
from keystrata.operators.query import Query
from keystrata.sources.store import Conflict, KeyExists, KeyMissing, numbered

CAR = TableDef("car", T.StructType([T.StructField("Created", T.DateType(), False), T.StructField("Brand", T.StringType())]), ("Created",), databases=(DatabaseRef("garage"),))
PAIR = TableDef("pair", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("v", T.DoubleType())]), ("a", "b"))


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "root"), Registry(PERSON, CAR, PAIR), debug=True)


def ids(table):
    return sorted(r["_id"] for r in table.df().collect())


def test_add_numbers_rows_and_refuses_known_keys(engine):
    t = engine.table("person")
    assert t.add({"Name": "A", "YearsOld": 3, "guid": "1", "Secret": "never stored"}) == 1
    assert t.add_range([{"Name": "B", "guid": "2"}, {"_id": 10, "Name": "C", "guid": "3"}, {"_id": 0, "Name": "D", "guid": "4"}]) == 3
    assert ids(t) == [1, 10, 11, 12]
    assert {r["Age"] for r in t.query().where(field("Name") == "A").to_list()} == {3}
    for bad in ([{"_id": 10, "guid": "9"}], [{"guid": "3"}], [{"guid": "7"}, {"guid": "7"}], [{"_id": 20, "guid": "a"}, {"_id": 20, "guid": "b"}]):
        with pytest.raises(KeyExists):
            t.add_range(bad)
    assert ids(t) == [1, 10, 11, 12]


def test_update_upsert_delete_clear(engine):
    t = engine.table("person")
    t.add_range(rows())
    assert t.update({"_id": 3, "Name": "changed", "guid": "g3"}) == 1 and t.update({"_id": 999, "Name": "absent"}) == 0
    assert t.query().get(3)["Name"] == "changed" and t.query().count() == 48
    assert t.update_range([{"_id": 3, "guid": "g3"}, {"_id": 60, "guid": "g60"}]) == 2
    assert t.put([{"_id": 61, "guid": "g61"}, {"_id": 61, "guid": "g61"}]) == 2
    assert t.query().count() == 50 and t.query().get(3)["Name"] is None
    assert t.delete({"_id": 60}) == 1 and t.delete_range([{"_id": 1}, {"_id": 2}, {"_id": 12345}]) == 3
    assert t.query().count() == 47
    assert t.vacuum() > 0 and t.query().count() == 47
    t.clear()
    assert t.query().count() == 0 and t.df().schema.names == PERSON.schema.names


def test_modify_and_delete_where(engine):
    t = engine.table("person")
    t.add_range(rows())
    n = sum(r["Name"] == "Jack" for r in rows())
    assert t.modify(field("Name") == "Jack", {"YearsOld": 1}) == n and t.query().where(field("Age") == 1).to_df().count() == n
    assert t.modify(field("Name") == "Nobody", {"Name": "x"}) == 0
    assert t.delete_where(field("Name") == "Jack") == n and t.query().count() == 48 - n
    assert t.delete_where(field("Name") == "Jack") == 0
    for bad_change in ({"Id": 3}, {"Secret": "x"}):
        with pytest.raises(ValueError):
            t.modify(True, bad_change)


def test_compound_key(engine):
    t = engine.table("pair")
    t.add_range([{"a": 1, "b": "x", "v": 1.0}, {"a": 1, "b": "y", "v": 2.0}])
    with pytest.raises(KeyExists):
        t.add({"a": 1, "b": "y"})
    assert t.update({"a": 1, "b": "y", "v": 5.0}) == 1 and t.query().get(1, "y")["v"] == 5.0
    assert t.delete({"a": 1, "b": "x"}) == 1 and t.query().count() == 1


def test_readers_keep_their_snapshot(engine):
    t = engine.table("person")
    t.add_range(rows())
    before = t.df()
    t.delete({"_id": 1})
    t.clear()
    assert before.count() == 48


def test_of_two_writers_that_read_the_same_version_one_fails(engine, monkeypatch):
    t, other = engine.table("pair"), engine.table("pair")
    t.add_range([{"a": k, "b": "x", "v": 1.0} for k in range(5)])
    writes = [
        lambda w: w.delete_range([{"a": 0, "b": "x"}]), lambda w: w.add({"a": 90, "b": "x"}), lambda w: w.put([{"a": 1, "b": "x", "v": 3.0}]), lambda w: w.update({"a": 1, "b": "x", "v": 4.0}),
        lambda w: w.modify(field("a") == 2, {"v": 9.0}), lambda w: w.delete_where(field("a") == 3), lambda w: w.update_many([{"a": 4, "b": "x", "v": 2.0}]), lambda w: w.clear(),
    ]
    for n, write in enumerate(writes):
        seen = t.snapshot()
        other.put([{"a": 100 + n, "b": "y", "v": 1.0}])
        with monkeypatch.context() as m:
            m.setattr(t, "snapshot", lambda seen=seen: seen)
            with pytest.raises(Conflict):
                write(t)
        assert t.query().get(100 + n, "y") is not None
    assert t.query().count() == 5 + len(writes) and {r["v"] for r in t.df().collect()} == {1.0}


def test_a_row_rewrites_the_one_file_that_holds_it(engine):
    t = engine.table("pair")
    for n in range(4):
        t.add_range([{"a": 10 * n + k, "b": "x", "v": 1.0} for k in range(10)])
    before = t.snapshot().files
    for write, n in ((lambda: t.update({"a": 25, "b": "x", "v": 5.0}), 2), (lambda: t.put([{"a": 3, "b": "x", "v": 6.0}]), 2), (lambda: t.modify(field("a") == 37, {"v": 7.0}), 1), (lambda: t.delete({"a": 12, "b": "x"}), 1), (lambda: t.put([{"a": 99, "b": "x"}]), 1)):
        old = set(t.snapshot().files)
        write()
        new = set(t.snapshot().files)
        assert len(new - old) <= n and len(old - new) <= 1
    assert len(before) == 4 and t.query().count() == 40 and sorted(r["v"] or 0 for r in t.df().collect())[-3:] == [5.0, 6.0, 7.0]


def test_rows_without_a_key_are_refused(engine):
    t = engine.table("pair")
    for write in (lambda: t.add({"a": 1}), lambda: t.add_range([{"a": 1, "b": "x"}, {"b": "y"}]), lambda: t.put([{"b": "x"}]), lambda: t.update_many([{"a": 1}])):
        with pytest.raises(KeyMissing):
            write()
    assert t.query().count() == 0 and t.update({"a": None, "b": "x"}) == 0
    people = engine.table("person")
    people.put([{"guid": "a"}, {"guid": "b", "_id": 7}])
    assert ids(people) == [7, 8]


def test_unique_values_hold_on_every_write(engine):
    t = engine.table("person")
    t.add_range([{"_id": k, "guid": f"g{k}"} for k in range(1, 5)])
    for write in (
        lambda: t.put([{"_id": 1, "guid": "g2"}]), lambda: t.put([{"_id": 9, "guid": "n"}, {"_id": 10, "guid": "n"}]), lambda: t.update({"_id": 1, "guid": "g3"}),
        lambda: t.modify(field("_id") == 1, {"guid": "g4"}), lambda: t.modify(field("_id") < 3, {"guid": "same"}), lambda: t.update_many([{"_id": 1, "guid": "g2"}]), lambda: t.add({"guid": "g1"}),
    ):
        with pytest.raises(KeyExists):
            write()
    assert t.put([{"_id": 1, "guid": "g1", "Name": "own value stays"}]) == 1 and t.modify(field("_id") == 1, {"guid": "new"}) == 1 and t.put([{"_id": 6}, {"_id": 7}]) == 2
    assert sorted(r["guid"] or "" for r in t.df().collect()) == ["", "", "g2", "g3", "g4", "new"]


def test_changes_by_key(engine):
    t = engine.table("person")
    t.add_range([{"_id": k, "guid": f"g{k}", "Name": "n", "Age": k} for k in range(1, 5)])
    assert t.update_many([{"_id": 1, "Name": "x"}, {"Id": 2, "YearsOld": None}, {"_id": 1, "Age": 50}, {"_id": 99, "Name": "absent"}]) == 2
    assert [(r["Name"], r["Age"]) for r in t.df().orderBy("_id").collect()] == [("x", 50), ("n", None), ("n", 3), ("n", 4)]
    assert t.update_many([]) == 0 and t.update_many([{"_id": 99}]) == 0


def test_a_dict_means_equal_values(engine):
    t = engine.table("pair")
    t.add_range([{"a": k, "b": "xy"[k % 2], "v": float(k // 2)} for k in range(8)])
    assert [r["a"] for r in t.query().where({"b": "y", "v": 1.0}).to_list()] == [3]
    assert len(t.query().where({}).to_list()) == 8 and t.delete_where({"v": 3.0}) == 2


def test_multi_entry_index(spark):
    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("tags", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", None]), (3, None), (4, [])], schema)
    q = Query(TableDef("t", schema, ("k",), multi_entry=("tags",)).validate(), lambda: df)
    assert sorted(r.tags for r in q.keys("tags").collect()) == ["a", "b", "b"] and sorted(r.tags for r in q.keys("tags", unique=True).collect()) == ["a", "b"]
    assert [r.k for r in q.where(field("tags").has("b")).to_list()] == [1, 2]
    with pytest.raises(SchemaError):
        TableDef("t", schema, ("k",), multi_entry=("k",)).validate()


def test_deleting_all_spares_other_folders(engine):
    engine.create_databases()
    engine.files.make(f"{engine.root}/no database")
    engine.delete_all()
    assert engine.files.names(engine.root) == ["no database"]


def test_dense_numbers(spark):
    df = numbered(spark.range(0, 1000, 1, 7).filter("id % 3 = 0"), "n", 5, T.LongType())
    assert sorted(r.n for r in df.collect()) == list(range(5, 5 + 334))


def test_date_key_and_databases(engine):
    import datetime as dt

    t = engine.table("car")
    assert t.path.endswith("/garage/car")
    t.add_range([{"Created": dt.date(2024, 1, k), "Brand": str(k)} for k in (1, 2, 3)])
    assert [r["Brand"] for r in t.query().order_by("Created").skip(1).to_list()] == ["2", "3"]
    other = engine.table("car", "second")
    assert other.query().count() == 0 and engine.open_databases() == ["garage", "second"]
    db = engine.database("garage")
    assert db.exists() and db.is_open() and db.schema()["tables"][1]["primary_key"] == ["Created"]
    db.close()
    assert not db.is_open()
    db.open()
    db.delete()
    assert not db.exists() and not db.is_open()
    with pytest.raises(FileNotFoundError):
        db.open()
    engine.create_databases()
    assert engine.database("garage").exists()
    assert engine.storage_estimate().usage > 0 and engine.storage_estimate().quota_mb > 1
    engine.close_all()
    assert engine.open_databases() == []
    engine.delete_all()
    assert not engine.database("garage").exists()


def bad(**changes):
    base = {"name": "t", "schema": T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("x", T.StringType()), T.StructField("n", T.StructType([T.StructField("y", T.StringType())]))]), "primary_key": ("k",)}
    return TableDef(**(base | changes))


@pytest.mark.parametrize(
    "changes",
    [
        {"schema": T.StructType([])}, {"primary_key": ()}, {"primary_key": ("k", "k")}, {"primary_key": ("x",)}, {"primary_key": ("n",)}, {"primary_key": ("gone",)}, {"auto_increment": True, "primary_key": ("k", "x")}, {"unique": ("k",)}, {"indexes": ("gone",)},
        {"indexes": ("x",), "unique": ("x",)}, {"compound_indexes": (("x",),)}, {"compound_indexes": (("x", "x"),)}, {"compound_indexes": (("k", "x"), ("x", "k"))}, {"not_mapped": frozenset({"k"})},
    ],
)
def test_validation(changes):
    bad().validate()
    with pytest.raises(SchemaError):
        bad(**changes).validate()


def test_registry():
    with pytest.raises(SchemaError):
        Registry(PERSON, PERSON)
    r = Registry(PERSON, CAR)
    assert [d.name for d in r.databases()] == ["default", "garage"] and r.table("car").default_database.name == "garage" and PERSON.indexed >= {"_id", "Age", "Born", "guid", "Name", "TestInt"}
    assert len(r.tables()) == 2 and PERSON.store_schema()["unique"] == ["guid"]
