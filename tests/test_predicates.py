import datetime as dt

import pytest
from people import PERSON, rows

from keystrata import Query, all_of, any_of, field
from keystrata.functions.expressions import Predicate, condition, logical
from keystrata.functions.predicates import OPERATIONS

DATA = rows()
f = field
DAY = dt.date(1983, 4, 4)


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame([tuple(r[c] for c in PERSON.schema.names) for r in DATA], PERSON.schema).cache()
    return Query(PERSON, lambda: df)


def leaf(name, op, value=None, case=True):
    return Predicate(condition(name, op, value, case))


def has(test):
    return lambda r, k: r[k] is not None and test(r[k])


CASES = [
    (f("Age") == 27, lambda r: r["Age"] == 27), (f("Name") != "Jack", lambda r: r["Name"] != "Jack"), (~(f("Name") == "Jack"), lambda r: r["Name"] != "Jack"), (~(f("Name") != "Jack"), lambda r: r["Name"] == "Jack"),
    (f("Name") == None, lambda r: r["Name"] is None), (f("Name") != None, lambda r: r["Name"] is not None), (f("Name").is_null() | f("Born").is_not_null(), lambda r: r["Name"] is None or r["Born"] is not None),  # noqa: E711
    (~(f("Age") > 30), lambda r: not r["Age"] > 30), (30 < f("Age"), lambda r: r["Age"] > 30), (~(f("Age") <= 30), lambda r: r["Age"] > 30),
    (f("Name").contains("a"), lambda r: has(lambda v: "a" in v)(r, "Name")), (f("Name").contains("A", ignore_case=True), lambda r: has(lambda v: "a" in v.lower())(r, "Name")), (~f("Name").contains("a"), lambda r: has(lambda v: "a" not in v)(r, "Name")),
    (f("Name").starts_with("J"), lambda r: has(lambda v: v.startswith("J"))(r, "Name")), (f("Name").starts_with("J", ignore_case=True), lambda r: has(lambda v: v.lower().startswith("j"))(r, "Name")), (~f("Name").starts_with("J"), lambda r: has(lambda v: not v.startswith("J"))(r, "Name")),
    (f("Name").ends_with("K", ignore_case=True), lambda r: has(lambda v: v.lower().endswith("k"))(r, "Name")), (~f("Name").ends_with("k"), lambda r: has(lambda v: not v.endswith("k"))(r, "Name")),
    (f("Name").equals("jack"), lambda r: r["Name"] == "jack"), (f("Name").equals("JACK", ignore_case=True), lambda r: has(lambda v: v.lower() == "jack")(r, "Name")), (~f("Name").equals("JACK", ignore_case=True), lambda r: not has(lambda v: v.lower() == "jack")(r, "Name")),
    (f("Age").is_in([21, 34, 40]), lambda r: r["Age"] in (21, 34, 40)), (f("Name").is_in(["Bo", None]), lambda r: r["Name"] in ("Bo", None)), (f("Age").is_in([]), lambda r: False), (~f("Age").is_in([21, 34]), lambda r: r["Age"] not in (21, 34)), (~f("Age").is_in([]), lambda r: True),
    (f("Name").length > 3, lambda r: has(lambda v: len(v) > 3)(r, "Name")), (f("Name").length != 3, lambda r: has(lambda v: len(v) != 3)(r, "Name")), (~(f("Name").length == 3), lambda r: has(lambda v: len(v) != 3)(r, "Name")), (f("Tags").length >= 2, lambda r: has(lambda v: len(v) >= 2)(r, "Tags")),
    (f("Born").year == 1983, lambda r: has(lambda v: v.year == 1983)(r, "Born")), (f("Born").year != 1983, lambda r: has(lambda v: v.year != 1983)(r, "Born")), (~(f("Born").year > 1983), lambda r: has(lambda v: v.year <= 1983)(r, "Born")), (f("Born").year >= 1983, lambda r: has(lambda v: v.year >= 1983)(r, "Born")), (f("Born").year < 1983, lambda r: has(lambda v: v.year < 1983)(r, "Born")),
    (f("Born").month == 4, lambda r: has(lambda v: v.month == 4)(r, "Born")), (f("Born").day <= 10, lambda r: has(lambda v: v.day <= 10)(r, "Born")), (f("Born").day_of_year != 100, lambda r: has(lambda v: v.timetuple().tm_yday != 100)(r, "Born")), (f("Born").day_of_week == 0, lambda r: has(lambda v: v.isoweekday() % 7 == 0)(r, "Born")), (f("Born").day_of_week > 3, lambda r: has(lambda v: v.isoweekday() % 7 > 3)(r, "Born")),
    (f("Born").date == DAY, lambda r: has(lambda v: v.date() == DAY)(r, "Born")), (f("Born").date != DAY, lambda r: r["Born"] is None or r["Born"].date() != DAY), (f("Born").date > DAY, lambda r: has(lambda v: v.date() > DAY)(r, "Born")), (f("Born").date <= DAY, lambda r: has(lambda v: v.date() <= DAY)(r, "Born")), (f("Born").date >= "1983-04-04T10:00:00", lambda r: has(lambda v: v.date() >= DAY)(r, "Born")), (f("Born").date < dt.datetime(1983, 4, 4, 5), lambda r: has(lambda v: v.date() < DAY)(r, "Born")),
    (f("Born") > dt.datetime(1983, 4, 4, 1), lambda r: has(lambda v: v > dt.datetime(1983, 4, 4, 1))(r, "Born")),
    (f("Tags").has(3), lambda r: has(lambda v: 3 in v)(r, "Tags")), (f("Flag").is_true(), lambda r: r["Flag"]), (f("YearsOld") == 27, lambda r: r["Age"] == 27),
    (leaf("Age", "TypeOfNumber"), lambda r: True), (leaf("Name", "TypeOfString"), lambda r: r["Name"] is not None), (leaf("Born", "TypeOfDate"), lambda r: r["Born"] is not None), (leaf("Tags", "TypeOfArray"), lambda r: r["Tags"] is not None), (leaf("Nested", "TypeOfObject"), lambda r: True), (leaf("Raw", "TypeOfBlob"), lambda r: True), (leaf("Raw", "TypeOfArrayBuffer"), lambda r: True), (leaf("Raw", "TypeOfFile"), lambda r: False),
    (leaf("Name", "NotTypeOfString"), lambda r: r["Name"] is None), (leaf("Age", "NotTypeOfString"), lambda r: True), (~leaf("Tags", "TypeOfArray"), lambda r: r["Tags"] is None),
    (f("Secret") == "x", lambda r: False),
    (~((f("Age") > 30) & (f("Name") == "Jack")), lambda r: not (r["Age"] > 30 and r["Name"] == "Jack")), (~((f("Age") > 30) | f("Name").contains("a")), lambda r: not r["Age"] > 30 and has(lambda v: "a" not in v)(r, "Name")),
    (any_of([21, 28], lambda v: f("Age") == v), lambda r: r["Age"] in (21, 28)), (all_of(["a", "c"], lambda v: f("Name").contains(v)), lambda r: has(lambda v: "a" in v and "c" in v)(r, "Name")), (any_of([], lambda v: f("Age") == v), lambda r: False), (all_of([], lambda v: f("Age") == v), lambda r: True),
    (f("Age").between(25, 31), lambda r: 25 <= r["Age"] < 31), (f("Age").between(25, 31, False, True), lambda r: 25 < r["Age"] <= 31), (f("Age").in_any_range([(20, 22), (30, 33)]), lambda r: 20 <= r["Age"] < 22 or 30 <= r["Age"] < 33),
    (f("Name").none_of(["Jack", "Bo"]), lambda r: r["Name"] not in ("Jack", "Bo")), (f("Name").starts_with_any_of(["ja", "Z"], ignore_case=True), lambda r: has(lambda v: v.lower().startswith(("ja", "z")))(r, "Name")), (f("Name").is_in_ignoring_case(["JACK", "bo"]), lambda r: has(lambda v: v.lower() in ("jack", "bo"))(r, "Name")),
    ((f("Age") > 30) & True, lambda r: r["Age"] > 30), (False | (f("Age") > 30), lambda r: r["Age"] > 30),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_predicate(people, case):
    predicate, test = CASES[case]
    assert sorted(r["_id"] for r in people.where(predicate).to_list()) == [r["_id"] for r in DATA if test(r)]


def test_there_are_seventy_operations():
    assert len(OPERATIONS) == 70


def test_raw_trees_take_numbers_and_names(people):
    inner = [condition("Age", "GreaterThan", 30), condition("TestInt", "Equal", 9)]
    numbers = logical(1, [logical(0, inner), condition("Name", "Contains", "bo", False)])
    names = {"nodeType": "Logical", "operator": "Or", "children": [{"nodeType": "Logical", "operator": "And", "children": [{**x, "nodeType": "Condition"} for x in inner]}, {**condition("Name", "Contains", "bo", False), "nodeType": "Condition"}]}
    want = [r["_id"] for r in DATA if (r["Age"] > 30 and r["TestInt"] == 9) or "bo" in (r["Name"] or "").lower()]
    for tree in (numbers, names):
        assert sorted(r["_id"] for r in people.where(tree).to_list()) == want


def test_refusals(people):
    with pytest.raises(TypeError):
        f("Age") == f("TestInt")  # noqa: B015
    with pytest.raises(TypeError):
        bool(f("Age") == 1)
    with pytest.raises(ValueError):
        people.where(f("Unknown") == 1).to_df()
    with pytest.raises(ValueError):
        people.where(leaf("Age", "Resembles", 1)).to_df()
    with pytest.raises(ValueError):
        ~f("Tags").has(1)
    with pytest.raises(AttributeError):
        f("Born").century  # noqa: B018


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([tuple(r[c] for c in PERSON.schema.names) for r in DATA], PERSON.schema)
    df.write.parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    plan = Query(PERSON, lambda: read).where((f("Born").year == 1983) & (f("Age") > 30)).to_df().select("_id")._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "IsNotNull(Age)" in pushed and "GreaterThanOrEqual(Born,1983" in pushed and "LessThan(Born,1984" in pushed
    assert "guid" not in plan[plan.index("ReadSchema") :]
