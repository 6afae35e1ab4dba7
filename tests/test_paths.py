"""Generated step sequences against the list model, in order."""

import itertools

import pytest
from people import PERSON, model, rows

from keystrata import Query, field
from keystrata.operators.query import GRAMMAR, _next

DATA = rows()
f = field
BLUEPRINTS = [
    ((f("TestInt") > 2) & ((f("Name") == "Jack") | (f("Age") > 30)), lambda r: r["TestInt"] > 2 and (r["Name"] == "Jack" or r["Age"] > 30), ("TestInt", "Name", "Age"), "TestInt", 5, 4, 2),
    (f("TestInt") > 2, lambda r: r["TestInt"] > 2, ("TestInt",), "Age", 2, 1, 1),
    ((f("Flag").is_true()) | (f("guid") == "g3"), lambda r: r["Flag"] or r["guid"] == "g3", ("guid",), "Name", 30, 3, 4),
]
STEPS = {"where": ["where"], "cursor": ["cursor"], "take": ["take"], "takeLast": ["takeLast"], "skip": ["skip"], "order": ["up", "down"], "stable": ["stable"], "single": ["first", "last"]}


def paths(depth=5):
    out, open_ends = [], [((), "table")]
    for _ in range(depth):
        grown = []
        for path, stage in open_ends:
            for step in GRAMMAR[stage]:
                for name in STEPS.get(step, []):
                    if path.count(name) < 2:
                        grown.append(((*path, name), _next(stage, step)))
        out += [p for p, _ in grown]
        open_ends = grown
    return out


PATHS = paths()


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame([tuple(r[c] for c in PERSON.schema.names) for r in DATA], PERSON.schema).coalesce(2).cache()
    return Query(PERSON, lambda: df, strict=True)


def run(q, path, b):
    predicate, test, implied, order, take, tail, skip = b
    seen, means = (), {"test": lambda r: True}
    for name in path:
        if name in ("where", "cursor"):
            q = getattr(q, name)(predicate)
            seen, means["test"] = implied, test
        elif name in ("up", "down"):
            q = q.order_by(order) if name == "up" else q.order_by_descending(order)
            means |= {"order": order, "down": name == "down"}
        elif name == "stable":
            q, means["stable"] = q.stable_ordering(), True
        elif name == "take":
            q, means["take"] = q.take(take), take
        elif name == "takeLast":
            q, means["tail"] = q.take_last(tail), tail
        elif name == "skip":
            q, means["skip"] = q.skip(skip), skip
        else:
            means["single"] = name
    got = (q.first_df() if means.get("single") == "first" else q.last_df() if means.get("single") == "last" else q.to_df()).select("_id").collect()
    return [r["_id"] for r in got], model(DATA, implied=seen, **means)


@pytest.mark.parametrize("blueprint", range(len(BLUEPRINTS)))
def test_paths(people, blueprint):
    for path in PATHS[:: 1 if blueprint == 0 else 3]:
        got, want = run(people, path, BLUEPRINTS[blueprint])
        windowed = set(path) & {"take", "takeLast", "skip", "up", "down", "stable", "first", "last"}
        assert (got if windowed else sorted(got)) == (want if windowed else sorted(want)), path


def test_paths_are_many():
    assert len(PATHS) > 150 and {"where", "cursor", "up", "down", "stable", "take", "takeLast", "skip", "first", "last"} == set(itertools.chain(*PATHS))


def test_grammar_refuses_and_permissive_accepts(people):
    with pytest.raises(ValueError):
        people.where(f("Age") > 3).order_by("Age")
    with pytest.raises(ValueError):
        people.take(3).take(2)
    with pytest.raises(ValueError):
        people.skip(3).take(2)
    loose = Query(people.table, people.source)
    a = loose.skip(2).take(3).order_by("Age").where(f("Age") > 25).to_df().select("_id").collect()
    b = loose.where(f("Age") > 25).order_by("Age").take(3).skip(2).to_df().select("_id").collect()
    assert a == b
    for bad in (lambda: loose.order_by("Age").order_by("Name"), lambda: loose.take(-1), lambda: loose.take(1).take_last(1).to_df(), lambda: loose.additions([{"additionFunction": "sideways"}])):
        with pytest.raises(ValueError):
            bad()


def test_tie_break_is_a_choice(people):
    loose = Query(people.table, people.source, tie_break="asc")
    got = [r["_id"] for r in loose.order_by_descending("TestInt").take(6).to_df().collect()]
    nine = sorted(r["_id"] for r in DATA if r["TestInt"] == 9)
    above = [r["_id"] for r in sorted(DATA, key=lambda r: -r["TestInt"]) if r["TestInt"] > 9]
    assert got == [*above, *nine][:6]


def test_terminals(people):
    assert people.count() == len(DATA)
    assert sorted(r["_id"] for r in people.rows()) == [r["_id"] for r in DATA]
    assert people.where(f("Age") > 1000).first_or_default() is None and people.where(f("Age") > 1000).to_list() == []
    assert people.first_or_default(f("Age") > 40)["_id"] == model(DATA, lambda r: r["Age"] > 40, implied=("Age",), single="first")[0]
    assert people.last_or_default(f("guid") == "g7")["_id"] == 7
    assert people.get(5)["guid"] == "g5" and people.get(500) is None
    assert [r["_id"] for r in people.order_by("Age").take(10).filter_after(lambda df: df["Flag"]).collect()] == [k for k in model(DATA, lambda r: True, order="Age", take=10) if k % 4 == 0]
    with pytest.raises(ValueError):
        people.get(1, 2)


def test_take_plans_as_top_k(people):
    plan = people.order_by("Age").take(3).skip(2).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    skipped = people.order_by("Age").skip(2).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in skipped


@pytest.mark.parametrize(("order", "down"), [("Name", False), ("Name", True), ("Born", False), ("Age", True), (None, False)])
def test_until(people, order, down):
    q = Query(people.table, people.source)
    q = q if order is None else q.order_by_descending(order) if down else q.order_by(order)
    for stop, test in ((f("TestInt") == 20, lambda r: r["TestInt"] == 20), (f("Name") == None, lambda r: r["Name"] is None), (f("Age") > 99, lambda r: False)):  # noqa: E711
        ordered = model(DATA, lambda r: True, order=order, down=down)
        want = list(itertools.takewhile(lambda k: not test(DATA[k - 1]), ordered))
        assert [r["_id"] for r in q.until(stop).collect()] == want


def test_keys(people):
    q = Query(people.table, people.source)
    assert sorted(r["_id"] for r in q.where(f("Flag")).primary_keys().collect()) == [r["_id"] for r in DATA if r["Flag"]]
    assert sorted(r["Name"] for r in q.keys("Name", unique=True).collect()) == sorted({r["Name"] for r in DATA if r["Name"]})
    assert len(q.keys("Name").collect()) == sum(r["Name"] is not None for r in DATA)
    assert sorted(r["_id"] for r in q.get_many([(3,), (5,), (5,), (99,)]).collect()) == [3, 5]
