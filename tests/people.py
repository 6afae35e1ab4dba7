"""A small keyed table with ties, repeated names, nulls and negative numbers, and a plain-Python model of queries over it."""

import datetime as dt

from pyspark.sql import types as T

from keystrata import TableDef

NAMES = "Ada Bo Cy Dee Jack Jane jack Zoe Ñandú".split()
PERSON = TableDef(
    "person",
    T.StructType(
        [
            T.StructField("_id", T.IntegerType(), False), T.StructField("Name", T.StringType()), T.StructField("Age", T.IntegerType()), T.StructField("TestInt", T.IntegerType()), T.StructField("Born", T.TimestampNTZType()),
            T.StructField("Tags", T.ArrayType(T.IntegerType())), T.StructField("Nested", T.StructType([T.StructField("Value", T.StringType())])), T.StructField("guid", T.StringType()), T.StructField("Flag", T.BooleanType()), T.StructField("Raw", T.BinaryType()),
        ]
    ),
    ("_id",), auto_increment=True, indexes=("Name", "TestInt"), unique=("guid",), compound_indexes=(("Age", "Born"),), column_names={"Id": "_id", "YearsOld": "Age"}, not_mapped=frozenset({"Secret"}),
)


def rows():
    out = []
    for k in range(1, 49):
        born = None if k % 3 else dt.datetime(1980 + k % 7, 1 + k % 12, 1 + k % 28, (k * 5) % 24 if k % 2 else 0)
        out.append({"_id": k, "Name": None if k % 17 == 0 else NAMES[k % len(NAMES)], "Age": 20 + k * 7 % 23, "TestInt": 9 if k % 2 else k - 20, "Born": born, "Tags": None if k % 5 == 0 else [k % 4, k % 6], "Nested": {"Value": str(k)}, "guid": f"g{k}", "Flag": k % 4 == 0, "Raw": bytes([k])})
    return out


def sort_rows(data, keys):
    """Stable sorts from the last key to the first; null is smallest."""
    for name, down in reversed(keys):
        data = sorted(data, key=lambda r: (r[name] is not None, r[name] if r[name] is not None else 0), reverse=down)
    return data


def model(data, test, order=None, down=False, stable=False, skip=0, take=None, tail=None, single=None, implied=()):
    """What a query means, said with lists."""
    found = [r for r in data if test(r)]
    if order:
        keys = [(order, down), ("_id", down)]
    else:
        keys = [*(() if stable else [(c, False) for c in implied]), ("_id", False)]
    found = sort_rows(found, keys)
    if tail is not None:
        found = found[len(found) - min(tail, len(found)) :]
    found = found[skip:]
    if take is not None:
        found = found[:take]
    if single == "first":
        found = found[:1]
    if single == "last":
        found = found[-1:]
    return [r["_id"] for r in found]
