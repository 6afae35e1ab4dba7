"""Runs a registered query and its SQL over the same tables and compares the rows."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet' )" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def same(spark_df, con, sql):
    ours = spark_df.select(*sorted(spark_df.columns))
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in sorted(names)]
    theirs = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert sorted(names) == ours.columns
    mine = [tuple(r) for r in ours.collect()]
    assert len(mine) == len(theirs)
    mine, theirs = sorted(mine, key=_key), sorted(theirs, key=_key)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(x))), (a, b)
    return len(mine)
