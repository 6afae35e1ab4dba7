import random

import pytest
from conftest_llm import EDGE

from keystrata.llm.line_dedup import dedup_lines
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def brute(spark, rows):
    """Distinct lines in order; a line goes if it is within one word edit of an earlier distinct one."""
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for t in {r[1] or "" for r in rows}], "t string").select("t", F.xxhash64("t")).collect()}
    first = {}
    for doc_id, text, *_ in rows:
        for k, line in enumerate((text or "").split("\n")):
            words = tuple(line.encode().split())
            place = (doc_id is None, doc_id or 0, hashes[text or ""], k)
            if words:
                first[words] = min(place, first.get(words, place))
    near = {a for a, pa in first.items() for b, pb in first.items() if pb < pa and max(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1}
    out = []
    for doc_id, text, *_ in rows:
        lines, kept = (text or "").split("\n"), []
        for k, line in enumerate(lines):
            words = tuple(line.encode().split())
            if not words or (words not in near and first[words] == (doc_id is None, doc_id or 0, hashes[text or ""], k)):
                kept.append(line)
        out.append((doc_id, len(lines), len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 12))] for _ in range(12)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w) + 1)
                what = rng.choice("ird")
                if what == "i":
                    w.insert(at, rng.choice(words))
                elif w and at < len(w):
                    w[at : at + 1] = [] if what == "d" else [rng.choice(words)]
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((k, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, make_docs, seed):
    rows = [*corpus(seed), *((None if r[0] is None else r[0] + 500, *r[1:]) for r in EDGE if len(r[1] or "") < 10_000)]
    got = [tuple(r) for r in dedup_lines(spark, make_docs(rows)).collect()]
    assert sorted(got, key=str) == brute(spark, rows)


def test_long_line_and_hot_line(spark, make_docs):
    long = " ".join(f"w{k % 701}" for k in range(15_000))
    rows = [(k, "a line that very many documents share\nown line number %d of these documents here %d" % (k, k * k)) for k in range(700)]
    rows += [(1000, long), (1001, long + " more"), (1002, long.replace("w5 ", "w5x ", 1))]
    got = {r.doc_id: r for r in dedup_lines(spark, make_docs(rows)).collect()}
    assert sum(r.text.startswith("a line that") for r in got.values()) == 1 and got[0].n_kept == 2
    assert [got[k].n_kept for k in (1000, 1001, 1002)] == [1, 0, 0]
    assert all(got[k].n_kept == 1 for k in range(1, 700))


def test_runs_without_python(spark, make_docs):
    plan = dedup_lines(spark, make_docs(corpus(3)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark, make_docs):
    assert dedup_lines(spark, make_docs([])).collect() == []
