import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import EDGE

from keystrata.llm.components import components
from keystrata.llm.jaccard_join import HASHES, Shingler, jaccard_links, keep_one, least_matches, signature


def grams(text, n=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows):
    sets = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], min(ids) if ids else None, links[i]))
    return sorted(out, key=str)


def near_corpus(seed, bases=6, copies=25):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(40)]
    return rows


@pytest.fixture(scope="module")
def corpus():
    return [*near_corpus(4), *((1000 + (r[0] or -1), *r[1:]) if r[0] is not None else r for r in EDGE)]


def test_links_and_classes(spark, make_docs, corpus):
    got = [tuple(r) for r in jaccard_links(spark, make_docs(corpus), salts=4).collect()]
    assert sorted(got, key=str) == brute(corpus)


def test_small_blocks_lose_nothing(spark, make_docs, monkeypatch):
    monkeypatch.setattr("keystrata.llm.jaccard_join.BLOCK", 4)
    rows = near_corpus(9, bases=2, copies=30)
    assert sorted((tuple(r) for r in jaccard_links(spark, make_docs(rows)).collect()), key=str) == brute(rows)


def test_one_of_each_group_stays(spark, make_docs, corpus):
    docs = make_docs(corpus)
    kept = keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {c for _, c, _ in brute(corpus)}
    assert sorted(map(str, ids)) == sorted(map(str, classes))


def test_empty_table(spark, make_docs):
    assert jaccard_links(spark, make_docs([])).collect() == []
    assert keep_one(spark, make_docs([])).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 63, 600, np.uint64)
    for share in (0.3, 0.6, 0.9):
        other = own.copy()
        k = int(600 * (1 - share) / (1 + share))
        other[:k] = rng.integers(0, 1 << 63, k, np.uint64)
        assert abs((signature(own) == signature(other)).mean() - share) < 0.12


def test_pruning_keeps_pairs_at_the_threshold():
    limits = least_matches()
    rng = np.random.default_rng(1)
    matches = rng.binomial(1, 0.8, (20_000, HASHES)).cumsum(1)
    for n, least in limits.items():
        assert (matches[:, n - 1] >= least).all()
    assert all(0.3 * n < least for n, least in limits.items() if n >= 84)


def test_shingles():
    s = Shingler()
    assert len(s.shingles("")) == 0
    assert len(s.shingles("a b")) == 1
    assert len(s.shingles("a b c d e f")) == 2
    assert set(s.shingles("x y z a b c d e")) & set(s.shingles("a b c d e"))


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 140)]
    star = [(500, k) for k in range(501, 560)]
    got = {r.node: r.label for r in components(spark, spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 500 for k in range(500, 560)}}
