import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest_llm import EDGE

from keystrata.llm.mixing import GOLDEN, SPAN, apply_mix, mix_order, mix_sources


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Reshares what capped sources can't take until no target is above its cap."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        out = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in sizes}
        above = [s for s in free if out[s] > 3 * sizes[s]]
        if not above:
            return out
        capped |= set(above)


def brute(rows, slots):
    streams = defaultdict(list)
    for r in rows:
        streams[r[2]].append((hashlib.md5(f"{'null' if r[0] is None else r[0]}:mix".encode()).hexdigest(), -1 if r[0] is None else r[0], size_of(r[1])))
    sizes = {s: sum(x[2] for x in v) for s, v in streams.items()}
    targets, total = brute_targets(sizes), sum(sizes.values())
    ends, at = [], 0
    for s in sorted(sizes, key=lambda s: (s is None, s or "")):
        at += int(targets[s] / total * SPAN) if total else 0
        ends.append((at, s))
    own = defaultdict(list)
    for i in range(min(slots, total)):
        point = i * GOLDEN % SPAN
        s = next((s for end, s in ends if point < end), "none")
        if s != "none":
            own[s].append(i)
    out, order = [], []
    for number, (_, s) in enumerate(ends):
        words = [k for k, (_, _, size) in enumerate(sorted(streams[s])) for _ in range(size)]
        wanted = int(targets[s] + 0.5)
        slots_of = own[s] or ([slots + number] if wanted else [])
        taken, at = Counter(), 0
        for rank, slot in enumerate(slots_of):
            for _ in range(wanted // len(slots_of) + (rank < wanted % len(slots_of))):
                taken[words[at % len(words)]] += 1
                order.append((slot, sorted(streams[s])[words[at % len(words)]][1]))
                at += 1
        out += [(None if doc_id == -1 else doc_id, size, sizes[s], taken[k]) for k, (_, doc_id, size) in enumerate(sorted(streams[s]))]
    return sorted(out, key=str), targets, Counter(order)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    many = [(100 + k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["big"] * 12 + ["a", "ä", "zz", None, "tiny"])) for k in range(400)]
    return [*many, *(r for r in EDGE if len(r[1] or "") < 1000)]


@pytest.mark.parametrize("slots", [64, 1 << 18])
def test_against_brute_force(spark, make_docs, rows, slots):
    got = mix_sources(spark, make_docs(rows), slots=slots).collect()
    want, targets, order = brute(rows, slots)
    assert sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in got), key=str) == want
    for r in got:
        assert r.target == pytest.approx(targets[r.source], rel=1e-9)
        assert r.taken <= 3 * r.size
    pieces = Counter()
    for r in mix_order(spark, make_docs(rows), slots=slots).collect():
        assert r.words > 0 <= r.from_word
        pieces[r.slot, -1 if r.doc_id is None else r.doc_id] += r.words
    assert pieces == order


def test_taken_words_come_near_targets_and_reruns_agree(spark, make_docs, rows):
    docs = make_docs(rows)
    got = mix_sources(spark, docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    again = mix_sources(spark, docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_applied_mix(spark, make_docs, rows):
    docs = make_docs(rows)
    mixed = apply_mix(spark, docs)
    assert mixed.columns == docs.columns
    counts = Counter((r.doc_id, r.source) for r in mixed.collect())
    for r in mix_sources(spark, docs).collect():
        if r.doc_id is not None and r.doc_id >= 100:
            assert counts[r.doc_id, r.source] == (int(r.taken / r.size + 0.5) if r.size else 0)


def test_tiny_sources_beside_long_blocks_meet_their_targets(spark, make_docs):
    rng = random.Random(3)
    many = [(k, " ".join(["w"] * rng.randint(20, 60)), "big") for k in range(300)]
    tiny = [(1000 + 10 * s + k, "w " * (s + 2), f"tiny{s}") for s in range(6) for k in range(4)]
    docs = make_docs([*many, *tiny])
    taken, target = Counter(), {}
    for r in mix_sources(spark, docs, slots=16).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items()) and len(target) == 7
    counts = Counter(r.doc_id for r in apply_mix(spark, docs, slots=16).collect())
    assert all(counts[r[0]] == 3 for r in tiny)


def test_a_few_words_among_millions_meet_their_target(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "repeat('w ', 1000 + CAST(id % 7 AS INT)) AS text", "'big' AS source")
    docs = docs.unionByName(spark.createDataFrame([(10_000, "a b c d e", "tiny"), (10_001, "w " * 30, "small"), (10_002, "x", None)], "doc_id long, text string, source string"))
    got = mix_sources(spark, docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()
    assert {r.source: (r["sum(taken)"], r["max(target)"]) for r in got if r.source != "big"} == {"tiny": (15, 15.0), "small": (90, 90.0), None: (3, 3.0)}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.5 for r in got)


def test_empty_tables(spark, make_docs):
    assert mix_sources(spark, make_docs([])).collect() == []
    assert apply_mix(spark, make_docs([])).collect() == []
    assert [(r.taken, r.target) for r in mix_sources(spark, make_docs([(1, None, None), (2, " ", "a")])).collect()] == [(0, 0.0), (0, 0.0)]
