import hashlib
import random
import tempfile
from collections import defaultdict

import pytest
from conftest_llm import EDGE

from keystrata.llm.exact_dedup import NODE_BYTES, Patricia, exact_groups, owner_rule


def brute(rows, choose):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = choose(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_edges_both_owner_rules(make_docs):
    for smallest, choose in ((False, max), (True, min)):
        got = [tuple(r) for r in exact_groups(make_docs(EDGE), smallest=smallest).collect()]
        assert sorted(got, key=str) == brute(EDGE, choose)


def test_random_groups_with_tiny_budget(make_docs):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = [(k, rng.choice(pool)) for k in range(900)] + [(k, "hot") for k in range(900, 1400)]
    got = [tuple(r) for r in exact_groups(make_docs(rows), smallest=False, budget=9_000).collect()]
    assert sorted(got, key=str) == brute(rows, max)


def test_empty_table(make_docs):
    assert exact_groups(make_docs([])).collect() == []


def even(rng, k):
    return bytes([97 + k % 16]) + rng.randbytes(80)


SHAPES = {
    "three letters": (lambda rng, k: bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))), 4000, 60_000),
    "random bytes": (lambda rng, k: rng.randbytes(rng.randint(0, 400)), 4000, 100_000),
    "even first letters": (even, 6000, 200_000),
    "nested prefixes": (lambda rng, k: b"a" * (k % 4000), 6000, 200_000),
    "long keys": (lambda rng, k: b"x" * 40_000 + rng.randbytes(60_000), 40, 100_000),
    "keys longer than the budget": (lambda rng, k: bytes([k % 7]) * 30_000 + bytes([k % 11]), 200, 5_000),
    "two heavy branches": (lambda rng, k: b"ab"[k % 2 : k % 2 + 1] * 50 + rng.randbytes(20), 3000, 20_000),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_trie_spills_below_its_budget_and_keeps_everything(shape, monkeypatch):
    make, n, budget = SHAPES[shape]
    rng = random.Random(1)
    keys = [make(rng, k) for k in range(n)]
    keys += rng.choices(keys, k=n // 4)
    longest, files, heaviest = max(map(len, keys)), [], [0]
    real, insert = tempfile.TemporaryFile, Patricia.insert

    def opened():
        files.append(real())
        return files[-1]

    def weighed(trie, key, payload):
        insert(trie, key, payload)
        heaviest[0] = max(heaviest[0], trie.root.weight)

    monkeypatch.setattr("keystrata.llm.exact_dedup.tempfile.TemporaryFile", opened)
    monkeypatch.setattr(Patricia, "insert", weighed)
    trie, want = Patricia(owner_rule(True), budget), {}
    for k, key in enumerate(keys):
        trie.insert(key, (k, 1, 1))
        old = want.get(key, (k, 0, 1))
        want[key] = (min(old[0], k), old[1] + 1, 1)
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want
    assert files and heaviest[0] <= budget + longest + 3 * NODE_BYTES
