import random
import time

import numpy as np
import pytest
from conftest_llm import EDGE

from keystrata.llm.decontaminate import Index, aligned, contaminations, drop_contaminated, find, normalized

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def words(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edit(text, k, rng=RNG):
    chars = list(text)
    for _ in range(k):
        at = rng.randrange(len(chars))
        what = rng.choice("ids")
        if what == "i":
            chars.insert(at, "#")
        elif what == "d" and len(chars) > 1:
            del chars[at]
        else:
            chars[at] = "#"
    return "".join(chars)


def distance_inside(pattern, text):
    """Brute force: fewest edits between the pattern and any stretch of the text."""
    chars = np.array([ord(c) for c in text], np.int64)
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (chars != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def plain(text):
    return "".join(map(chr, normalized(text)[0]))


def test_banded_alignment_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(150):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(10, 40)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) + edit(pattern, rng.randint(0, 5), rng) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        p, t = (np.array([ord(c) for c in x], np.uint32) for x in (pattern, text))
        got = aligned(p, t, -len(p), len(t), 8)
        want = distance_inside(pattern, text)
        assert (got[0] if got else None) == (want if want <= 8 else None)
        if got:
            assert distance_inside(pattern, text[got[1] : got[2]]) == want


def test_filter_finds_what_brute_force_finds():
    rng = random.Random(7)
    items = [(k, words(rng.randint(8, 60), rng)) for k in range(12)]
    texts = []
    for _ in range(60):
        body = [words(rng.randint(0, 80), rng)]
        for _ in range(rng.randint(0, 2)):
            body += [edit(rng.choice(items)[1], rng.randint(0, 6), rng), words(rng.randint(0, 40), rng)]
        texts.append(" ".join(body))
    index = Index(items)
    got = {(d, o) for d, o, *_ in find(index, texts)}
    for d, text in enumerate(texts):
        for o in range(len(index.ids)):
            near = any(distance_inside("".join(map(chr, index.chars[o][b : b + m])), plain(text)) <= k for f, (b, m, k) in enumerate(zip(index.begin.tolist(), index.size.tolist(), index.budget.tolist(), strict=True)) if index.owner[f] == o)
            assert near == ((d, o) in got)


@pytest.mark.parametrize("length", [32, 40, 64, 92, 110, 130])
def test_excerpts_are_found_at_all_offsets(length):
    rng = random.Random(length)
    item, clean = words(70, rng)[:300].strip(), words(30, rng)
    excerpts = [item[k : k + length] for k in range(len(item) - length + 1)]
    excerpts = [x for x in excerpts if x == x.strip()]
    got = find(Index([(1, item)]), [f"{clean} # {x} # {clean}" for x in excerpts] + [clean])
    assert [d for d, *_ in got] == list(range(len(excerpts)))


def test_short_items_are_looked_up_exactly():
    index = Index([(1, " What is  it?"), (2, "ab"), (3, ""), (4, "ab"), (5, words(30)), (6, "你好"), (7, " \n")])
    texts = ["what\nIS it?", "so: What is it?!", "what is it", "somewhat is it?", "cab abc a b", "x (AB) ab.", "我你好吗", "ab", ""]
    got = sorted((d, index.ids[o], a, b, e) for d, o, a, b, e in find(index, texts))
    assert got == [(0, 1, 0, 11, 0), (1, 1, 4, 15, 0), (5, 2, 3, 9, 0), (5, 4, 3, 9, 0), (6, 6, 1, 3, 0), (7, 2, 0, 2, 0), (7, 4, 0, 2, 0)]
    assert [d for d, *_ in find(Index([(1, "ab")]), texts)] == [5, 7]


def rules(rng):
    """Texts that repeat themselves: rules, tables, lines over and over, with something else now and then."""
    unit = rng.choice(["-", "- ", "=-", "+---", "-" * 40 + "\n", "| a | b |\n", "ab " * 9 + "c\n"])
    text = unit * rng.randint(1, 400 // len(unit))
    at = rng.randrange(len(text))
    return rng.choice([text, text, text[:at] + rng.choice(["#", words(3, rng)]) + text[at:], text + words(9, rng) + text])


def test_repetitive_texts_give_the_same_matches():
    rng = random.Random(5)
    for _ in range(4):
        items, texts = [(k, rules(rng)) for k in range(6)], [rules(rng) for _ in range(8)]
        index = Index(items)
        got = {(d, index.ids[o]): rest for d, o, *rest in find(index, texts)}
        assert got == {(d, k): rest for k, item in items for d, _, *rest in find(Index([(k, item)]), texts)}
        for d, text in enumerate(texts):
            for o, b, m, k in zip(index.owner.tolist(), index.begin.tolist(), index.size.tolist(), index.budget.tolist(), strict=True):
                if distance_inside("".join(map(chr, index.chars[o][b : b + m])), plain(text)) <= k:
                    assert (d, index.ids[o]) in got


def test_equal_stretches_are_searched_at_their_first_and_last_place(monkeypatch):
    rng = random.Random(6)
    for _ in range(30):
        index, texts = Index([(k, rules(rng)) for k in range(4)]), [rules(rng) for _ in range(5)]
        got = find(index, texts)
        with monkeypatch.context() as m:
            m.setattr("keystrata.llm.decontaminate._unequal", lambda chars, starts, reach: np.ones(len(chars), bool))
            m.setattr("keystrata.llm.decontaminate._HITS", rng.choice([50, 1 << 40]))
            assert find(index, texts) == got


def test_a_megabyte_of_dashes_ends():
    index = Index([(k, "-" * 80) for k in range(12)] + [(20, "ab " * 30)])
    start = time.process_time()
    for text in ("-" * 1_000_000, ("-" * 80 + "\n") * 12_000):
        got = find(index, [text, "x"])
        assert [(d, o, a, e) for d, o, a, _, e in got] == [(0, o, 0, 0) for o in range(12)]
        assert all(len(text) - 4 <= b <= len(text) for _, _, _, b, _ in got)
    assert time.process_time() - start < 8


PASSAGE = words(40)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, PASSAGE), (2, None), (3, ""), (4, "short"), (5, words(50)), (6, PASSAGE), (None, words(45))]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, body string")


PLANTED = [(100, f"{words(30)} {PASSAGE} {words(10)}"), (101, f"{words(5)}\n{PASSAGE.upper()}"), (102, edit(PASSAGE, 3)), (103, PASSAGE.replace(" ", " \n ")), (104, words(900)), (105, PASSAGE[len(PASSAGE) // 4 :]), (100, PASSAGE), (None, PASSAGE)]


def test_planted_passages(make_docs, benchmark):
    got = contaminations(make_docs([*EDGE, *PLANTED]), benchmark, block_bytes=400).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted([(str(d), i) for d in (100, 100, 101, 102, 103, 105, None) for i in (1, 6)])
    text = dict(PLANTED[1:2])[101]
    spans = {(r.start, r.end, r.edits) for r in got if r.doc_id == 101}
    assert spans == {(text.index("\n") + 1, len(text), 0)}


def test_clean_documents_stay_with_their_columns(make_docs, benchmark):
    docs = make_docs([*EDGE, *PLANTED])
    kept = drop_contaminated(docs, benchmark, block_bytes=400)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in [*EDGE, *PLANTED] if PASSAGE not in (r[1] or "") and (r[0] or 0) not in (101, 102, 103, 105))


def test_empty_tables(spark, make_docs, benchmark):
    none = benchmark.limit(0)
    assert contaminations(make_docs([]), benchmark).collect() == []
    assert contaminations(make_docs(EDGE), none).collect() == []
    assert drop_contaminated(make_docs(EDGE), none).count() == len(EDGE)
