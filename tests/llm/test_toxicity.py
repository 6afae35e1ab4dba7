import itertools
import math
import re
import zlib

import numpy as np
import pytest
from conftest_llm import EDGE

from keystrata.llm.text import read_table
from keystrata.llm.toxicity import Field, drop_toxic, evidence, fit, forward_backward, lines_of, score_toxicity, spans, spellings, train

SF = "/root/testdata/sf0.1"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(5)
    moves, sizes = rng.normal(size=(2, 2)), np.array([4, 0, 1, 7, 2])
    scores = rng.normal(size=int(sizes.sum())) * 2
    got, expected = forward_backward(scores, sizes, moves, pairs=True)
    want, moved, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(scores[at + t] for t in range(n) if path[t]) + sum(moves[path[t - 1], path[t]] for t in range(1, n)))
            total += w
            ones += w * np.array(path)
            for t in range(1, n):
                pairs[path[t - 1], path[t]] += w
        want += list(ones / total)
        moved += pairs / total
        at += n
    assert np.allclose(got, want) and np.allclose(expected, moved)


def test_very_long_line_stays_finite():
    got, _ = forward_backward(np.full(30_000, 12.0), np.array([30_000]), np.full((2, 2), 0.5))
    assert np.isfinite(got).all() and got.min() > 0.9


def test_copies_are_no_evidence():
    texts, toxic = [], []
    for k in range(60):
        texts.append(f"plain words number{k} and copied0 phrase here" if k < 30 else f"so word{k} vile{k % 3}x other{k} and more")
        toxic.append(1)
    for k in range(200):
        texts.append(f"plain words clean{k} and nothing")
        toxic.append(0)
    marks = evidence([lines_of(t) for t in texts], toxic)
    assert any(m[1:].startswith("vile") for m in marks) and "wcopied0" not in marks


@pytest.fixture(scope="module")
def model(spark):
    return train(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    """Labels of these tables are noisy where no toxic word occurs; words that do occur have to be found."""
    labels = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
    rows = [r for r in score_toxicity(read_table(spark, SF, "documents"), model).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 1000 and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    hit = [labels[r.doc_id] for r in rows if r.predicted]
    assert sum(hit) / len(hit) > 0.9
    assert sum(hit) / sum(labels[r.doc_id] for r in rows) > 0.75
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_edges_and_spans(make_docs, model):
    rows = [*EDGE, (50, "well, you IDIOT, stupid moron\nand more")]
    docs = make_docs(rows)
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    toxic = next(r for r in got if r.doc_id == 50)
    assert toxic.predicted == 1 and rows[-1][1][toxic.spans[0].start : toxic.spans[0].end] == "IDIOT"
    assert all(not r.predicted and not r.spans for r in got if r.doc_id != 50) and not any(r.held_out for r in got if r.doc_id is None)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in EDGE)


def test_scores_ignore_everything_but_the_text(make_docs, model):
    a = {r.score for r in score_toxicity(make_docs([(k, "you idiot and clown", s) for k, s in ((1, "a"), (2, None), (3, "b"))]), model).collect()}
    assert len(a) == 1


def test_no_labels_and_no_rows(spark, make_docs):
    none = train(make_docs(EDGE), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in score_toxicity(make_docs(EDGE), none).collect()} == {0}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 5), (4, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in score_toxicity(make_docs(EDGE), train(make_docs(EDGE), odd)).collect()} == {0}
    assert score_toxicity(make_docs([]), Field()).collect() == [] and drop_toxic(make_docs([]), Field()).collect() == []


def brute_score(model, text):
    """A document's score, token by token and path by path in plain Python."""
    marginals = []
    for line in text.lower().split("\n"):
        words = re.findall(r"\w+", line)
        scores = [sum(float(model.weights[1 + (zlib.crc32(x.encode()) & ((1 << 20) - 1))]) for x in spellings(w)) + float(model.weights[(1 << 20) + 1]) for w in words]
        total, ones = 0.0, [0.0] * len(words)
        for path in itertools.product((0, 1), repeat=len(words)):
            weight = math.exp(sum(s for s, y in zip(scores, path, strict=True) if y) + sum(model.moves[a][b] for a, b in itertools.pairwise(path)))
            total += weight
            ones = [o + weight * y for o, y in zip(ones, path, strict=True)]
        marginals += [o / total for o in ones]
    second, first = (math.log(x / (1 - x)) for x in (min(max(p, 1e-7), 1 - 1e-7) for p in sorted([0.0, 0.0, *marginals])[-2:]))
    z = sum(w * x for w, x in zip(model.logistic, [1.0, first, second, math.log1p(sum(marginals))], strict=True))
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def test_scores_against_brute_force(make_docs, model):
    texts = ["", " ", "you idiot", "a calm word\nstupid moron here\n\nend", "İİ idiot ß", "tab\tidiot\nidiot idiot", None, "x y z one two three four five six"]
    got = score_toxicity(make_docs(list(enumerate(texts))), model).collect()
    for r in got:
        assert r.score == pytest.approx(brute_score(model, texts[r.doc_id] or ""), rel=1e-5, abs=1e-9)


def test_spans_are_places_in_the_text_as_it_is():
    text = "İİİ bad, ẞİx Bad"
    low = re.findall(r"\w+", text.lower())
    found = spans(text, np.array([float(w == "bad") for w in low]))
    assert [text[x["start"] : x["end"]] for x in found] == ["bad", "Bad"]


def test_the_sample_is_bounded(spark, make_docs):
    rows = [(k, f"vile{k} " * 50 if k % 4 == 0 else f"fine words {k}") for k in range(200)] + [(4, "vile again")] * 300
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr("keystrata.llm.toxicity.fit", lambda texts, toxic: seen.append((texts, toxic)) or Field())
        train(make_docs(rows), labels, positives=20, negatives=30)
        train(make_docs(rows), labels, positives=20, negatives=30, most_bytes=2000)
    assert sum(seen[0][1]) <= 20 and len(seen[0][1]) <= 50 and len(set(seen[0][0])) == len(seen[0][0])
    assert 0 < sum(len(t.encode()) for t in seen[1][0]) <= 2000


def test_fit_is_deterministic():
    texts = [f"good text number {k}" for k in range(80)] + [f"vile word{k} here" for k in range(20)]
    a, b = (fit(texts, [0] * 80 + [1] * 20) for _ in range(2))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.logistic, b.logistic)
    assert spans("plain", np.array([0.1])) == []
