"""Toxic spans by a linear-chain conditional random field; scores by its marginals.

Labels exist for whole documents only. Words of toxic documents whose spelling (the word, its beginning or
its end) occurs in toxic documents far beyond chance, and hardly ever in others, are the labelled tokens of
the training lines. The field has two states, hashed spelling features and transitions, and is fitted by
full-batch gradient steps on a bounded sample of labelled rows (``positives`` and ``negatives`` documents at
most and ``most_bytes`` of text, by a hash of their id; one row an id). Scoring covers every token of every text: forward-backward marginals per line,
then per document the two greatest and the expected number of toxic tokens, mapped to 0..1 by a logistic
regression fitted on the same sample.

Defined results: a null text counts as empty; an empty text has no tokens and gets the score of a text
without evidence. Rows may repeat. With no labelled rows of one class every score is 0. A null id is never a
training row and counts as not held out. Other columns, labels among them, are never inputs of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.text import returning, slices, text_or_empty
from keystrata.sources.shared import fresh_folder

TOKEN = re.compile(r"\w+")
BITS = 20
MASK = (1 << BITS) - 1
WIDTH = 14
CACHE = 200_000
STEPS = 40


def spellings(word: str) -> list[str]:
    """The word, its beginnings of three to six letters, its ends of three to five, and its stems: beginnings that more letters follow."""
    n = len(word)
    return [f"w{word}", *(f"p{word[:k]}" for k in range(3, min(n, 6) + 1)), *(f"s{word[-k:]}" for k in range(3, min(n, 5) + 1)), *(f"q{word[:k]}" for k in range(4, min(n - 1, 8) + 1))]


def features(word: str) -> list[int]:
    """Hashed spellings and a bias; 0 pads, its weight stays 0."""
    out = [1 + (zlib.crc32(x.encode()) & MASK) for x in spellings(word)]
    return [*out, MASK + 2, *[0] * (WIDTH - 1 - len(out))]


def lines_of(text: str, pool: dict[str, str] | None = None) -> list[list[str]]:
    """Lower-case words by line; equal words are one object where a pool is given."""
    lines = [TOKEN.findall(line) for line in text.lower().split("\n")]
    return lines if pool is None else [[pool.setdefault(w, w) for w in line] for line in lines]


# --- evidence


def log_tail(a: int, n: int, rate: float) -> float:
    """Log of the chance that at least a of n documents are toxic, at the base rate (Chernoff's bound)."""
    share = a / n
    if share <= rate:
        return 0.0
    rest = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return -n * (share * math.log(share / rate) + rest)


#: Once in a text: nearly never elsewhere. Twice or more: at least so many times as often as elsewhere.
ONCE, TWICE = 50, 8


class _Spelled:
    """Texts as numbers of words, and per word the hashes of its spellings (of this process; 0 pads)."""

    def __init__(self, texts: list[list[list[str]]]) -> None:
        number: dict[str, int] = {}
        self.texts = [np.array([number.setdefault(w, len(number)) for line in text for w in line], np.int32) for text in texts]
        self.words = list(number)
        self.table = np.zeros((len(self.words), WIDTH), np.int64)
        for k, w in enumerate(self.words):
            own = [hash(s) for s in spellings(w)]
            self.table[k, : len(own)] = own

    def counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The spellings of a text and how often each occurs."""
        found, n = np.unique(self.table[self.texts[k]].ravel(), return_counts=True)
        return found[found != 0], n[found != 0]


def _tried(spelled: _Spelled, ones: list[int], together: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spellings of the toxic texts, and in how many each occurs once or more and twice or more; a few texts at a time."""
    keys, counts = np.zeros(0, np.int64), np.zeros((2, 0), np.int32)
    for k in range(0, len(ones), together):
        each = [spelled.counts(i) for i in ones[k : k + together]]
        found, which, n = np.unique(np.concatenate([f for f, _ in each]), return_inverse=True, return_counts=True)
        again = np.bincount(which[np.concatenate([n > 1 for _, n in each])], minlength=len(found))
        at = np.searchsorted(keys, found)
        new = np.ones(len(found), bool)
        new[at < len(keys)] = keys[at[at < len(keys)]] != found[at < len(keys)]
        counts[0, at[~new]] += n[~new].astype(np.int32)
        counts[1, at[~new]] += again[~new].astype(np.int32)
        keys = np.insert(keys, at[new], found[new])
        counts = np.insert(counts, at[new], np.stack([n[new], again[new]]).astype(np.int32), axis=1)
    return keys, counts[0], counts[1]


def _levels(spelled: _Spelled, toxic: list[int]) -> tuple[dict[str, tuple[int, int]], Callable[[int, int, int], bool]]:
    """Spellings that stand out, each with how many other texts have them and how much rarer they have to be there."""
    ones = [k for k, y in enumerate(toxic) if y]
    tried, once, twice = _tried(spelled, ones)
    limit = math.log(0.05) - math.log(max(1, 2 * len(tried)))
    enough = once >= 3
    keys, counts = tried[enough], (once[enough], twice[enough])
    others = np.zeros((2, len(keys)), np.int64)
    for k, y in enumerate(toxic):
        if not y and len(keys):
            found, n = spelled.counts(k)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            same = keys[at] == found
            others[0, at[same]] += 1
            others[1, at[same & (n > 1)]] += 1
    rate = len(ones) / len(toxic)

    def holds(n: int, z: int, least: int) -> bool:
        return n >= 3 and z * least <= n and log_tail(n, n + z, rate) < limit

    good: dict[int, tuple[int, int]] = {}
    for level, least in enumerate((ONCE, TWICE)):
        for j in np.flatnonzero((counts[level] >= 3) & (others[level] * least <= counts[level])).tolist():
            if int(keys[j]) not in good and holds(int(counts[level][j]), int(others[level, j]), least):
                good[int(keys[j])] = int(others[level, j]), least
    wanted, marked = np.array(list(good), np.int64), np.zeros(len(spelled.table), bool)
    for column in spelled.table.T:
        marked |= np.isin(column, wanted)
    return {s: good[hash(s)] for k in np.flatnonzero(marked).tolist() for s in spellings(spelled.words[k]) if hash(s) in good}, holds


def evidence(texts: list[list[list[str]]], toxic: list[int]) -> set[str]:
    """Spellings that mark toxic documents, by occurring at all or by recurring, beyond what so many spellings give by chance.

    Occurrences count once per neighbourhood (the word between its neighbours), so that copies of one
    document are no evidence. The spelling that explains most occurrences is taken first, the longest among
    equals; the others have to stand on what remains.
    """
    if len(set(toxic)) < 2:
        return set()
    levels, holds = _levels(_Spelled(texts), toxic)
    of_word: dict[str, list[str]] = {}
    places: dict[str, set[tuple]] = {s: set() for s in levels}
    for text, label in zip(texts, toxic, strict=True):
        for line in text if label else ():
            for k, w in enumerate(line):
                if w not in of_word:
                    of_word[w] = [s for s in spellings(w) if s in levels]
                for s in of_word[w]:
                    places[s].add((line[k - 1] if k else "", w, line[k + 1] if k + 1 < len(line) else ""))
    chosen: set[str] = set()
    while places:
        best = max(places, key=lambda s: (len(places[s]), len(s), s))
        if not holds(len(places[best]), *levels[best]):
            del places[best]
            continue
        chosen.add(best)
        explained = places.pop(best)
        places = {s: rest for s, own in places.items() if len(rest := own - explained) >= 3}
    return chosen


# --- the field


@dataclass
class Field:
    """Weights of the hashed features for state 1 (state 0 is the reference), and transitions."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(MASK + 3, np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0, 0.0]))


def _chunks(sizes: np.ndarray, most_cells: int = 1 << 20, most_rows: int = 8192) -> Iterator[np.ndarray]:
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((sizes > 0).sum())]
    at = 0
    while at < len(order):
        n = max(1, min(most_rows, most_cells // int(sizes[order[at]])))
        yield order[at : at + n]
        at += n


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for tokens laid end to end in lines of the given sizes; with ``pairs`` the expected moves."""
    odds = np.exp(np.clip(scores, -30, 30))
    step = np.exp(moves)
    out, expected = np.zeros(len(scores)), np.zeros((2, 2))
    starts = np.cumsum(sizes) - sizes
    for rows in _chunks(sizes):
        n, longest = sizes[rows], int(sizes[rows[0]])
        alive = np.searchsorted(-n, -np.arange(longest), side="left")  # lines longer than t, for each t
        at = starts[rows]
        ahead = np.zeros((longest, len(rows)))
        zero, one = np.ones(len(rows)), np.ones(len(rows))
        for t in range(longest):
            k = alive[t]
            x = odds[at[:k] + t]
            z, o = zero[:k], one[:k]
            if t:
                z, o = z * step[0, 0] + o * step[1, 0], z * step[0, 1] + o * step[1, 1]
            o = o * x
            o = o / (z + o)
            ahead[t, :k] = o
            zero[:k], one[:k] = 1 - o, o
        zero, one = np.ones(len(rows)), np.ones(len(rows))
        for t in range(longest - 1, -1, -1):
            k = alive[t]
            z, o = zero[:k], one[:k]
            a = ahead[t, :k]
            top = a * o
            out[at[:k] + t] = top / (top + (1 - a) * z)
            if t:
                o = o * odds[at[:k] + t]
                if pairs:
                    before = ahead[t - 1, :k]
                    cells = [(1 - before) * step[0, 0] * z, (1 - before) * step[0, 1] * o, before * step[1, 0] * z, before * step[1, 1] * o]
                    total = sum(cells)
                    expected += np.array([float((c / total).sum()) for c in cells]).reshape(2, 2)
                z, o = step[0, 0] * z + step[0, 1] * o, step[1, 0] * z + step[1, 1] * o
                both = z + o
                zero[:k], one[:k] = z / both, o / both
    return out, expected


def fit_field(lines: list[list[str]], labels: list[list[int]]) -> Field:
    """Maximum likelihood with a small ridge, by adaptive gradient steps over the whole sample."""
    model = Field()
    types = list(dict.fromkeys(w for line in lines for w in line))
    if not types:
        return model
    number = {w: k for k, w in enumerate(types)}
    table = np.array([features(w) for w in types], np.int64)
    tokens = np.array([number[w] for line in lines for w in line], np.int64)
    truth = np.array([y for line in labels for y in line], float)
    sizes = np.array([len(x) for x in lines], np.int64)
    inner = np.ones(len(tokens), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    previous = np.roll(truth, 1)
    seen = np.array([[float((inner & (previous == a) & (truth == b)).sum()) for b in (0, 1)] for a in (0, 1)])
    weights, moves = np.zeros(MASK + 3), np.zeros((2, 2))
    squares, move_squares = np.full(MASK + 3, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(STEPS):
        scores = weights[table].sum(1)[tokens]
        marginals, expected = forward_backward(scores, sizes, moves, pairs=True)
        by_type = np.bincount(tokens, truth - marginals, len(types))
        gradient = np.bincount(table.ravel(), np.repeat(by_type, WIDTH), MASK + 3) - 0.01 * weights
        gradient[0] = 0
        squares += gradient**2
        weights += 0.5 * gradient / np.sqrt(squares)
        change = seen - expected - 0.01 * moves
        change[0, 0] = 0
        move_squares += change**2
        moves += 0.2 * change / np.sqrt(move_squares)
    model.weights, model.moves = weights.astype(np.float32), moves
    return model


def summary(marginals: np.ndarray) -> list[float]:
    """What a document's score depends on: log-odds of its most and second most toxic token, and the expected number of them."""
    top = np.sort(marginals)[-2:] if len(marginals) < 3 else np.sort(np.partition(marginals, -2)[-2:])
    top = np.clip(np.concatenate([np.zeros(2 - len(top)), top]), 1e-7, 1 - 1e-7)
    second, first = np.log(top / (1 - top)).tolist()
    return [first, second, math.log1p(float(marginals.sum()))]


def fit_logistic(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Bias and weights, by Newton steps with a ridge."""
    x = np.column_stack([np.ones(len(points)), points])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[0.02] * points.shape[1]]) * max(1.0, len(points) / 100)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(hessian, x.T @ (labels - p) - ridge @ w)
    return w


class Scorer:
    """Scores texts with a fitted field; spelling scores of words are kept while there is room."""

    def __init__(self, model: Field) -> None:
        self.model, self.known = model, {}

    def _scores(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known = {}
                new = list(dict.fromkeys(words))
            for k in range(0, len(new), 50_000):
                part = new[k : k + 50_000]
                got = self.model.weights[np.array([features(w) for w in part], np.int64)].sum(1)
                self.known.update(zip(part, got.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, the marginals of its tokens in order."""
        lines = [lines_of(t) for t in texts]
        words = [w for text in lines for line in text for w in line]
        sizes = np.array([len(line) for text in lines for line in text], np.int64)
        all_of = forward_backward(self._scores(words), sizes, self.model.moves)[0]
        ends = np.cumsum([sum(map(len, text)) for text in lines])
        return np.split(all_of, ends[:-1]) if len(texts) else []

    def score(self, marginals: np.ndarray) -> float:
        z = float(self.model.logistic @ np.array([1.0, *summary(marginals)]))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def spans(text: str, marginals: np.ndarray, least: float = 0.5) -> list[dict]:
    """Places (code points of the text as it is) of tokens at least so likely toxic."""
    hot = np.flatnonzero(marginals >= least)
    if not len(hot):
        return []
    wanted, out, low = set(hot.tolist()), [], text.lower()
    at = range(len(text) + 1) if len(low) == len(text) else np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist()
    k = 0
    for m in TOKEN.finditer(low):  # a letter's small form may be several characters
        if k in wanted:
            out.append({"start": at[m.start()], "end": at[m.end() - 1] + 1, "marginal": float(marginals[k])})
        k += 1
    return out


def fit(texts: list[str], toxic: list[int]) -> Field:
    if len(set(toxic)) < 2:
        return Field()
    pool: dict[str, str] = {}
    lines = [lines_of(t, pool) for t in texts]
    marks = evidence(lines, toxic)
    hot = {w for w in pool if any(s in marks for s in spellings(w))}
    chosen, labels = [], []
    for text, y in zip(lines, toxic, strict=True):
        for k, line in enumerate(text):
            marked = [w in hot for w in line]
            if any(marked) or k % 4 == 0:  # other lines teach the reference state; a quarter of them is plenty
                chosen.append(line)
                labels.append([int(bool(y) and m) for m in marked])
    model = fit_field(chosen, labels)
    del lines, chosen, labels, pool
    scorer = Scorer(model)
    points = []
    for k in range(0, len(texts), 200):
        points += [summary(m) for m in scorer.marginals(texts[k : k + 200])]
    model.logistic = fit_logistic(np.array(points), np.array(toxic, float))
    return model


# --- Spark


def held_out(column: str = "doc_id"):
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 4000, most_bytes: int = 64 << 20) -> Field:
    """Fits on at most so many labelled documents of each class and so many bytes of text, chosen by a hash of the id.

    Of rows that repeat an id one counts, that with the smallest text. The sample is written to the shared
    folder, and only what keeps to the bounds comes to the driver.
    """
    spark = docs.sparkSession
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.filter("y = 1").orderBy(*order).limit(positives).unionByName(usable.filter("y = 0").orderBy(*order).limit(negatives))
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "chosen_id"))  # at most positives + negatives rows of two numbers
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text")).join(chosen, F.col("doc_id") == F.col("chosen_id"))
    folder = fresh_folder(spark, "toxicity")
    rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).write.parquet(folder)
    sample = spark.read.parquet(folder)
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = sample.select("doc_id", F.sum(F.octet_length("text")).over(so_far).alias("bytes")).filter(F.col("bytes") <= most_bytes).select("doc_id")
    got = sorted((r.doc_id, r.text, r.y) for r in sample.join(F.broadcast(kept), "doc_id", "left_semi").toLocalIterator())
    texts, toxic = [x[1] for x in got], [x[2] for x in got]
    del got
    return fit(texts, toxic)

_SCORED = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", _SPAN)])


def _score(model: Field, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text", most_bytes=4 << 20):
            texts = batch.column(2).to_pylist()
            marginals = scorer.marginals(texts)
            scores = [scorer.score(m) for m in marginals]
            found = [spans(t, m) for t, m in zip(texts, marginals, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, _SPAN)], schema=_SCHEMA)

    return run


def score_toxicity(docs: DataFrame, model: Field, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans, for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(returning(_score(model, threshold)), _SCORED)


def drop_toxic(docs: DataFrame, model: Field, threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that aren't predicted toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text", most_bytes=4 << 20):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array([scorer.score(m) < threshold for m in scorer.marginals(texts)], pa.bool_()))

    return docs.mapInArrow(returning(run), docs.schema)
