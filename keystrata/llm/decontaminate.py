"""Benchmark passages in documents by q-gram filtering in diagonal bands and banded alignment.

Benchmark texts are cut into overlapping fragments, each with an edit budget of a share of its length; one begins
every so many characters as its budget, so that an excerpt is found wherever it is cut. A text
that holds a fragment within k edits shares at least m + 1 - q(k + 1) of its q-grams with it, all on k + 1
neighbouring diagonals; shared q-grams are counted in diagonal bands twice that wide, each overlapping the
next by half, so one band sees them all. Bands that reach the bound are verified by a banded alignment of the
fragment against that stretch of the text.

Repetitive text adds no work: fragments of equal characters are searched once for all benchmark texts that have
them, and where a text would hit the index often, only the first and the last of its equal stretches (and what
lies within a band of them) are searched. A result names the first place, the last place and the least
edits of a match, and equal stretches match alike, so it is the same. Hits are counted a bounded number at a time.

Texts are compared in lower case with runs of white space as one space; reported places are code points of
the text as it is. Benchmarks are taken in blocks of bounded size, one pass over the documents for each.

Benchmark texts shorter than ``least`` characters are looked up exactly: a hash of their compared characters
against those of stretches of the same length between word boundaries.

Defined results: null texts, null benchmark texts and those of white space alone match nothing. One row for each document row and benchmark row that match; rows that repeat are
reported as often. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.text import returning, slices, text_or_empty

Q = 10
FRAGMENT = 32
RATE = 0.08
LEAST = 32
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22
#: Fragments aligned at once, and hits counted at once.
_TOGETHER = 2048
_HITS = 4_000_000


def _small_letters() -> np.ndarray:
    """Per character of the basic plane its one-character lower case, white space as a space."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        out[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return out


_LOWER = _small_letters()


def _word_letters() -> np.ndarray:
    """Per character of the basic plane whether words of its script stand apart, so that a neighbour of the kind belongs to its word."""
    out = np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        out[c] = chr(c).isalnum() or unicodedata.category(chr(c)).startswith("M")
    for low, high in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)):
        out[low : high + 1] = False  # written without spaces: a boundary anywhere
    return out


_WORD = _word_letters()


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Compared characters, and where each stands in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(raw < 1 << 16, _LOWER[np.minimum(raw, (1 << 16) - 1)], raw)
    space = low == 32
    kept = np.flatnonzero(~(space & np.concatenate([[False], space[:-1]]))) if len(low) else np.zeros(0, np.int64)
    return low[kept], kept


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    wide = chars.astype(np.uint64)
    for k in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += wide[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _rolled(chars: np.ndarray) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for c in chars.astype(np.uint64):
        out = out * _FACTOR + c
    return out[0]


class Index:
    """The fragments of a block of benchmark texts and their q-grams. A q-gram's postings are places in texts; the fragments around a place are computed."""

    def __init__(self, items: list[tuple[Any, str]], q: int = Q, fragment: int = FRAGMENT, rate: float = RATE, least: int = LEAST) -> None:
        self.q, self.ids, self.chars = q, [], []
        length, stride, last = [], [], []
        brief: dict[int, dict[int, list[int]]] = {}
        late = []
        for item_id, text in items:
            chars = normalized(text.strip())[0]
            m = len(chars)
            if m < max(least, q):
                if m:
                    late.append((item_id, chars))
                continue
            self.ids.append(item_id)
            self.chars.append(chars)
            length.append(min(fragment, m))
            # The budget covers what an excerpt lacks at its nearest fragment, wherever it is cut.
            stride.append(max(1, min(int(rate * length[-1]), length[-1] // q - 1)))
            last.append(-(-(m - length[-1]) // stride[-1]))
        self.length, self.stride, self.last = (np.array(x, np.int64) for x in (length, stride, last))
        sizes = np.array([len(x) for x in self.chars], np.int64)
        self.base = np.cumsum(self.last + 1) - (self.last + 1)
        self.owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.last + 1)
        number = np.arange(len(self.owner)) - np.repeat(self.base, self.last + 1)
        self.size = self.length[self.owner].astype(np.int32)
        self.begin = np.minimum(number * self.stride[self.owner], (sizes - self.length)[self.owner]).astype(np.int32)
        self.budget = np.minimum((rate * self.size).astype(np.int32), np.maximum(0, self.size // q - 1))
        self.need = self.size + 1 - q * (self.budget + 1)
        self._share_equal_fragments()
        per = [grams(x, q) for x in self.chars]
        all_grams = np.concatenate(per) if per else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(per), dtype=np.int32), [len(x) for x in per])
        places = np.concatenate([np.arange(len(x), dtype=np.int32) for x in per]) if per else np.zeros(0, np.int32)
        low, n = self._around(owners, places)
        order = np.argsort(all_grams, kind="stable")
        order = order[n[order] > 0]
        self.low, self.n, self.places = low[order], n[order], places[order]
        self.grams, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.fragments = np.add.reduceat(self.n.astype(np.int64), self.first) if len(self.first) else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

        for item_id, chars in late:
            brief.setdefault(len(chars), {}).setdefault(int(_rolled(chars)), []).append(len(self.ids))
            self.ids.append(item_id)
            self.chars.append(chars)
        self.brief = {m: (np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for m, x in sorted(brief.items())}
        self.heads = np.unique(np.array([x[0] for _, x in late], np.uint32))

    def __len__(self) -> int:
        return len(self.owner)

    def _share_equal_fragments(self) -> None:
        """``distinct`` marks the first fragment of each content; ``sharers`` from ``share`` to the next one's are the texts that have it."""
        n = len(self.owner)
        joined = np.concatenate([*self.chars, np.zeros(1, np.uint32)])
        at = np.cumsum([0, *map(len, self.chars)])[self.owner] + self.begin if n else np.zeros(0, np.int64)
        hashed = self.size.astype(np.uint64)
        longest = int(self.size.max(initial=0))
        for k in range(longest):
            inside = k < self.size
            hashed = np.where(inside, hashed * _FACTOR + joined[np.minimum(at + k, len(joined) - 1)], hashed)
        _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        twin = first[which] if n else np.zeros(0, np.int64)
        same = self.size[twin] == self.size
        for k in range(longest):  # by their characters, whatever the hash says
            same &= (k >= self.size) | (joined[np.minimum(at + k, len(joined) - 1)] == joined[np.minimum(at[twin] + k, len(joined) - 1)])
        twin = np.where(same, twin, np.arange(n))
        self.distinct = twin == np.arange(n)
        pairs = np.unique(np.stack([twin, self.owner.astype(np.int64)], 1), axis=0) if n else np.zeros((0, 2), np.int64)
        self.sharers = pairs[:, 1].astype(np.int32)
        self.share = np.searchsorted(pairs[:, 0], np.arange(n + 1))

    def _around(self, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first distinct fragment that holds the q-gram at a place of a text, and how many fragments from there to the last."""
        place = place.astype(np.int64)
        length, stride, last = self.length[owner], self.stride[owner], self.last[owner]
        end = np.array([len(x) for x in self.chars], np.int64)[owner] - length  # where the last fragment begins
        low = np.minimum(-(-np.maximum(0, place + self.q - length) // stride), last) + self.base[owner]
        high = np.where(place >= end, last, place // stride) + self.base[owner]
        marked = np.flatnonzero(self.distinct)
        if not len(marked):
            return low.astype(np.int32), np.zeros(len(low), np.int32)
        first, past = np.searchsorted(marked, low), np.searchsorted(marked, high, side="right")
        some = past > first
        low = np.where(some, marked[np.minimum(first, len(marked) - 1)], low)
        high = np.where(some, marked[np.maximum(past - 1, 0)], low - 1)
        return low.astype(np.int32), (high - low + 1).astype(np.int32)

    def exact(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Short benchmark texts with the places where they stand between word boundaries."""
        if not self.brief:
            return
        most = max(self.brief)
        word = np.where(chars < 1 << 16, _WORD[np.minimum(chars, (1 << 16) - 1)], False)
        edge = np.concatenate([[True], ~(word[1:] & word[:-1]), np.ones(most + 1, bool)])
        wide = np.concatenate([chars, np.full(most, 0xFFFFFFFF, np.uint32)])
        at = np.flatnonzero(edge[: len(chars)])
        at = at[np.isin(chars[at], self.heads)]
        hashed = np.zeros(len(at), np.uint64)
        for m in range(1, most + 1):
            hashed = hashed * _FACTOR + wide[at + m - 1]
            if m not in self.brief:
                continue
            keys, owners = self.brief[m]
            k = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            same = np.flatnonzero((keys[k] == hashed) & edge[at + m])
            order = np.argsort(k[same], kind="stable")
            which, first = np.unique(k[same][order], return_index=True)
            for key, places in zip(which.tolist(), np.split(at[same][order], first[1:]), strict=bool(len(which))):
                stretches = wide[places[:, None] + np.arange(m)]
                for o in owners[key]:
                    yield o, places[(stretches == self.chars[o]).all(axis=1)]

    def lookup(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's q-grams that the index has, and which they are."""
        at = np.flatnonzero(self.seen[found >> np.uint64(64 - _FILTER_BITS)])
        if not len(self.grams):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.grams, found[at]), len(self.grams) - 1)
        same = self.grams[k] == found[at]
        return at[same], k[same]

    def hits(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fragment and diagonal of every q-gram that text and distinct fragments share."""
        n = self.count[k]
        post = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at, low, n = np.repeat(at, n), self.low[post].astype(np.int64), self.n[post]
        offset = at - self.places[post]
        fragment = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        diagonal = np.repeat(offset, n) + self.begin[fragment]
        kept = self.distinct[fragment]
        return fragment[kept], diagonal[kept]

    def regions(self, fragment: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Keys of fragments and bands that reach their bound."""
        band = diagonal // (self.budget[fragment] + 1)
        key, n = np.unique(np.concatenate([fragment * _SHIFT + band, fragment * _SHIFT + band - 1]) + _HALF, return_counts=True)
        return key[n >= self.need[key // _SHIFT]]

    def candidates(self, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fragments with the first diagonal of each band that reaches their bound, over texts that begin at ``starts``."""
        at, k = self.lookup(grams(chars, self.q))
        reach = int(self.size.max(initial=0) + 2 * (self.budget.max(initial=0) + 1) + self.q)  # no band's hits stretch further
        if int(self.fragments[k].sum()) > 4 * len(chars):
            kept = _unequal(chars, starts, reach)[at]
            at, k = at[kept], k[kept]
        load = np.cumsum(self.fragments[k])
        parts, begin = [], 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(load, load[begin] + _HITS)))
            past = int(np.searchsorted(at, at[end - 1] + reach, side="right"))  # a band that begins here ends there
            parts.append(self.regions(*self.hits(at[begin:past], k[begin:past])))
            begin = end
        key = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        fragment = key // _SHIFT
        return fragment, (key % _SHIFT - _HALF) * (self.budget[fragment] + 1)


#: A fragment and a band of diagonals as one number.
_SHIFT = np.int64(1) << np.int64(36)
_HALF = _SHIFT >> np.int64(1)


def _unequal(chars: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """The places within or near the first and the last stretch of each content in each text; stretches are ``reach`` characters."""
    n = len(chars)
    wide = np.concatenate([chars, np.full(reach, 0xFFFFFFFF, np.uint32)]).astype(np.uint64)
    hashed = np.searchsorted(starts, np.arange(n), side="right").astype(np.uint64)
    for k in range(reach):
        hashed = hashed * _FACTOR + wide[k : k + n]
    hashed ^= hashed >> np.uint64(31)
    order = np.argsort(hashed, kind="stable")
    new = np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])
    edge = np.zeros(n + 1, np.int64)
    for x in (order[new], order[np.concatenate([new[1:], [True]])]):  # a stretch and as much before and after it
        np.add.at(edge, np.maximum(x - reach, 0), 1)
        np.add.at(edge, np.minimum(x + 2 * reach, n), -1)
    return np.cumsum(edge[:-1]) > 0


def align(patterns: np.ndarray, chars: np.ndarray, low: np.ndarray, width: int, first: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best alignments of whole patterns (one a row) with stretches of their texts, chars[first:end], on so many diagonals from ``low`` on.

    Character by character, cells of the bands only; a text may begin and end anywhere. Gives (row, edits, begin,
    end) of the patterns that need ``most`` edits at most.
    """
    m, far = patterns.shape[1], most + 1
    at = np.arange(width, dtype=np.int32)
    alive = np.arange(len(patterns))
    place = low[:, None] + np.arange(width + m)
    inside = (place >= first[:, None]) & (place < end[:, None])
    text = chars[np.clip(place, 0, max(0, len(chars) - 1))] if len(chars) else np.zeros(place.shape, np.uint32)
    start = place[:, :width]
    row = np.where((start >= first[:, None]) & (start <= end[:, None]), 0, far).astype(np.int32)
    begin = np.broadcast_to(at, row.shape)
    for i in range(m):
        cost = np.where(inside[:, i : i + width], text[:, i : i + width] != patterns[:, i : i + 1], far).astype(np.int32)
        new, came = row + cost, begin
        skip = np.full_like(row, far)  # the pattern's character has no partner
        skip[:, :-1] = row[:, 1:] + 1
        better = skip < new
        moved = np.zeros_like(row)
        moved[:, :-1] = begin[:, 1:]
        new, came = np.where(better, skip, new), np.where(better, moved, came)
        reach = new - at
        best = np.minimum.accumulate(reach, axis=1)  # text characters without partners
        source = np.maximum.accumulate(np.where(reach == best, at, 0), axis=1)
        row, begin = np.minimum(best + at, far), np.take_along_axis(came, source, axis=1)
        if i % 4 == 3:
            good = row.min(axis=1) <= most
            if not good.all():
                alive, row, begin, text, inside, patterns = alive[good], row[good], begin[good], text[good], inside[good], patterns[good]
                if not len(alive):
                    break
    ends = low[alive][:, None] + at + m
    row = np.where((ends >= first[alive][:, None]) & (ends <= end[alive][:, None]), row, far)
    k = row.argmin(axis=1)
    line = np.arange(len(alive))
    edits = row[line, k]
    good = edits <= most
    return alive[good], edits[good], (low[alive] + begin[line, k])[good], ends[line, k][good]


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The best alignment of one pattern, on diagonals low..high (text minus pattern place): (edits, begin, end), or nothing."""
    _, *got = align(pattern[None], text, np.array([low]), high - low + 1, np.array([0]), np.array([len(text)]), most)
    return tuple(int(x[0]) for x in got) if len(got[0]) else None


def find(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, begin, end, edits) of what the texts hold; the edits are those of the best fragment."""
    if not index.ids or not texts:
        return []
    parts = [normalized(t) for t in texts]
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    wall = np.array([0xFFFFFFFF], np.uint32)  # no character: no q-gram spans two texts
    chars = np.concatenate([x for p in parts for x in (p[0], wall)])
    found: dict[tuple[int, int], list[int]] = {}

    def note(docs: np.ndarray, owners: np.ndarray, begins: np.ndarray, ends: np.ndarray, edits: np.ndarray) -> None:
        for doc, o, begin, end, e in zip(docs.tolist(), owners.tolist(), (begins - starts[docs]).tolist(), (ends - starts[docs]).tolist(), edits.tolist(), strict=True):
            where = parts[doc][1]
            span = (int(where[min(max(begin, 0), len(where) - 1)]), int(where[min(max(end - 1, 0), len(where) - 1)]) + 1)
            old = found.setdefault((doc, o), [*span, e])
            found[doc, o] = [min(old[0], span[0]), max(old[1], span[1]), min(old[2], e)]

    fragment, low = index.candidates(chars, starts[:-1])
    doc = np.searchsorted(starts, np.clip(low + index.size[fragment] // 2, 0, len(chars) - 1), side="right") - 1
    for m in np.unique(index.size[fragment]).tolist():
        those = np.flatnonzero(index.size[fragment] == m)
        for cut in range(0, len(those), _TOGETHER):
            t = those[cut : cut + _TOGETHER]
            f, d = fragment[t], doc[t]
            k = int(index.budget[f[0]])
            patterns = np.stack([index.chars[o][b : b + m] for o, b in zip(index.owner[f].tolist(), index.begin[f].tolist(), strict=True)])
            at, edits, begin, end = align(patterns, chars, low[t] - k, 2 * (k + 1) + 2 * k + 1, starts[d], starts[d] + sizes[d], k)
            first, n = index.share[f[at]], np.diff(index.share)[f[at]]
            owners = index.sharers[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            note(np.repeat(d[at], n), owners, np.repeat(begin, n), np.repeat(end, n), np.repeat(edits, n))
    for o, places in index.exact(chars):
        if len(places):
            texts_of = np.searchsorted(starts, places, side="right") - 1
            for side in (np.unique(texts_of, return_index=True)[1], len(places) - 1 - np.unique(texts_of[::-1], return_index=True)[1]):
                note(texts_of[side], np.full(len(side), o), places[side], places[side] + len(index.chars[o]), np.zeros(len(side), np.int64))
    return [(d, o, *rest) for (d, o), rest in sorted(found.items())]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark in blocks of at most so many bytes of text (one longer text is a block), read one partition at a time."""
    rows = benchmark.select(F.col("item_id"), text_or_empty().alias("text"))
    held, size = [], 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        if held and size + len(r.text) > block_bytes:
            yield Index(held)
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield Index(held)


_FOUND = "doc_id long, item_id long, start long, end long, edits long"


def _search(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "start", "end", "edits")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most_bytes=1 << 20, most_rows=1024):
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], index.ids[o], a, b, e) for d, o, a, b, e in find(index, batch.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id and the place (start, end) of each benchmark passage in a document, with the least edits of a fragment."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = [rows.mapInArrow(returning(_search(index)), _FOUND) for index in benchmark_blocks(benchmark, block_bytes)]
    return reduce(DataFrame.unionByName, parts) if parts else rows.mapInArrow(returning(_search(Index([]))), _FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark passage."""
    text_at = docs.columns.index("text")

    def cleaner(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", most_bytes=1 << 20, most_rows=1024):
                bad = {x[0] for x in find(index, [t or "" for t in batch.column(text_at).to_pylist()])}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        return run

    for index in benchmark_blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(returning(cleaner(index)), docs.schema)
    return docs
