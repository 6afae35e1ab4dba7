"""Exact duplicates by Patricia tries over full byte strings.

Rows are dealt by length and content hash; a task inserts every whole byte string into a compressed radix
trie whose terminal nodes keep the owner of the text. Before the shuffle each map task folds its own copies
through such a trie, so a text that a third of all rows share crosses once per map batch.

A trie beyond its budget moves subtrees below one node to a temporary file until it weighs half of it, so it
never weighs more than the budget and one key. Later keys that lead there go to the file as well; each file is
merged at the end in a trie of its own, which spills on in the same way: fewer of a node's subtrees, or deeper
ones, until a file holds a single key. Such a file is task-local scratch space like a sort's: it
lives and dies with its task, and a retried task writes its own.

Defined results: a null text counts as empty; equal means equal bytes. A row with a null id belongs to its
group but owns it only if the group has no other id (then keep_id is null). Rows that repeat an id and a
text count one by one in group_size and are all kept if that id owns the group. An empty table gives no
rows. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.text import returning, text_or_empty

#: A hot text's rows meet their owner again under this many keys.
SALTS = 32
NODE_BYTES = 240


class _Node:
    """An edge label with what lies below. ``spill`` is set where the subtree went to a file, ``holed`` where one below did."""

    __slots__ = ("children", "holed", "label", "payload", "spill", "weight")

    def __init__(self, label: bytes, payload: Any = None) -> None:
        self.label, self.payload = label, payload
        self.children: dict[int, _Node] = {}
        self.spill: Any = None
        self.holed = False
        self.weight = len(label) + NODE_BYTES


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving slices rather than byte by byte."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


class Patricia:
    """A map from byte strings to payloads; ``merge`` folds the payloads of equal strings."""

    def __init__(self, merge: Callable[[Any, Any], Any], budget: int) -> None:
        self.root, self.merge, self.budget = _Node(b""), merge, budget

    def insert(self, key: bytes, payload: Any) -> None:
        node, at, path = self.root, 0, [self.root]
        added = 0
        while True:
            if at == len(key):
                node.payload = payload if node.payload is None else self.merge(node.payload, payload)
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:], payload)
                added += child.weight
                break
            if child.spill is not None:
                _record(child.spill, key[at:], payload)
                break
            label = child.label
            rest = key[at : at + len(label)]
            if rest != label:
                cut = _common(rest, label)
                upper = _Node(label[:cut])
                upper.weight, upper.holed = child.weight + NODE_BYTES, child.holed
                child.label = label[cut:]
                child.weight -= cut
                upper.children[child.label[0]] = child
                node.children[key[at]] = child = upper
                added += NODE_BYTES
                path.append(child)
                node, at = child, at + cut
                continue
            node, at = child, at + len(label)
            path.append(child)
        if added:
            for x in path:
                x.weight += added
            if self.root.weight > self.budget:
                self._spill()

    def _spill(self) -> None:
        """Moves subtrees out until half of the budget is free, or there is nothing left to move."""
        goal = self.budget // 2
        while self.root.weight > goal:
            node, path = self.root, [self.root]
            while True:
                # Whole subtrees first: one with a hole would have to read the hole's file back.
                live = sorted((c for c in node.children.values() if c.spill is None), key=lambda c: (c.holed, -c.weight))
                heavy = max(live, key=lambda c: c.weight, default=None)
                if heavy is None or heavy.weight * 8 < self.budget or all(c.spill is not None for c in heavy.children.values()):
                    break
                node = heavy
                path.append(node)
            if not live or (len(path) == 1 and len(node.children) == 1):
                return  # a single key is left, or what all keys begin with
            # A file below the root holds fewer subtrees than its trie, so files of files come to an end.
            most = len(live) - (len(path) == 1 and len(live) == len(node.children))
            stub, excess = _Node(b""), self.root.weight - goal
            spill = stub.spill = tempfile.TemporaryFile()
            lost = -stub.weight
            for c in live[:most]:
                if lost >= excess:
                    break
                for suffix, payload in _walk(c):
                    _record(spill, suffix, payload)
                lost += c.weight
                node.children[c.label[0]] = stub
            for x in path:
                x.weight -= lost
                x.holed = True

    def items(self) -> Iterator[tuple[bytes, Any]]:
        """Every key with its payload; the trie is empty afterwards. One trie at a time is in memory."""
        waiting: list[tuple[bytes, Any]] = [(b"", None)]
        while waiting:
            before, spill = waiting.pop()
            if spill is None:
                top, self.root = self.root, _Node(b"")
            else:
                below = Patricia(self.merge, self.budget)
                for suffix, payload in _records(spill):
                    below.insert(suffix, payload)
                spill.close()
                top = below.root
            stack = [(top, before)]
            del top
            while stack:
                node, before = stack.pop()
                key = before + node.label
                if node.payload is not None:
                    yield key, node.payload
                waiting += [(key, x) for x in _files(node)]
                stack += [(c, key) for c in node.children.values() if c.spill is None]


def _files(node: _Node) -> list[Any]:
    return list({id(c.spill): c.spill for c in node.children.values() if c.spill is not None}.values())


def _walk(top: _Node) -> Iterator[tuple[bytes, Any]]:
    """The keys of a subtree from its label on; files below it are read back and closed."""
    stack = [(top, b"")]
    while stack:
        node, before = stack.pop()
        key = before + node.label
        if node.payload is not None:
            yield key, node.payload
        for spill in _files(node):
            yield from ((key + suffix, payload) for suffix, payload in _records(spill))
            spill.close()
        stack += [(c, key) for c in node.children.values() if c.spill is None]


#: length, owner present, owner, count, salts
_HEAD = struct.Struct("<q?qqQ")


def _record(stream: Any, suffix: bytes, payload: tuple) -> None:
    owner, count, salts = payload
    stream.write(_HEAD.pack(len(suffix), owner is not None, owner or 0, count, salts))
    stream.write(suffix)


def _records(stream: Any) -> Iterator[tuple[bytes, tuple]]:
    stream.seek(0)
    while head := stream.read(_HEAD.size):
        n, known, owner, count, salts = _HEAD.unpack(head)
        yield stream.read(n), (owner if known else None, count, salts)


def owner_rule(smallest: bool) -> Callable[[tuple, tuple], tuple]:
    """Payloads are (owner, count, set of salts as bits)."""
    choose = min if smallest else max

    def merge(a: tuple, b: tuple) -> tuple:
        known = [x for x in (a[0], b[0]) if x is not None]
        return (choose(known) if known else None, a[1] + b[1], a[2] | b[2])

    return merge


_FOLDED = "body binary, owner long, n long, salts long"
_OWNED = "text_sha256 string, keep_id long, group_size long, salts long"


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _fold(smallest: bool, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map side: copies within a task become one row; a full trie is handed on and a new one begun."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = owner_rule(smallest)
        trie = Patricia(merge, 1 << 62)
        for batch in batches:
            for doc_id, salt, body in _rows(batch):
                trie.insert(body, (doc_id, 1, 1 << salt))
                if trie.root.weight > budget:
                    yield from _packed(((k, *p) for k, p in trie.items()), _FOLDED)
                    trie = Patricia(merge, 1 << 62)
        yield from _packed(((k, *p) for k, p in trie.items()), _FOLDED)

    return run


def _own(smallest: bool, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(owner_rule(smallest), budget)
        for batch in batches:
            for body, owner, n, salts in _rows(batch):
                trie.insert(body, (owner, n, salts))
        yield from _packed(((hashlib.sha256(k).hexdigest(), *p) for k, p in trie.items()), _OWNED)

    return run


def _packed(rows: Iterator[tuple], schema: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    target = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in zip(names, kinds, strict=True)])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0]) + 32
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", smallest: bool = True, budget: int = 96 << 20) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept and text_sha256. ``smallest`` picks the owner."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).cast("binary").alias("body"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    folded = rows.select("doc_id", "salt", "body").mapInArrow(returning(_fold(smallest, budget // 2)), _FOLDED)
    dealt = folded.repartition(F.octet_length("body"), F.xxhash64("body"))
    owned = dealt.mapInArrow(returning(_own(smallest, budget)), _OWNED)
    bits = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    owners = owned.select("text_sha256", "keep_id", "group_size", F.explode(bits).alias("salt"))
    ids = rows.select("doc_id", "salt", F.sha2("body", 256).alias("text_sha256"))
    return ids.join(owners, ["text_sha256", "salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
