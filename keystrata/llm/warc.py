"""Web archives with a globally ordered capture index, built by an external merge.

Tasks write WARC files of independently compressed records, together with locally sorted runs of captures
(URL key, timestamp, page, place of the record). Runs are merged k at a time by a loser tree; the last merge
is cut into ranges of (URL key, timestamp, page, place of the record), one per task, so that histories come out in
global order and a URL, or a page, captured very often spreads over ranges. A task reads the parts of the runs' indexes
that its range needs. Each history row is then read from its archive record.

Which record repeats which payload is settled before writing: the smallest page of each digest, aggregated
before any shuffle and met again under salted keys.

Defined results: a null html is an empty payload, a null url an empty one (its key sorts first); payloads
below the least size are always responses; rows that repeat page and payload all carry the owner's record
type; a null page owns a payload only if no page with an id has it. An empty table writes nothing and gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import islice
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.files import open_random, replacing
from keystrata.llm.text import slices, spread
from keystrata.sources.shared import fresh_folder

SALTS = 32
EPOCH = "2024-01-01T00:00:00Z"

# --- records


def url_key(url: str) -> str:
    """Host labels reversed, then the path and query; scheme, port, leading www and fragment don't count."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){tail}"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    value = name.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def encode_record(page_id: int | None, url: str, date: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as its own gzip member. A revisit keeps the response's HTTP header and drops the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {''.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head = "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def decode_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Archive fields, HTTP fields and body."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, _fields(http), body


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return {k.lower(): v for k, v in pairs}


# --- sorted runs

#: key, date, page (-1 for none), file number, offset, length
Capture = tuple[str, str, int, int, int, int]
#: What tells captures apart: all but the length.
KEY = 5
BLOCK = 512
#: Blocks whose first captures are one part of a run's index; a reader holds the first capture of every part, and one part.
PART = 512
_TAIL = struct.Struct("<QQQ")


def write_run(address: str, captures: Iterator[Capture]) -> int:
    """Sorted captures in blocks, with parts of the index between them (each block's first capture and place), then the parts' own index."""
    top, part, held, at, n, blocks = [], [], [], 0, 0, 0
    with replacing(address) as stream:

        def put(rows: list) -> tuple[int, int]:
            nonlocal at
            data = zlib.compress(json.dumps(rows).encode(), 1)
            stream.write(data)
            at += len(data)
            return at - len(data), len(data)

        def close_part() -> None:
            nonlocal part
            top.append([part[0][0], *put(part)])
            part = []

        def flush() -> None:
            nonlocal held, blocks
            part.append([held[0][:KEY], *put(held)])
            held = []
            blocks += 1
            if len(part) == PART:
                close_part()

        for c in captures:
            held.append(c)
            n += 1
            if len(held) == BLOCK:
                flush()
        if held:
            flush()
        if part:
            close_part()
        stream.write(_TAIL.pack(put(top)[1], blocks, n))
    return n


class Run:
    """One sorted run, read a block at a time from the first capture not below ``low``; of its index only the parts that a range needs."""

    def __init__(self, address: str) -> None:
        self.file = open_random(address)
        end = self.file.size() - _TAIL.size
        self.file.seek(end)
        foot, self.blocks, self.rows = _TAIL.unpack(self.file.read(_TAIL.size))
        self.top = self._entries(end - foot, foot)

    def _read(self, at: int, n: int) -> list:
        self.file.seek(at)
        return json.loads(zlib.decompress(self.file.read(n)))

    def _entries(self, at: int, n: int) -> list[tuple[tuple, int, int]]:
        return [(tuple(first), *place) for first, *place in self._read(at, n)]

    def firsts(self, step: int) -> Iterator[tuple]:
        """The first capture of every so many blocks."""
        places = (x[0] for _, at, n in self.top for x in self._entries(at, n))
        return islice(places, 0, None, step)

    def captures(self, low: tuple | None = None, high: tuple | None = None) -> Iterator[Capture]:
        for part in _reaching(self.top, low, high):
            for _, at, n in _reaching(self._entries(*part[1:]), low, high):
                for c in self._read(at, n):
                    key = tuple(c[:KEY])
                    if high is not None and key >= high:
                        return
                    if low is None or key >= low:
                        yield tuple(c)


def _reaching(entries: list[tuple[tuple, int, int]], low: tuple | None, high: tuple | None) -> list[tuple[tuple, int, int]]:
    """The entries that may hold captures from ``low`` up to ``high``; the first of them may be inside the entry before."""
    begin = 0 if low is None else max(0, bisect_left(entries, low, key=itemgetter(0)) - 1)
    end = len(entries) if high is None else bisect_left(entries, high, key=itemgetter(0))
    return entries[begin:end]


class LoserTree:
    """A tournament over k sorted streams: every inner node keeps the loser, the top the winner."""

    def __init__(self, streams: list[Iterator]) -> None:
        self.streams, self.k = streams, len(streams)
        self.heads = [next(s, None) for s in streams]
        self.losers = [-1] * max(1, self.k)
        self.winner = -1
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """An exhausted stream loses; equal heads go by the stream's number, so that merging is stable."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        """From a leaf to the top, swapping with a stored loser that wins. An empty node ends a build's path."""
        winner, at = leaf, (leaf + self.k) // 2
        while at > 0:
            other = self.losers[at]
            if other < 0:
                self.losers[at] = winner
                return
            if self._beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.winner = winner

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.streams[self.winner], None)
            self._replay(self.winner)


def merged(addresses: list[str], low: tuple | None = None, high: tuple | None = None) -> Iterator[Capture]:
    return iter(LoserTree([Run(a).captures(low, high) for a in addresses]))


# --- the operator

_WRITTEN = "file long, run long, rows long"
_MERGED = "place long, page_id long, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_MERGED_SCHEMA = pa.schema([("place", pa.int64()), ("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _warc(folder: str, n: int) -> str:
    return f"{folder}/warc/part-{n:06d}.warc.gz"


def _archive(folder: str, run_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes one archive and its sorted runs per task; memory holds one run's captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        out, captures, at = [], [], 0

        def flush() -> None:
            nonlocal captures
            captures.sort()
            out.append((number, len(out), write_run(f"{folder}/runs/{number:06d}-{len(out):05d}", iter(captures))))
            captures = []

        with replacing(_warc(folder, number)) as stream:
            for batch in slices(batches, "payload"):
                for page, url, date, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = encode_record(page, url, date, payload, digest, refers_to, revisit)
                    stream.write(data)
                    captures.append((url_key(url), date, -1 if page is None else page, number, at, len(data)))
                    at += len(data)
                    if len(captures) == run_rows:
                        flush()
        if captures:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["file", "run", "rows"])

    return run


def _merge_files(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round of merging: each row names the runs that become one longer run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = write_run(f"{folder}/runs/{target}", merged([f"{folder}/runs/{r}" for r in runs]))
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([rows], pa.int64())], names=["name", "rows"])

    return run


def _histories(folder: str, runs: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last merge, over one range per row, with each capture read from its archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: OrderedDict[int, object] = OrderedDict()
        for batch in batches:
            for number, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bounds = [None if x is None else tuple(json.loads(x)) for x in (low, high)]
                held = []
                for k, (key, date, page, file, at, length) in enumerate(merged([f"{folder}/runs/{r}" for r in runs], *bounds)):
                    if file not in files:
                        files[file] = open_random(_warc(folder, file))
                        if len(files) > 64:
                            files.popitem(last=False)[1].close()
                    files[file].seek(at)
                    fields, http, body = decode_record(files[file].read(length))
                    if fields["warc-type"] == "revisit":
                        row = (int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), "revisit", _page(fields["warc-refers-to"]))
                    else:
                        row = (len(body), hashlib.sha256(body).hexdigest(), "response", None)
                    held.append(((number << 40) + k, _page(fields["warc-record-id"]), key, date, *row))
                    if len(held) == 4096:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    return run


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _MERGED_SCHEMA, strict=True)], schema=_MERGED_SCHEMA)


def repeats(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, payload_digest, owner) of pages whose payload an earlier page has."""
    large = pages.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    owners = large.groupBy("payload_digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    owners = owners.select("payload_digest", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(owners, ["payload_digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("owner")))
    return found.select("page_id", "payload_digest", "owner").distinct()


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 100, run_rows: int = 50_000, fan_in: int = 64, range_rows: int = 250_000, date_column: str | None = None) -> DataFrame:
    """Writes archives and runs, merges, and returns the capture histories with a global ``place``."""
    folder = folder or fresh_folder(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        (F.coalesce(F.col(date_column).cast("string"), F.lit(EPOCH)) if date_column else F.lit(EPOCH)).alias("captured"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload"))
    again = repeats(rows, least).select(F.col("page_id").alias("again_page"), F.col("payload_digest").alias("again_digest"), "owner")
    same = F.col("page_id").eqNullSafe(F.col("again_page")) & (F.col("payload_digest") == F.col("again_digest"))
    marked = rows.join(again, same, "left").select("page_id", "url", "captured", "payload", "payload_digest", F.col("owner").alias("refers_to"), F.col("again_digest").isNotNull().alias("revisit"))
    marked.mapInArrow(_archive(folder, run_rows), _WRITTEN).write.parquet(f"{folder}/written")
    runs = [(f"{r.file:06d}-{r.run:05d}", r.rows) for r in spark.read.parquet(f"{folder}/written").collect()]  # a row per 50,000 pages
    level = 0
    while len(runs) > fan_in:
        runs.sort(key=lambda r: r[1])
        groups = [(f"m{level:02d}-{k:06d}", [r[0] for r in runs[k : k + fan_in]]) for k in range(0, len(runs), fan_in)]
        plan = spark.createDataFrame(groups, "name string, runs array<string>").repartition(len(groups))
        plan.mapInArrow(_merge_files(folder), "name string, rows long").write.parquet(f"{folder}/merge-{level}")
        runs = [(r.name, r.rows) for r in spark.read.parquet(f"{folder}/merge-{level}").collect()]
        level += 1
    names, total = sorted(r[0] for r in runs), sum(r[1] for r in runs)
    ranges = max(1, min(spread(rows, spark), total // 1000), -(-total // range_rows))
    # One sample in so many blocks, the same in every run: about 8 a range, and one a run.
    step = max(1, total // BLOCK // (8 * ranges))
    samples = sorted(x for r in names for x in Run(f"{folder}/runs/{r}").firsts(step))
    cuts = sorted({samples[len(samples) * k // ranges] for k in range(1, ranges)}) if samples else []
    edges = [None, *(json.dumps(c) for c in cuts), None]
    tasks = spark.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(len(edges) - 1)] if names else [], "number long, low string, high string")
    return tasks.repartition(max(1, len(edges) - 1)).mapInArrow(_histories(folder, names), _MERGED)
