"""Token ids as files of independent zstandard frames with a trailing seek table.

A shard holds one frame per document (the ids as little-endian 32-bit integers, with the frame's own
checksum), then a skippable frame with one entry per document (compressed size, ids, the document's id, crc32
of the ids) and a footer that says how many. A reader fetches the footer and table, then only the frames it wants.
Documents are dealt by ranges of their id and sorted within them, so shard by shard the ids ascend.

Shards are cut by id, then by the beginning and a hash of the text, so rows that share an id spread as well; there
are as many as the session's shuffle partitions, more where the table's size asks for them.

Defined results: a null or empty text is the end id alone; null ids come first; rows that repeat an id are
written one after another, ordered by their first 64 characters, a hash and the text, each with its own start; an empty table writes nothing and gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.files import open_random, replacing
from keystrata.llm.text import WORKER_CACHE, returning, slices, spread, text_or_empty
from keystrata.sources.shared import fresh_folder

#: Fixed values of the format: a skippable frame's number, the seek table's mark, entry and footer layouts.
SKIPPABLE = 0x184D2A5E
MARK = 0x8F92EAB1
ENTRY = struct.Struct("<QQq?I")
FOOTER = struct.Struct("<QI")
HEAD = struct.Struct("<II")
#: A shard is written for so many bytes of the table, at least.
SHARD_BYTES = 256 << 20
#: The tokenizer steps for which pieces between white space can be encoded by themselves. The normal
#: form never composes across white space, the split drops it, and what stands between is encoded word by word.
PIECEWISE_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
PIECEWISE_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encodes_by_pieces(tokenizer) -> bool:
    """Whether the ids of a text are those of its pieces between spaces, tabs and line breaks, by the tokenizer's own description."""
    own = json.loads(tokenizer.to_str())
    normalizer, split = own["normalizer"] or {"type": "Sequence", "normalizers": []}, own["pre_tokenizer"] or {}
    steps = normalizer.get("normalizers", [normalizer])
    words = split.get("pretokenizers", [split])
    return (
        own["truncation"] is None and own["padding"] is None
        and all(x in PIECEWISE_NORMALIZERS for x in steps)
        and words[0] == PIECEWISE_SPLIT and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in words[1:])
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in own["added_tokens"])
    )


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


class WordCache:
    """Ids of texts, from ids of their white-space separated pieces.

    For a tokenizer whose pre-tokenization drops white space and keeps letters apart from marks, no token
    spans an ASCII space, tab or line break, so the ids of a text are those of its pieces in order. The
    library encodes each piece once. Two rewritings make pieces recur more often and leave the ids alone:
    a single comma or full stop between an ASCII letter or digit and white space becomes a piece of its own (other
    letters may end in a combining mark once normalized, which would join the stop), and a
    text of Latin-1 characters only (no combining marks, one small letter for each capital) is lower-cased
    where the tokenizer does so itself. The cache is dropped when it is full. Texts of any other tokenizer are encoded whole.
    """

    PIECES = 1_000_000
    STOP = re.compile(r"(?<=[A-Za-z0-9])([.,])(?=[ \n\t])")
    MARK = "\x01"

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.by_pieces = encodes_by_pieces(self.tokenizer)
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("ABC") == "abc"
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has. Twenty go to the library at once, parted by a mark of one known id."""
        plain = self.mark is not None and not any(self.MARK in x for x in pieces)
        if not plain:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        joined = [f" {self.MARK} ".join((*pieces[k : k + 20], "")) for k in range(0, len(pieces), 20)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces and lays their ids end to end."""
        ids, sizes = self._encoded(pieces)
        n, end = len(self.index), self.used + len(ids)
        self.starts, self.sizes = (_room(x, n + len(pieces)) for x in (self.starts, self.sizes))
        self.ids = _room(self.ids, end)
        self.ids[self.used : end] = ids
        self.starts[n : n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(pieces)] = sizes
        self.index.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.used = end

    def _pieces(self, text: str) -> list[str]:
        if self.lowers and "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return self.STOP.sub(r" \1", text).replace("\n", " ").replace("\t", " ").split(" ")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. New pieces of all of them are learned together."""
        if not self.by_pieces:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self._pieces(t) for t in texts]
        pieces = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys(pieces[k] for k in missing))
            if len(self.index) + len(new) > self.PIECES:
                self._clear()
                new, missing = list(dict.fromkeys(pieces)), range(len(pieces))
            self._learn(new)
            at[missing] = [self.index[pieces[k]] for k in missing]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        return np.split(ids, np.concatenate([[0], ends])[cuts])


def word_cache(path: str) -> WordCache:
    """One for all tasks of a Python worker that follow each other."""
    held = WORKER_CACHE.get("pieces")
    if not isinstance(held, tuple) or held[0] != path:
        held = WORKER_CACHE["pieces"] = path, WordCache(path)
    return held[1]


class ShardWriter:
    def __init__(self, stream, level: int = 1) -> None:
        self.stream, self.table, self.ids = stream, [], 0
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4", copy=False).tobytes()
        frame = self.packer.compress(raw)
        self.stream.write(frame)
        self.table.append(ENTRY.pack(len(frame), len(ids), doc_id or 0, doc_id is not None, zlib.crc32(raw)))
        self.ids += len(ids)

    def close(self) -> None:
        body = b"".join(self.table) + FOOTER.pack(len(self.table), MARK)
        self.stream.write(HEAD.pack(SKIPPABLE, len(body)) + body)


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, address: str) -> None:
        self.file = open_random(address)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        n, mark = FOOTER.unpack(self.file.read(FOOTER.size))
        if mark != MARK:
            raise ValueError(f"{address} has no seek table")
        self.file.seek(size - FOOTER.size - n * ENTRY.size)
        self.table = np.frombuffer(self.file.read(n * ENTRY.size), np.dtype([("packed", "<u8"), ("ids", "<u8"), ("doc_id", "<i8"), ("known", "?"), ("crc", "<u4")]))
        self.offsets = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def doc_id(self, k: int) -> int | None:
        return int(self.table["doc_id"][k]) if self.table["known"][k] else None

    def __getitem__(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        raw = self.unpacker.decompress(self.file.read(int(self.table["packed"][k])))
        if zlib.crc32(raw) != self.table["crc"][k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, "<u4")


_WRITTEN = "shard long, n_docs long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def _shard(folder: str, n: int) -> str:
    return f"{folder}/shard-{n:06d}.zst"


def _write(folder: str, vocabulary: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        cache, end = word_cache(vocabulary), np.array([end_id], np.uint32)
        with replacing(_shard(folder, shard)) as stream:
            writer = ShardWriter(stream)
            for batch in slices(batches, "text", most_bytes=1 << 20):
                for doc_id, ids in zip(batch.column(0).to_pylist(), cache.encode_all(batch.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]))
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(writer.table), writer.ids)], names=["shard", "n_docs", "n_tokens"])

    return run


def shards(spark: SparkSession, docs: DataFrame) -> int:
    """By the size of the table as the optimizer knows it, and no fewer than the session's shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 55  # far more stands for a table of unknown size
    return max(spread(docs, spark), math.ceil(size / SHARD_BYTES) if known else 0)


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the shards and a manifest with one row per shard (shard, n_docs, n_tokens); returns the manifest."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards(spark, docs), *order).sortWithinPartitions(*order, "text")
    dealt.mapInArrow(returning(_write(folder, vocabulary, end_id), keeps="pieces"), _WRITTEN).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _read(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, held = ShardReader(_shard(folder, shard)), []
                for k in range(len(reader)):
                    ids = reader[k]
                    held.append((reader.doc_id(k), at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(held) == 8192 or k + 1 == len(reader):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=_SCHEMA)
                        held = []

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards, from its own frame: doc_id, start, n_tokens, ids_crc32."""
    shards = sorted(spark.read.parquet(f"{folder}/manifest").select("shard", "n_tokens").collect())  # a row per shard
    starts = [0, *accumulate(r.n_tokens for r in shards)]
    tasks = spark.createDataFrame([(r.shard, at) for r, at in zip(shards, starts, strict=False)], "shard long, start long")
    return tasks.repartition(max(1, len(shards))).mapInArrow(returning(_read(folder)), _READ)


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes, writes, and reads back."""
    folder = folder or fresh_folder(spark, "tokens")
    write_token_files(spark, docs, folder, vocabulary, end_id)
    return read_token_files(spark, folder)
