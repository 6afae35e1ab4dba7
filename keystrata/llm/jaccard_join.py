"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with one set of word n-grams form a class; classes are joined, copies are counted. Candidates are
classes that agree on a band of MinHash values; with 42 bands of 6 a pair at the threshold of 0.8 is missed
with a chance of about 3 in a million. Bands link classes into groups (one edge from a class to the smallest
of its hubs, and those between hubs), groups are cut into blocks bounded in classes and bytes, and a task takes
two blocks that share a band bucket: for each candidate pair it compares MinHash values a slice at a time
and drops the pair as soon as the posterior probability (uniform prior) that its similarity reaches the
threshold is below the tolerance; the rest is verified on the exact n-gram sets. Tasks return counts per
class and a spanning forest of their links, never pairs, so a group of many near copies costs time but no
quadratic output. Bands, groups and labels of many classes are met under salted keys.

Defined results: a null text counts as empty. Texts with fewer words than n have one n-gram, all their words;
texts without words are copies of each other. n_links counts the other documents at or above the threshold,
copies included; class_id is the smallest id of the documents connected by links. Rows may repeat and then
count one by one. A null id takes part, but names a class (null) only if no
document of it has another. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.components import components
from keystrata.llm.skew import each_salt, meet, salt_bits, salt_of
from keystrata.llm.text import free_names, returning, slices, spread, text_or_empty
from keystrata.sources.shared import discard, fresh_folder

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
SLICE = 28
TOLERANCE = 1e-9
#: A block holds about so many classes and bytes of n-grams at most; a longer text stands in one with others.
BLOCK = 256
BLOCK_BYTES = 8 << 20

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_BAND_KEYS = _RANDOM.integers(1, 1 << 63, ROWS, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams. Words are hashed once while there is room."""

    ROOM = 200_000

    def __init__(self, n: int = WORDS) -> None:
        self.n, self.known = n, {}

    def words(self, text: str) -> np.ndarray:
        words = text.encode().split()  # bytes split at the ASCII white space that bounds words
        known = self.known
        for w in [w for w in set(words) if w not in known]:
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.ROOM:
            self.known = {}
        return out

    def shingles(self, text: str) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        n = min(self.n, len(w))
        out = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values by multiply-add hashing of 32 mixed bits, a bounded stretch of n-grams at a time."""
    x = (_mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        part = x[k : k + 2048]
        for h in range(0, HASHES, 63):
            y = part[None, :] * _A[h : h + 63, None] + _B[h : h + 63, None]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[h : h + 63] = np.minimum(out[h : h + 63], y.min(1))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band, different bands apart."""
    x = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(ROWS):
        x = _mix(x * _BAND_KEYS[r] + signatures.reshape(-1, BANDS, ROWS)[:, :, r])
    return x


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the fewest matches that keep the posterior chance of reaching the threshold at the tolerance.

    With a uniform prior the posterior is a beta distribution; its tail is a binomial sum.
    """
    out = {}
    for n in range(SLICE, HASHES + 1, SLICE):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _described(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text -> doc_id, key of the n-gram set, number of n-grams, band keys (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in slices(batches, "text"):
            found = [shingler.shingles(t) for t in batch.column(1).to_pylist()]
            full = np.array([len(x) > 0 for x in found])
            bands = band_keys(np.array([signature(x) for x in found if len(x)], np.uint32).reshape(-1, HASHES))
            at = np.concatenate([[0], np.cumsum(full) * BANDS]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_set_key, found), pa.binary()), pa.array(map(len, found), pa.int64()), arrays], names=["doc_id", "set_key", "grams", "bands"])

    return run


def _contents(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """text -> key, signature and n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in slices(batches, "text", most_bytes=2 << 20):
            found = [shingler.shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_set_key, found), pa.binary()), pa.array([signature(x).tobytes() for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["set_key", "signature", "shingles"])

    return run


def _verify(sets: list[np.ndarray], others: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Exact similarity of (i, j) pairs. One side's n-grams are numbered once; the other's look up their numbers."""
    good = np.zeros(len(pairs), bool)
    order = np.argsort(pairs[:, 0], kind="stable")
    at = 0
    while at < len(order):
        i = pairs[order[at], 0]
        stop = at + int((pairs[order[at:], 0] == i).sum())
        own = sets[i]
        for k in order[at:stop]:
            other = others[pairs[k, 1]]
            small, large = (own, other) if len(own) <= len(other) else (other, own)
            if len(small) < threshold * len(large):
                continue
            places = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[places] == small).sum())
            good[k] = common >= threshold * (len(own) + len(other) - common)
        at = stop
    return good


def _links(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    limits = least_matches(threshold)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between the two blocks of a task (or within the one): counts per class and a forest of them."""
        left, right = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        group = group.sort_values("cid", kind="stable")
        a = group[group["block"] == left]
        b = a if left == right else group[group["block"] == right]
        sig_a, sig_b = (np.frombuffer(b"".join(x["signature"]), np.uint32).reshape(len(x), HASHES) for x in (a, b))
        bands_a, bands_b = band_keys(sig_a), band_keys(sig_b)
        candidate = np.zeros((len(a), len(b)), bool)
        for k in range(BANDS):
            candidate |= bands_a[:, k, None] == bands_b[None, :, k]
        if left == right:
            candidate &= np.tri(len(a), k=-1, dtype=bool).T
        pairs = np.argwhere(candidate)
        matches = np.zeros(len(pairs), np.int32)
        for n, least in limits.items():
            matches += (sig_a[pairs[:, 0], n - SLICE : n] == sig_b[pairs[:, 1], n - SLICE : n]).sum(1, dtype=np.int32)
            kept = matches >= least
            pairs, matches = pairs[kept], matches[kept]
        sets_a, sets_b = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (a, b))
        pairs = pairs[_verify(sets_a, sets_b, pairs, threshold)] if len(pairs) else pairs
        ids_a, ids_b, size_a, size_b = a["cid"].to_numpy(), b["cid"].to_numpy(), a["size"].to_numpy(), b["size"].to_numpy()
        links = np.bincount(pairs[:, 0], size_b[pairs[:, 1]], len(a)), np.bincount(pairs[:, 1], size_a[pairs[:, 0]], len(b))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in pairs.tolist():
            x, y = find(int(ids_a[i])), find(int(ids_b[j]))
            root[max(x, y)] = min(x, y)
        counts: dict[int, int] = {}
        for reps, n in zip((ids_a, ids_b), links, strict=True):
            for r, c in zip(reps.tolist(), n.tolist(), strict=True):
                counts[r] = counts.get(r, 0) + int(c)
        found = [(r, c, find(r)) for r, c in counts.items() if c]
        return pd.DataFrame(found, columns=["cid", "links", "root"]).astype("int64")

    return run


def _grouped(spark: SparkSession, docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text): (doc_id, set_key) per row; (set_key, first_id, class_id, n_links, size, keeper) per class.

    Every step is written to the shared folder, so a lost executor costs no more than the step it was in.
    """
    folder = fresh_folder(spark, "jaccard")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    found = kept(docs.mapInArrow(returning(_described(n)), "doc_id long, set_key binary, grams long, bands array<long>"), "documents")
    # Copies fold before the shuffle; one of their equal band lists goes on.
    classes = found.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    classes = kept(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    banded = classes.select("cid", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("n"), salt_bits("cid").alias("salts")).filter("n > 1")
    hubs = buckets.select(F.col("band").alias("hub_band"), "hub", each_salt("salts").alias("hub_salt"))
    shared = kept(banded.join(hubs, (F.col("band") == F.col("hub_band")) & (salt_of("cid") == F.col("hub_salt"))).select("cid", "band", "hub"), "shared")
    # The smallest of a class's hubs stands for all of them: one edge for the class, and edges between hubs, which repeat.
    met = shared.groupBy("cid").agg(F.min("hub").alias("a"), F.collect_set("hub").alias("hubs"))
    edges = met.select("a", F.explode(F.array_append("hubs", F.col("cid"))).alias("b")).filter("a <> b").distinct()
    together = components(spark, edges).withColumnRenamed("node", "cid").join(classes.select("cid", "grams"), "cid")
    members = together.groupBy("label").agg(F.count(F.lit(1)).alias("members"), (F.sum("grams") * 8).alias("bytes"))
    # Blocks of about equal size: by a hash within the group, as many as its size asks for.
    part = F.pmod(F.xxhash64("cid"), F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)))
    blocks = kept(meet(together, members, "label", "cid").select("cid", F.xxhash64("label", part).alias("block")), "blocks")
    meeting = shared.join(blocks, "cid").groupBy("band").agg(F.collect_set("block").alias("own"))
    tasks = meeting.select(F.explode("own").alias("low"), "own").select("low", F.explode(F.filter("own", lambda x: x >= F.col("low"))).alias("high")).distinct()
    wanted = kept(blocks.join(classes.drop("bands"), "cid"), "wanted")
    texts = docs.join(wanted.select(F.col("first_id").alias("wanted_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    contents = texts.mapInArrow(returning(_contents(n)), "set_key binary, signature binary, shingles binary").join(wanted, "set_key")
    contents = kept(contents.dropDuplicates(["cid"]).select("cid", "block", "size", "signature", "shingles"), "contents")
    sides = tasks.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    dealt = sides.join(contents, "block").repartition(spread(docs, spark), "low", "high")
    links = kept(dealt.groupBy("low", "high").applyInPandas(_links(threshold), "cid long, links long, root long"), "links")
    discard(spark, *(f"{folder}/{x}" for x in ("shared", "blocks", "wanted", "contents")))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(spark, links.select(F.col("cid").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    named = classes.drop("bands").join(counts, "cid", "left").join(linked.select(F.col("node").alias("cid"), "label"), "cid", "left")
    named = named.withColumn("label", F.coalesce("label", "cid"))
    best = F.struct(F.col("first_id").isNull().alias("no_id"), F.col("first_id").alias("id"), F.col("cid").alias("cid"))
    groups = named.groupBy("label").agg(F.min(best).alias("best"))
    result = meet(named, groups, "label", "cid").select("set_key", "first_id", F.col("best.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "size", (F.col("best.cid") == F.col("cid")).alias("keeper"))
    return found.select("doc_id", "set_key"), result


def _plain(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))


def jaccard_links(spark: SparkSession, docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links. Classes of many copies are met under salted keys."""
    if threshold < THRESHOLD:
        raise ValueError(f"the bands are laid out for thresholds of {THRESHOLD} or more")
    found, classes = _grouped(spark, _plain(docs, id_column, text_column), n, threshold)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    each = classes.select("set_key", "class_id", "n_links", F.explode(F.sequence(F.lit(0), F.when(F.col("size") > salts, salts - 1).otherwise(0))).alias("salt"), (F.col("size") > salts).alias("large"))
    once = each.filter("NOT large").drop("large", "salt")
    often = each.filter("large").drop("large")
    of_large = found.withColumn("salt", salt).join(often, ["set_key", "salt"])
    of_small = found.join(once, "set_key")
    return of_small.select("doc_id", "class_id", "n_links").unionByName(of_large.select("doc_id", "class_id", "n_links"))


def keep_one(spark: SparkSession, docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that stay: of each group the one with the smallest id, once."""
    _, classes = _grouped(spark, _plain(docs, "doc_id", "text"), n, threshold)
    names, text_at = docs.columns, docs.columns.index("text")
    key, own_id = free_names(names, "key", "id")
    stay = classes.filter("keeper").select(F.col("set_key").alias(key), F.coalesce("first_id", F.lit(-(2**63))).alias(own_id))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in slices(batches, "text"):
            keys = [_set_key(shingler.shingles(t or "")) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*names, key])

    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])
    rows = docs.mapInArrow(returning(keyed), schema).withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    return rows.join(stay, [key, own_id], "left_semi").dropDuplicates([key, own_id]).select(*names)
