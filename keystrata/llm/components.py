"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.skew import each_salt, salt_bits, salt_of
from keystrata.llm.text import returning
from keystrata.sources.shared import discard, fresh_folder

#: Nodes that a task holds at once while it contracts its edges.
HELD = 500_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as a forest: each node with the smallest node that the task connects it to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def forest() -> pa.RecordBatch:
        pairs = [(find(x), x) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        if len(up) > HELD:
            yield forest()
            up.clear()
    yield forest()


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node of its component.

    Each task first contracts its own edges to a forest. Then every node takes, round by round, the least label
    among itself and its neighbours, then the label of that label, so a path of length n takes about log n
    rounds. Rounds are written to the shared folder. Hubs and labels of many nodes meet their edges and nodes
    under salted keys, so neither is one task's load.

    Defined results: an edge with a null end is no edge; edges that repeat and edges from a node to itself add
    nothing (a node with no other edge is not returned); no edges give no rows.
    """
    folder = fresh_folder(spark, "components")
    own = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    own = own.mapInArrow(returning(_contracted), "a long, b long")
    both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both.distinct().write.parquet(f"{folder}/edges")
    both = spark.read.parquet(f"{folder}/edges")
    # The salts under which a node's edges look for its label are those of its neighbours.
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"), salt_bits("b").alias("salts"))
    first.write.parquet(f"{folder}/0")
    for k in range(most_rounds):
        labels = spark.read.parquet(f"{folder}/{k}")
        dealt = labels.select(F.col("node").alias("b"), "label", each_salt("salts").alias("salt"))
        near = both.withColumn("salt", salt_of("a")).join(dealt, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node", "left").select("node", "salts", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        stepped.write.parquet(f"{folder}/{k}-stepped")
        stepped = spark.read.parquet(f"{folder}/{k}-stepped")
        jump = stepped.groupBy("label").agg(salt_bits("node").alias("present")).join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        jump = jump.select("label", "further", each_salt("present").alias("salt"))
        moved = stepped.withColumn("salt", salt_of("node")).join(jump, ["label", "salt"])
        moved.select("node", "salts", F.least("label", "further").alias("label"), "old").write.parquet(f"{folder}/{k + 1}")
        discard(spark, f"{folder}/{k}-stepped", f"{folder}/{k}")
        if spark.read.parquet(f"{folder}/{k + 1}").filter("label <> old").isEmpty():
            discard(spark, f"{folder}/edges")
            return spark.read.parquet(f"{folder}/{k + 1}").select("node", "label")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
