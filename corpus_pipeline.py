"""A corpus pipeline of five stages; each reads what the one before has written.

toxicity drops documents predicted toxic; near_duplicates keeps one document of each group; decontamination
drops documents that hold a benchmark passage; mixing repeats or drops documents to meet the sources' target
weights; tokens writes token files and returns one row per document read back from them.

Defined results, for every stage: an empty table gives an empty one; a null text counts as empty and a null id or
source as a value of its own; whole texts count, however long; rows that repeat are separate documents until near_duplicates keeps
one of them; columns beside doc_id, text and source are carried along, whatever their names, and the last stage drops them.
Each stage's docstring says what it does with texts that say nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm.decontaminate import drop_contaminated
from keystrata.llm.jaccard_join import keep_one
from keystrata.llm.mixing import apply_mix
from keystrata.llm.text import read_table, vocabulary
from keystrata.llm.token_files import token_files
from keystrata.llm.toxicity import drop_toxic, train
from keystrata.sources.shared import discard, fresh_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops predicted documents. An empty text has no evidence and stays; without labels of both classes all stay."""
    return drop_toxic(docs, train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group, a null id only where no other is. Texts without words are copies of each other."""
    return keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; an empty text or an empty benchmark is none."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents; one without words has nothing to give to the mix and goes."""
    return apply_mix(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document as the files have it; an empty text is the end id alone."""
    return token_files(spark, docs, vocabulary(), end_id=2)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: No stage but the mix can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; a stage's rows are removed once the next has written its own."""
    folder = fresh_folder(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            discard(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
