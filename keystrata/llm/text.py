"""What several operators share: whole texts in, bounded batches, folders that all executors see."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these white-space ones (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names for columns beside the taken ones, whatever those are (Spark compares names without case)."""
    used = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"{name}_"
        used.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds few bytes of the column; a single longer value stands alone."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, size = 0, 0
        lengths = pa.compute.binary_length(values).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (size + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


#: What a Python worker keeps from one task to the next, by the name of its owner.
WORKER_CACHE: dict[str, object] = {}


def drop_caches(keeps: str) -> None:
    """Of this process. By name, so that a task reaches the module's own dictionary and no pickled copy of it."""
    for name in [x for x in WORKER_CACHE if x != keeps]:
        del WORKER_CACHE[name]


def returning(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """The function; before it others' caches go, after it freed memory goes back to the system: Python workers live on."""

    def wrapped(batches: Iterator) -> Iterator:
        drop_caches(keeps)
        yield from run(batches)
        gc.collect()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def spread(df: DataFrame, spark: SparkSession) -> int:
    """Partitions for a stage that re-deals rows: the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def vocabulary() -> str:
    """The public tokenizer's file; its package is installed beside Spark on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
