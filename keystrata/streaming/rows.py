"""Results as a bounded pull iterator."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows one by one. The driver holds one partition and the next, never the whole result."""
    return df.toLocalIterator(prefetchPartitions=True)
