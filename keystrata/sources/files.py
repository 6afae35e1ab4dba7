"""The few file-system calls the store needs, on whatever file system the root lies."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def capacity(self) -> int:
        return self._fs.getStatus().getCapacity()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Writes a new file whole, or fails with FileExistsError: it appears under its name at once, and never in place of another.

        On one machine by a hard link, elsewhere by a rename that doesn't overwrite, which HDFS and its like do atomically.
        """
        part = f"{path}.{uuid.uuid4().hex}.part"
        stream = self._fs.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(*(self._path(x).toUri().getPath() for x in (part, path)))
            elif self.exists(path) or not self._fs.rename(self._path(part), self._path(path)):
                raise FileExistsError(path)
        finally:
            self.delete(part)
