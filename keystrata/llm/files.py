"""Binary files in a folder that the driver and all executors share.

Spark's own writers have no sink for archives or token shards, so tasks write them through Arrow's file
systems, which know local, HDFS, S3 and GCS addresses. A file is written under a name of the attempt and
then moved to its final name, so a retried or speculative task replaces a file by an equal one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def locate(address: str) -> tuple[fs.FileSystem, str]:
    address = address.replace("s3a://", "s3://", 1) if address.startswith("s3a://") else address
    return fs.FileSystem.from_uri(address)


@contextmanager
def replacing(address: str) -> Iterator:
    """A stream whose file appears under its name only when it is complete."""
    system, path = locate(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    stream = system.open_output_stream(part)
    try:
        yield stream
        stream.close()
        system.move(part, path)
    except BaseException:
        stream.close()
        system.delete_file(part)
        raise


def open_random(address: str):
    system, path = locate(address)
    return system.open_input_file(path)
