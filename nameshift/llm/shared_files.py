"""Files of our own formats in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from nameshift.session import scratch_dir


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/nameshift/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def open_at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI; a plain path, or ``file:/`` with any number of slashes, is local."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class Part:
    """A file that one attempt of a task writes. Its name is its own, so a repeated attempt never writes into it;
    the rows that the attempt returns name it, and only files named there are read."""

    def __init__(self, folder: str, number: int, suffix: str):
        self.uri = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}{suffix}"
        store, path = open_at(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = store.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def read_stream(uri: str):
    store, path = open_at(uri)
    return store.open_input_stream(path, compression=None)
