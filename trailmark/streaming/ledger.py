"""A ledger of micro-batches in the shared folder: what a stream has done, by batch id.

A batch that is replayed after a failure has its old id.  Writers that keep
their output by batch id overwrite the same place; others ask the ledger first.
Entries are small JSON files written beside and renamed into place, on any file
system that Spark can reach.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._read = jvm.org.apache.commons.io.IOUtils.toString
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def get(self, name: str) -> dict | None:
        path = self._path(f"{self.folder}/{name}.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._read(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, value: dict) -> None:
        """Keeps the first value of a name: a replay does not change what later batches were decided by."""
        path = self._path(f"{self.folder}/{name}.json")
        if self._fs.exists(path):
            return
        beside = self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        self._fs.rename(beside, path)

    def first(self, name: str, value: dict) -> dict:
        """The value kept under ``name``, which is ``value`` if there was none."""
        self.put(name, value)
        return self.get(name)

    def exists(self, folder: str) -> bool:
        return self._fs.exists(self._path(folder))
