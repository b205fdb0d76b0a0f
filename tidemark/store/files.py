"""Small files in whatever file system a store's path names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """JSON files under a root, through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm = spark, spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def create(self, name: str, data: dict) -> None:
        """Write a file that must not exist yet."""
        out = self._fs.create(self._path(self.path(name)), False)
        try:
            out.write(bytearray(json.dumps(data, indent=1).encode()))
        finally:
            out.close()

    def swap(self, name: str, data: dict) -> None:
        """Replace a file at once: the new content is written beside it and renamed over it."""
        beside = f"{name}.{uuid.uuid4().hex}"
        self.create(beside, data)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri())
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self._path(self.path(beside)), self._path(self.path(name)), options)
