"""Small files beside a table, on any file system Spark knows."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """Small files in a folder that any file system Spark knows may hold."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path(path)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(self._path).toUri(), conf)
        kind = getattr(self._hadoop, "Options$Rename")
        self._never_over = spark.sparkContext._gateway.new_array(kind, 1)
        self._never_over[0] = kind.NONE

    def names(self) -> list[str]:
        if not self._fs.exists(self._path):
            return []
        return [f.getPath().getName() for f in self._fs.listStatus(self._path)]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._hadoop.Path(self._path, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Put a whole file in place; false if there is one of that name."""
        self._fs.mkdirs(self._path)
        draft, place = self._hadoop.Path(self._path, f".{uuid.uuid4().hex}"), self._hadoop.Path(self._path, name)
        stream = self._fs.create(draft, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        try:
            self._context.rename(draft, place, self._never_over)
        except Py4JJavaError as failed:
            if "FileAlreadyExists" not in failed.java_exception.getClass().getName():
                raise
            self._fs.delete(draft, False)
            return False
        return True
