"""A table's versions as numbered entries, put there once and read whole.

An entry is written beside the log and given its number in one step that fails where the number is
taken: a hard link on a local disk, a rename without overwriting elsewhere (atomic on HDFS; object
stores without such a rename need a writer of their own at a time).  A writer whose number is taken has
lost to another one and starts again from what that one left.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, n: int) -> str:
        return f"{self.root}/{n:020d}.json"

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def read(self, n: int) -> dict:
        stream = self._fs.open(self._path(self._at(n)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict] | None:
        """The number and the entry of the last version."""
        while found := self.versions():
            try:
                return found[-1], self.read(found[-1])
            except Py4JJavaError:  # removed between the two calls
                if found == self.versions():
                    raise
        return None

    def put(self, n: int, entry: dict) -> bool:
        """Whether the entry got the number."""
        spare, target = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._fs.makeQualified(self._path(self._at(n)))
        out = self._fs.create(spare)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        try:
            if target.toUri().getScheme() == "file":
                os.link(self._fs.makeQualified(spare).toUri().getPath(), target.toUri().getPath())
            else:
                jvm = self.spark._jvm
                how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(spare), target, how)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self._fs.delete(spare, False)
        return True

    def forget(self, before: int) -> None:
        """Removes the entries below a number."""
        for n in self.versions():
            if n < before:
                self._fs.delete(self._path(self._at(n)), False)
