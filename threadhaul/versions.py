"""Versions of a table that several writers may change: a log of numbered entries.

An entry names the folder that holds the table from then on. It is committed by giving its number to
a file if no other writer has: who comes second learns so, and works again on what the first has left. The
catalog is brought in line with the newest entry by whoever looks at the table next, so that nothing depends on
the steps behind a commit. The file system must rename without replacing, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Older entries are of no use to anyone.
_KEPT = 10


class WriteConflict(RuntimeError):
    """Other writers have changed the table again and again, or in the midst of what cannot be repeated."""


@dataclass(frozen=True)
class Version:
    """`previous` is the folder that readers of the version before may still use."""

    number: int
    location: str
    previous: str | None = None


class VersionLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def latest(self) -> Version | None:
        if not self._files.exists(self._path("")):
            return None
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(""))]
        numbers = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
        if not numbers:
            return None
        stream = self._files.open(self._path(numbers[-1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def commit(self, version: Version) -> bool:
        """Whether the version is the one of its number; no, if another writer was first."""
        draft, final = self._path(f".{uuid.uuid4().hex}.draft"), self._path(f"{version.number:020d}.json")
        self._files.mkdirs(self._path(""))
        if self._files.exists(final):
            return False
        stream = self._files.create(draft, True)
        stream.write(bytearray(json.dumps(asdict(version)).encode()))
        stream.close()
        rename = getattr(self._fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(final), options)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        if version.number >= _KEPT:
            self._files.delete(self._path(f"{version.number - _KEPT:020d}.json"), False)
        return True
