"""A log of commits: numbered JSON records in a folder, the last of which is the state of a derived store.

A record is written aside and renamed to the next number without overwriting. Of two writers that began from
the same state one gets ``Conflict``; readers see a whole state, and what it names never changes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the state was read."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def last(self, number: int | None = None) -> tuple[int, dict]:
        """The number and the state of the last commit, or of one by its number; (0, {}) before the first."""
        if not self.fs.exists(self._path()):
            return 0, {}
        numbers = [int(n[:-5]) for s in self.fs.listStatus(self._path()) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        number = max(numbers) if number is None else number
        stream = self.fs.open(self._path(f"{number:012d}.json"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> None:
        """Make ``state`` the commit of that number; raises Conflict where it exists."""
        staged, place = self._path(f".{uuid.uuid4().hex}"), self._path(f"{number:012d}.json")
        out = self.fs.create(staged, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, place, self.spark.sparkContext._gateway.new_array(self.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(staged, False)
            if self.fs.exists(place):
                raise Conflict(f"commit {number} of {self.root} exists") from e
            raise
