"""Document store: keyed merges, garbage collection, and snapshots with an atomic pointer.

Plain Parquet has no MERGE, so a change writes a new snapshot folder and then renames a small pointer
file over the old one; readers see the old snapshot or the new one whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def outcome(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_type, path, outcome) of each new document: inserted, updated, unchanged."""
    left = old.select("doc_type", "path", F.col("hash").alias("old_hash"))
    right = new.select("doc_type", "path", F.col("hash").alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    return right.join(left, ["doc_type", "path"], "left").select("doc_type", "path", state.alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_type", "path"), order: str = "mtime") -> DataFrame:
    """The latest row of each key; on a tie the new one."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "_new")


def delete(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone, ["doc_type", "path"], "left_anti")


def collect_garbage(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose body some document still has."""
    return chunks.join(docs.select("hash").distinct(), "hash", "left_semi")


def orphans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs, "hash", "left_anti")


def replace_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Memberships of the documents in ``new`` (doc_id, name) become exactly those."""
    return members.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new.distinct())


def union_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Memberships of both, trimmed and in small letters; a document of ``new`` that had none keeps ``default`` beside them."""
    implied = new.select("doc_id").distinct().join(members, "doc_id", "left_anti").withColumn("name", F.lit("default"))
    every = members.unionByName(new).unionByName(implied)
    return every.select("doc_id", F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()


def ensure_default(docs: DataFrame, members: DataFrame) -> DataFrame:
    lone = docs.select("doc_id").join(members, "doc_id", "left_anti").withColumn("name", F.lit("default"))
    return members.unionByName(lone)


class SnapshotTable:
    """A table as numbered snapshot folders and a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop
        self.path = jvm.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        pointer = self.path(f"{self.root}/CURRENT")
        if not self.fs.exists(pointer):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def read(self) -> DataFrame:
        at = self.current()
        if at is None:
            raise FileNotFoundError(f"{self.root} has no snapshot")
        return self.spark.read.parquet(f"{self.root}/{at}")

    def commit(self, rows: DataFrame) -> DataFrame:
        """Write a snapshot, then move the pointer; a failure before the move leaves the old one current."""
        name = f"snap-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        staged = self.path(f"{self.root}/.CURRENT-{name}")
        out = self.fs.create(staged, True)
        out.write(bytearray(name.encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        flags = self.spark.sparkContext._gateway.new_array(options, 1)
        flags[0] = options.OVERWRITE
        context.rename(staged, self.path(f"{self.root}/CURRENT"), flags)
        return self.read()

    def vacuum(self) -> int:
        """Drop snapshots that are not current."""
        at, gone = self.current(), 0
        for status in self.fs.listStatus(self.path(self.root)):
            name = status.getPath().getName()
            if name.startswith("snap-") and name != at:
                self.fs.delete(status.getPath(), True)
                gone += 1
        return gone
