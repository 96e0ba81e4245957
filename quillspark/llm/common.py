"""Helpers shared by the corpus operators: tables, scratch space, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; the same class in Python, Java and RE2.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_CLASS)
#: Bytes of text that Python code turns into arrays at a time; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python; a larger single row is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """The words of a text. ``str.split`` without arguments would also split at Unicode spaces."""
    return WORD.findall(text) if text else []


def ascii_lower(text: str) -> str:
    """Lower-case A-Z alone, so that every engine agrees on the result."""
    if text.isascii():
        return text.lower()
    return text.translate(_ASCII_LOWER)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it while a column of ``taken`` is called so (in any case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where unset.

    The temporary one serves local sessions, where driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def _clean(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder; the folder goes when the driver ends."""
    folder = scratch_dir(spark)
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_clean, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    A lost executor then costs a re-read, never a recomputation, and later plans see real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare_python(spark: SparkSession) -> None:
    """Settings for Arrow code: batches of bounded rows and bytes, and this package on the workers' path.

    A batch is held by the JVM, outside its heap, and by the worker at once; Spark's own limit is 64 MB.

    A cluster installs the package or ships it with ``--py-files``; the path helps local and shared-disk runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have at most ``limit`` bytes, or are one text."""
    for batch in batches:
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(text)).to_pylist()]
        start = total = 0
        for i, size in enumerate(sizes):
            if total + size > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def text_size(column: str = "text") -> "F.Column":
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
