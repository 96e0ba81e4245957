"""Session construction for local runs, tests and benchmarks; and the shared folder for derived tables."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def local_session(cores: int | str = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A local session with UTC time and AQE; cluster jobs bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLSPARK_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def bounded_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of at most ``BATCH_BYTES``; a larger row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def workspace(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share: under ``spark.checkpoint.dir``, or a temporary
    one where that is unset and the session is local. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/derived-{spark.sparkContext.applicationId}"
    if folder not in _known:
        _known.add(folder)
        atexit.register(_drop, spark, folder)
    return folder


def stage(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the workspace: what reads it more than once does not work it out again, and a lost executor costs a re-read."""
    path = f"{workspace(rows.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


_known: set[str] = set()


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass
