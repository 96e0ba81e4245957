"""File sources: page and raw trees, statted without reading bodies, or parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import body_hash, front_block, front_list, front_value, hash_of_raw_path, normalise_collections, page_body, stem_of_path, summary_line, title_fallback

MAX_BYTES = 100 << 20


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(doc_type, path, mtime, size) of pages (``wiki/*.md``) and raw files (``raw/<hh>/<rest>``); bodies are not read."""
    return _scan(spark, root).drop("content")


def _scan(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/")

    def part(glob: str, kind: str) -> DataFrame:
        rows = spark.read.format("binaryFile").load(f"{base}/{glob}")
        path = F.regexp_extract("path", r"((?:wiki|raw)/.*)$", 1)
        return rows.select(F.lit(kind).alias("doc_type"), path.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), F.col("length").alias("size"), "content")

    return part("wiki/*.md", "wiki").unionByName(part("raw/*/*", "raw"))


def read_tree(spark: SparkSession, root: str, limit: int = MAX_BYTES) -> DataFrame:
    """Files with their parsed head and body; larger ones than ``limit`` and those that are no UTF-8 are left out."""
    rows = _scan(spark, root).filter(F.col("size") <= limit)
    text = rows.withColumn("text", F.when(F.expr("is_valid_utf8(cast(content AS string))"), F.col("content").cast("string"))).filter("text is not null").drop("content")
    return parse(text)


def parse(files: DataFrame) -> DataFrame:
    """Add title, summary, collections, sources, created_at, body, hash from ``text``."""
    block = front_block(F.col("text"))
    body = page_body(F.col("text"))
    out = files.withColumns({"_b": block, "body": body})
    source = front_value(F.col("_b"), "source")
    return out.select(
        *[c for c in files.columns if c != "text"],
        "body",
        body_hash(F.col("body")).alias("hash"),
        stem_of_path(F.col("path")).alias("stem"),
        F.coalesce(front_value(F.col("_b"), "title"), title_fallback(F.col("body"), F.coalesce(source, F.col("path")))).alias("title"),
        F.coalesce(front_value(F.col("_b"), "summary"), summary_line(F.col("body"), 120)).alias("summary"),
        normalise_collections(F.coalesce(front_list(F.col("_b"), "collections"), F.array().cast("array<string>"))).alias("collections"),
        front_list(F.col("_b"), "sources").alias("sources"),
        source.alias("source"),
        F.try_to_timestamp(front_value(F.col("_b"), "created_at")).alias("created_at"),
    )


def changed(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Listed files that no row has with this size and time: only these need reading."""
    return files.join(docs.select("doc_type", "path", "mtime", "size"), ["doc_type", "path", "mtime", "size"], "left_anti")


def verified_raw(files: DataFrame) -> DataFrame:
    """Raw files with whether their path spells their hash."""
    return files.filter("doc_type = 'raw'").withColumn("hash_ok", hash_of_raw_path(F.col("path")) == F.col("hash"))


def stale_temporaries(files: DataFrame, now_ns: int, age_ns: int = 3_600_000_000_000) -> DataFrame:
    """Left-over temporary files older than an hour."""
    return files.filter(F.col("path").rlike(r"\.tmp\.[0-9]+\.[0-9a-f]+$") & (F.lit(now_ns) - F.col("mtime") > age_ns))
