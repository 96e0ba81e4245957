"""Reconciliation of files against tables, integrity checks, and repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import body_hash, stem_of_path
from quillspark.operators import links
from quillspark.operators.lookup import outdated_models

#: Deletions beyond the larger of these need force.
GUARD_ROWS, GUARD_SHARE = 10, 0.5


def diff(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_type, path, action): index what is new or differs in size or time, delete what has vanished, skip the rest."""
    disk = files.select("doc_type", "path", F.col("mtime").alias("f_mtime"), F.col("size").alias("f_size"))
    rows = docs.select("doc_type", "path", F.col("mtime").alias("d_mtime"), F.col("size").alias("d_size"))
    action = (
        F.when(F.col("f_mtime").isNull(), "delete")
        .when(F.col("d_mtime").isNull(), "index")
        .when((F.col("f_mtime") != F.col("d_mtime")) | (F.col("f_size") != F.col("d_size")), "index")
        .otherwise("skip")
    )
    return disk.join(rows, ["doc_type", "path"], "full").select("doc_type", "path", action.alias("action"))


def report(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def guard(plan: DataFrame, docs: DataFrame) -> DataFrame:
    """(n_delete, n_docs, allowed): refuse to delete more than ten rows and half of the table; the table is counted before."""
    return plan.agg(F.count_if(F.col("action") == "delete").alias("n_delete")).crossJoin(docs.agg(F.count("*").alias("n_docs"))).withColumn(
        "allowed", F.col("n_delete") <= F.greatest(F.lit(float(GUARD_ROWS)), F.col("n_docs") * GUARD_SHARE)
    )


def stale(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose stored hash is not that of the body on disk."""
    disk = files.select("doc_type", "path", body_hash(F.col("body")).alias("disk_hash"))
    return docs.join(disk, ["doc_type", "path"]).filter("hash <> disk_hash").select("doc_type", "path")


def untracked(files: DataFrame, docs: DataFrame) -> DataFrame:
    return files.join(docs, ["doc_type", "path"], "left_anti").select("doc_type", "path")


def vanished(files: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.join(files, ["doc_type", "path"], "left_anti").select("doc_type", "path")


def mismatched_raw(files: DataFrame) -> DataFrame:
    """Raw files whose path does not spell the hash of their body."""
    from quillspark.functions.text import hash_of_raw_path

    return files.filter(F.col("doc_type") == "raw").filter(hash_of_raw_path(F.col("path")) != body_hash(F.col("body"))).select("doc_type", "path")


def lint(files: DataFrame, docs: DataFrame, pages: DataFrame, model: str) -> DataFrame:
    """(kind, page, target) of all seven checks. ``pages``: stem, title, body."""

    def issues(kind: str, rows: DataFrame, page, target=None) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), page.alias("page"), (F.lit(None).cast("string") if target is None else target).alias("target"))

    stem = stem_of_path(F.col("path"))
    wiki_files, wiki_docs = (x.filter("doc_type = 'wiki'") for x in (files, docs))
    names = pages.select("stem", F.col("title").alias("name")).union(pages.select("stem", F.translate("stem", "-", " ")))
    return reduce(
        DataFrame.union,
        [
            issues("StaleIndex", stale(wiki_files, wiki_docs), stem),
            issues("UntrackedFile", untracked(wiki_files, wiki_docs), stem),
            issues("MissingFile", vanished(wiki_files, wiki_docs), stem),
            issues("OutdatedEmbedding", outdated_models(docs, model), F.col("embed_model"), F.col("n").cast("string")),
            issues("RawHashMismatch", mismatched_raw(files), F.col("path")),
            issues("DanglingLink", links.dangling(pages), F.col("src"), F.col("dst")),
            issues("MissingLink", links.missing(pages, names), F.col("src"), F.col("dst")),
        ],
    )


def still_present(found: DataFrame, now: DataFrame) -> DataFrame:
    """Issues with whether a fresh check still finds them; the others are stale and are not repaired."""
    fresh = now.select(F.col("kind").alias("k"), F.col("page").alias("p"), F.col("target").alias("t")).distinct().withColumn("here", F.lit(True))
    same = F.col("kind").eqNullSafe(F.col("k")) & F.col("page").eqNullSafe(F.col("p")) & F.col("target").eqNullSafe(F.col("t"))
    return found.join(fresh, same, "left").select("kind", "page", "target", F.coalesce("here", F.lit(False)).alias("present"))


REPAIRS = {
    "StaleIndex": "reindex", "UntrackedFile": "reindex", "MissingFile": "drop_row", "OutdatedEmbedding": "embed_again",
    "RawHashMismatch": "move_or_drop", "DanglingLink": "report", "MissingLink": "report",
}


def repair_plan(found: DataFrame) -> DataFrame:
    """What each issue calls for; link issues are reported only."""
    table = F.create_map(*[F.lit(x) for pair in REPAIRS.items() for x in pair])
    return found.withColumn("repair", table[F.col("kind")])


def repaired(files: DataFrame, docs: DataFrame) -> DataFrame:
    """The document rows after repair: vanished ones gone, stale and untracked ones as on disk."""
    fresh = files.select("doc_type", "path", body_hash(F.col("body")).alias("hash"), "size", "mtime")
    rest = [c for c in docs.columns if c not in fresh.columns]
    return fresh.join(docs.select("doc_type", "path", *rest), ["doc_type", "path"], "left")
