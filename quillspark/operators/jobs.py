"""The durable job queue and the reply cache, as keyed merges over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def insert_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs join; a known job goes back to pending only where it had failed."""
    again = new.select("job_id").distinct().withColumn("_again", F.lit(True))
    reset = F.coalesce("_again", F.lit(False)) & (F.col("status") == "failed")
    kept = jobs.join(again, "job_id", "left").withColumns({"error": F.when(~reset, F.col("error")), "status": F.when(reset, "pending").otherwise(F.col("status"))}).drop("_again")
    fresh = new.dropDuplicates(["job_id"]).join(jobs, "job_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def set_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (job_id, new_status, new_error, at)."""
    hit = F.col("new_status").isNotNull()
    return (
        jobs.join(changes, "job_id", "left")
        .withColumns({"status": F.when(hit, F.col("new_status")).otherwise(F.col("status")), "error": F.when(hit, F.col("new_error")).otherwise(F.col("error")), "updated_at": F.when(hit, F.col("at")).otherwise(F.col("updated_at"))})
        .drop("new_status", "new_error", "at")
    )


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs left in flight by a crash have failed."""
    stuck = F.col("status") == "processing"
    return jobs.withColumns({"error": F.when(stuck, F.lit("interrupted")).otherwise(F.col("error")), "updated_at": F.when(stuck, now).otherwise(F.col("updated_at")), "status": F.when(stuck, "failed").otherwise(F.col("status"))})


def prune(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Terminal jobs older than ``days`` go."""
    return jobs.filter(~(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < now - F.make_dt_interval(F.lit(days)))))


def prune_cache(cache: DataFrame, now: Column, days: int) -> DataFrame:
    return cache.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def insert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The first writer of a key wins."""
    first = new.groupBy("key").agg(F.min_by("result", "created_at").alias("result"), F.min("created_at").alias("created_at"))
    return cache.unionByName(first.join(cache, "key", "left_anti"))


def dashboard(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pending", "processing", "completed", "failed")), F.max("updated_at").alias("last_update"))
