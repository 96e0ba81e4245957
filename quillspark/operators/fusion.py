"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bonus of the first rank and of ranks two and three, not weighted.
FIRST, NEXT = 0.05, 0.02


def ranked(hits: DataFrame, lane: str, weight: float, limit: int, keys: tuple[str, ...] = ("path", "chunk_seq")) -> DataFrame:
    """The best ``limit`` hits with their 1-based rank: a top-k sort, then a window over those few rows."""
    top = hits.orderBy(F.desc("score"), *keys).limit(limit)
    order = Window.partitionBy(F.lit(lane)).orderBy(F.desc("score"), *keys)
    return top.withColumns({"lane": F.lit(lane), "weight": F.lit(float(weight)), "rank": F.row_number().over(order)})


def gain(weight: Column, rank: Column, k: int = 60) -> Column:
    """What a rank in one of several lists is worth."""
    return weight / (F.lit(float(k)) + rank) + F.when(rank == 1, FIRST).when(rank <= 3, NEXT).otherwise(0.0)


def fuse(lists: list[DataFrame], k: int = 60, keys: tuple[str, ...] = ("path", "chunk_seq"), payload: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rrf, position, score): sums of weight / (k + rank) plus bonuses; score is 1 / position.

    One list alone gets no bonus. Ties fall by key. The payload is that of a key's first best rank.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)
    worth = gain(F.col("weight"), F.col("rank"), k) if len(lists) > 1 else F.col("weight") / (F.lit(float(k)) + F.col("rank"))
    first = [F.min_by(c, F.struct("rank", "lane")).alias(c) for c in payload]
    fused = rows.groupBy(*keys).agg(F.sum(worth).alias("rrf"), *first)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("rrf", 12)), *keys)
    fused = fused.withColumn("position", F.row_number().over(order))
    return fused.withColumn("score", 1.0 / F.col("position"))


def accuracy_at(ranked: DataFrame, questions: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(cutoff, accuracy, questions): the share of ``questions`` (qid) with a right answer among their first results, for all cut-offs
    in one pass: ``ranked`` (qid, rank, right) is folded to each question's first right rank."""
    first = ranked.filter("right").groupBy("qid").agg(F.min("rank").alias("first"))
    joined = questions.join(first, "qid", "left").select(F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff"), "first")
    return joined.groupBy("cutoff").agg(F.avg(F.coalesce(F.col("first") <= F.col("cutoff"), F.lit(False)).cast("double")).alias("accuracy"), F.count("*").alias("questions"))
