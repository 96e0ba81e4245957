"""Connected components by alternating large-star and small-star steps, as DataFrame joins.

Node sets and edges stay distributed; each step writes its edges to the shared folder. A node keeps one
edge to a smaller one, so the number of edges never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For edges (a, b) of longs: every node that has an edge to another, as (node, component), the component being its smallest node."""
    star = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        star = materialise(_small_star(_large_star(star)), "edges")
        state = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = star.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
