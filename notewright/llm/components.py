"""Connected components of very many edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    moved = both.filter(F.col("b") > F.col("a")).join(least, "a")
    return moved.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b), root the least node that it reaches.
    Both ends have one orderable type; repeated edges and loops do no harm. Minima are
    combined before they are shuffled, so a node may have any number of edges. Each round
    is written to the shared folder; the number of rounds grows with the logarithm of the
    longest chain."""
    a, b = edges.columns[:2]
    start = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") != F.col("b"))
    now = materialize(start.distinct(), label)
    before = None
    while True:
        # after a small star every node but the roots has its least neighbour as b
        after = materialize(_small_star(_large_star(now)), label)
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = after
        if state["n"] == 0 or state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
