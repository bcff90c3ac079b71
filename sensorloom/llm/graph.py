"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.session import durable


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component`` (smallest id reachable) for every end of an edge.

    Each round links every vertex to the smallest of its neighbourhood; a hub's neighbours are
    rows of an exchange, never one collected list. Rounds grow with the logarithm of the
    diameter. Each is checkpointed in the shared folder, so a lost executor repeats one round.
    Loops, repeated edges and nulls on either side change nothing.
    """
    pairs = (
        edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    current = durable(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        after = durable(_small_star(_large_star(current)))
        same = after.join(current, ["v", "u"], "left_anti").isEmpty() and current.join(after, ["v", "u"], "left_anti").isEmpty()
        current = after
        if same:
            break
    ids = current.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return ids.union(ids.select(F.col("component").alias("id"), "component").distinct()).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    return both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    joined = edges.join(least, "v")
    return (
        joined.select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
    )
