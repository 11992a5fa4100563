"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import forget, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for each vertex of ``edges(src, dst)`` (both long): the smallest id it reaches.

    Vertices with loops only don't appear. Every step is a grouped minimum (combined before its shuffle) and
    a join; a step's edges are written to the shared folder, and the steps end when the edges no longer
    change. Null ends are ignored.
    """
    bigger, smaller = F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    now = materialize(edges.where("src is not null and dst is not null and src != dst").select(bigger, smaller).distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = materialize(small.unionAll(low).distinct(), "edges")
        for x in (now, least, large, low):
            forget(x)
        last, seen, now = seen, mark(then), then
        if last == seen:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())
