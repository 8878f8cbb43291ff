"""Connected components by alternating large and small stars, wholly on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES_A_TASK = 250_000


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each id of an edge (u, v) with the smallest id that it can reach.

    Rounds go on until one changes nothing; they are some log**2 of the number of ids at most. The number of tasks
    of a round follows the number of edges, which never grows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
        tasks = 1 + now[0] // EDGES_A_TASK
        e = e.coalesce(tasks)
        both = _both(e)
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct().coalesce(tasks)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.unionByName(small.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks).checkpoint()
