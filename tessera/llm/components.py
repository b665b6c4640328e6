"""Connected components of links between 64-bit nodes, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the links; nothing is collected, and a node with very many links
only adds rows to a minimum that is combined before the shuffle and to a join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _mins(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mins = _mins(both).select("a", F.least("a", "m").alias("m"))
    return both.join(mins, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    mins = _mins(links)
    moved = links.join(mins, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
    return moved.select("x.a", "x.b").where("a > b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node of links (a, b); links may be null or loops."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") == F.col("b")).alias("loop"))
    now = store.saved(ordered.where("a is not null and b is not null and not loop").select("a", "b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        after = store.saved(_small_star(_large_star(now)), "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        store.drop(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
