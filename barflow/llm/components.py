"""Connected components of links between 64-bit keys, by alternating large-star and small-star steps on tables.

A key's smallest neighbour is a grouped minimum (combined before the shuffle) joined back, so a hub's links are dealt like
any skewed join and never gathered in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import stored


def _with_least(links: DataFrame) -> DataFrame:
    """Links (u, v) with m, the smallest v of each u."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u")


def _step(now: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links (u, v) with u > v."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    near = _with_least(stored(large.distinct(), "large_stars"))
    ends = F.explode(F.when(F.col("v") == F.col("m"), F.array("u")).otherwise(F.array("u", "v")))
    return near.select(ends.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _settled(now: DataFrame) -> bool:
    """True when each key hangs on one root and no root hangs on another key."""
    ends = now.select(F.col("u").alias("key"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("key"), F.lit(0).alias("up")))
    sums = ends.groupBy("key").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not sums.where("up > 1 or (up = 1 and least = 0)").take(1)


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key that occurs in links (a, b); the root is the smallest key of its component."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _settled(now):
        now = stored(_step(now), "stars")
    return now.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
