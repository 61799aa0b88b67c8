"""Choices and orders by hash in groups of any size.

A keyed hash (hex digits) gives every row of a group its place in a random order.  The leading ``DIGITS`` digits cut a group into
ordered buckets; only bucket totals are accumulated over a whole group, and rows are ordered inside one bucket, so neither
a sort nor a window ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import stored

DIGITS = 3


def keyed_hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def bucket_of(digest: Column, digits: int = DIGITS) -> Column:
    """Bucket of a hash: its leading hex digits as a number, in the order of the hashes."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def _ahead(totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bucket totals with ``_before``, the sum of the group's earlier buckets: at most 16 ** digits rows a group."""
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def nth_smallest(rows: DataFrame, keys: list[str], digest: str, ties: list[str], wanted: Column, digits: int = DIGITS) -> DataFrame:
    """(keys, last): the n-th smallest (digest, ties) of each group, ``wanted`` giving n from the group's size ``size``.

    A row is among the first n exactly where its (digest, ties) is at most ``last``.
    """
    d = rows.select(*keys, digest, *ties).withColumn("_bucket", bucket_of(F.col(digest), digits))
    totals = stored(d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "hash_buckets")
    need = totals.groupBy(*keys).agg(F.sum("_n").alias("size")).select(*keys, wanted.cast("bigint").alias("_want"))
    edge = _ahead(totals, keys, "_n").join(need, keys).where("_before < _want and _want <= _before + _n")
    edge = stored(edge.select(*keys, "_bucket", (F.col("_want") - F.col("_before")).alias("_place")), "hash_edges")  # one row a group
    inside = Window.partitionBy(*keys, "_bucket").orderBy(digest, *ties)
    ranked = d.join(edge, [*keys, "_bucket"]).withColumn("_rank", F.row_number().over(inside))
    return ranked.where("_rank = _place").select(*keys, F.struct(digest, *ties).alias("last"))


def running_offset(rows: DataFrame, keys: list[str], digest: str, ties: list[str], value: str, name: str, digits: int = DIGITS) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the group that come before in the order (digest, ties)."""
    d = rows.withColumn("_bucket", bucket_of(F.col(digest), digits))
    totals = d.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_n"))
    before = _ahead(totals, keys, "_n").select(*keys, "_bucket", "_before")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(digest, *ties).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(before, [*keys, "_bucket"])
    return d.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_before")
