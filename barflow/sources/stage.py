"""Intermediate tables that cut lineage: written once to shared storage, then read as columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def stage_root(spark) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those stored with ``outlast``.

    What is read from them must have been written by then: a scope belongs around a step whose result is itself stored.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def stored(df: DataFrame, label: str = "stage", outlast: bool = False) -> DataFrame:
    """Write ``df`` and return a scan of it; inside a :func:`scope` it is deleted at the scope's end, unless it is to ``outlast`` it.

    Plans that use a table several times (profiles, calendars, previous sessions) then re-read a
    small pruned table instead of recomputing it from ticks, and survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    around = _SCOPES[:-1] if outlast else _SCOPES
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
