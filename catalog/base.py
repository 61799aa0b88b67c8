"""Registry of named queries: a Spark plan, its output columns and the equivalent SQL text.

A column spec such as ``"symbol:s ts_event:t x:d"`` is applied to both sides, so names, types and
rounding agree: s string, i bigint, d double rounded to six places (NaN and infinities become null),
t timestamp as epoch microseconds, D date as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import bars as bar_ops
from barflow.sources.stage import stored
from barflow.sources.ticks import ticks_from_events

CTES: dict[str, str] = {}
QUERIES: dict[str, "Query"] = {}


class Inputs:
    """Tables of one scale-factor directory, plus the tick and bar views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._bars: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        return ticks_from_events(self.table("events"))

    def bars(self, config: str = "time_60m") -> DataFrame:
        if config not in self._bars:
            self._bars[config] = bar_ops.build_bars(self.ticks, config)
        return self._bars[config]

    def stored_bars(self, config: str = "time_60m") -> DataFrame:
        """Bars written to the stage folder, for plans that read them several times."""
        key = "stored:" + config
        if key not in self._bars:
            self._bars[key] = stored(self.bars(config), "bars")
        return self._bars[key]


@dataclass(frozen=True)
class Query:
    spec: list[tuple[str, str]]
    build: Callable[[Inputs], DataFrame]
    sql: str | None


def _spark_col(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "d":
        d = c.cast("double")
        return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(F.round(d, 6) + F.lit(0.0)).alias(name)
    if kind == "t":
        return F.unix_micros(c.cast("timestamp")).alias(name)
    return c.cast("bigint" if kind == "i" else "string").alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind == "d":
        d = f'CAST("{name}" AS DOUBLE)'
        return f'CASE WHEN isfinite({d}) THEN round({d}, 6) + 0.0 END AS "{name}"'
    if kind == "t":
        return f'epoch_us("{name}") AS "{name}"'
    return f'CAST("{name}" AS {"BIGINT" if kind == "i" else "VARCHAR"}) AS "{name}"'


def with_ctes(sql: str, own: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it mentions, directly or through other CTEs: the shared ones, or its ``own`` in their place."""
    ctes = CTES | (own or {})
    need: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[A-Za-z_]\w*", todo.pop()))
        for n in words & ctes.keys() - need:
            need.add(n)
            todo.append(ctes[n])
    parts = [f"{n} AS ({ctes[n]})" for n in ctes if n in need]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql


def add(name: str, spec: str, build: Callable[[Inputs], DataFrame], sql: str | None = None, ctes: dict[str, str] | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    cols = [tuple(item.rsplit(":", 1)) for item in spec.split()]
    text = None
    if sql is not None:
        text = with_ctes(f"SELECT {', '.join(_sql_col(n, k) for n, k in cols)} FROM ({sql}) AS result_rows", ctes)
    QUERIES[name] = Query(cols, build, text)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    q = QUERIES[name]
    return q.build(Inputs(spark, sf_dir)).select(*[_spark_col(n, k) for n, k in q.spec])
