"""Embedding whitening from a covariance over distinct vectors.

Identical quantised vectors x are grouped first (partial counts before the shuffle, so a vector that a third of the rows share
is one row a task).  Each distinct vector enters the fit with weight one, or with its number of rows.  The sums S of the
fit are exact integers; the covariance is a weighted product of centred rows (n x - S) / n, one partial matrix a task,
summed by matrix row.  Only the d x d matrix reaches the driver, whatever the number of rows.  Each distinct vector is
whitened once, and rows get the results of their vector by a join on its SHA-256 digest; a hot vector is a skewed join
that AQE can split.

Rows whose vector is null or holds null or non-finite entries are left out, as are vectors of another length than the
commonest one (of equally common ones the longest) and empty ones.  Quantised entries are held within 2 ** 40 in size.
Repeated rows and null ids get results of their own.  Components without variance (below 1e-12 of the largest eigenvalue)
cannot be whitened and have no rows, so one distinct vector or an empty table gives no rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import stored
from .vectors import dimension, finite, list_column, matrix, quantised

COMPONENTS = 16
LEAST = 1e-12
_ENTRY = 1 << 40


def _totals(fit: DataFrame, column: str, d: int, kind: str) -> tuple[int, list]:
    """(sum of weights, weighted sums of each dimension); one row a task is summed up by Spark."""
    def run(batches):
        n, total = 0, np.zeros(d, np.int64 if kind == "bigint" else np.float64)
        for b in batches:
            w = np.asarray(b.column(1))
            n, total = n + int(w.sum()), total + (w[:, None] * matrix(b.column(0), d)).sum(0)
        yield pa.record_batch([pa.array([n] * d), pa.array(np.arange(d)), pa.array(total)], ["n", "i", "s"])
    parts = fit.select(column, "weight").mapInArrow(run, f"n bigint, i bigint, s {kind}")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)") if kind == "bigint" else F.col("s")).alias("s")).collect()  # d rows
    rows.sort(key=lambda r: r.i)
    return (rows[0].n if rows else 0), [int(r.s) if kind == "bigint" else r.s for r in rows]


class Centre:
    """n x - S of integer rows x, exact: in 64 bits where they suffice, else in Python integers."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.middle = n, [round(s / n) for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.middle)]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        away = x - np.array(self.middle, np.int64)
        most = int(np.abs(away).max(initial=0)) * self.n + max(map(abs, self.rest))
        if most < 1 << 62:
            return away * self.n - np.array(self.rest, np.int64)
        return away.astype(object) * self.n - np.array(self.rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S) ** 2, exact."""
        dev = self.deviations(x)
        if dev.dtype != object and int(np.abs(dev).max(initial=0)) ** 2 * max(x.shape[1], 1) < 1 << 62:
            return pc.cast(pa.array((dev * dev).sum(1)), pa.decimal128(38, 0))
        return pa.array([Decimal(sum(int(v) ** 2 for v in r)) for r in dev], pa.decimal128(38, 0))


def _covariance(fit: DataFrame, column: str, d: int, n: int, centred) -> np.ndarray:
    """Weighted covariance (divisor n) of rows that ``centred`` has centred; one partial matrix a task, summed by matrix row."""
    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            rows = centred(matrix(b.column(0), d))
            total += rows.T @ (np.asarray(b.column(1), np.float64)[:, None] * rows)
        yield pa.record_batch([pa.array(np.arange(d)), list_column(total)], ["i", "cells"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"i": t.column("i")[:1], "cells": list_column(matrix(t.column("cells").combine_chunks(), d).sum(0, keepdims=True))})
    parts = fit.select(column, "weight").mapInArrow(run, "i bigint, cells array<double>")
    rows = parts.groupBy("i").applyInArrow(add, "i bigint, cells array<double>").collect()  # d rows of d cells
    out = np.zeros((d, d))
    for r in rows:
        out[r.i] = r.cells
    return (out + out.T) / (2 * n)


def whiten(table: DataFrame, vector: str = "embedding", id_col: str = "vec_id", scale: float = 64.0, offset: int = 1_000_000,
           counts: bool = False, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component.

    ``counts`` weighs a distinct vector by its number of rows; n and S are then those of the rows.
    """
    spark = table.sparkSession
    d0 = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("v")).where(finite(F.col("v")))
    schema = f"id {d0.schema['id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d = dimension(d0, "v")
    if not d:
        return empty
    rows = d0.where(F.size("v") == d).select("id", F.transform(quantised(F.col("v"), scale, _ENTRY), lambda c: c + offset).alias("x"))
    digest = F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)).alias("digest")
    distinct = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    fit = stored(distinct.select(digest, "x", (F.col("copies") if counts else F.lit(1).cast("bigint")).alias("weight")), "distinct_vectors")
    n, sums = _totals(fit, "x", d, "bigint")
    centre = Centre(n, sums)
    values, vectors = np.linalg.eigh(_covariance(fit, "x", d, n, centre.centred))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > max(values[0], 0) * LEAST).sum())
    if not k:
        return empty
    explained = (values[:k] / values.sum()).tolist()
    project = spark.sparkContext.broadcast(vectors[:, :k] / np.sqrt(values[:k]))  # d x k

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), d)
            yield pa.record_batch([b.column(0), b.column(2), centre.squares(x), list_column(centre.centred(x) @ project.value)],
                                  ["digest", "weight", "deviation", "white"])
    white = stored(fit.select("digest", "x", "weight").mapInArrow(run, "digest binary, weight bigint, deviation decimal(38,0), white array<double>"), "white_vectors")
    _, total = _totals(white, "white", k, "double")
    mean = np.array(total) / n
    error = float(np.abs(_covariance(white, "white", k, n, lambda y: y - mean) - np.eye(k)).max())
    share = F.array(*[F.lit(v) for v in explained])
    out = rows.select("id", digest).join(white.select("digest", "deviation", "white"), "digest")
    out = out.select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                      F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
