"""Tables of vectors: which rows take part, and dense matrices of their list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where a vector is neither null nor holds null or non-finite entries."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def dimension(vectors: DataFrame, vector: str) -> int:
    """The commonest length of the vectors, of equally common ones the longest; 0 where there is none."""
    found = vectors.groupBy(F.size(F.col(f"`{vector}`")).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0")
    first = found.orderBy(F.desc("n"), F.desc("d")).first()
    return first.d if first else 0


def quantised(vector: Column, scale: float, most: int) -> Column:
    """floor(scale * entry) of each entry as bigint, held within ``most`` in size."""
    bound = F.lit(float(most))
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, -bound), bound)).cast("bigint"))


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``d`` entries."""
    return np.asarray(lists.flatten()).reshape(-1, d)


def list_column(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows).reshape(-1)))
