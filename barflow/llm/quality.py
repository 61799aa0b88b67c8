"""Quality scores by regularised quadratic discriminant analysis.

Each class has a mean vector and a covariance of transformed document statistics (``textstats``), from grouped sums over
the training rows.  Covariances are shrunk towards the pooled covariance (weight ``pooled``) and its mean variance
(``ridge``), and their Cholesky factors are kept in the model.  A score is the logistic of the difference of the two
Mahalanobis log densities plus the log prior odds, divided by ``temper``.

Training uses at most ``SAMPLE`` labelled rows (see ``labelled``); held-out documents, lang, source and ids give no input.
Null and empty texts are scored from the statistics of an empty text.  Without rows of both classes every score is the
share of label 1 (0.5 without any rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE, held_out, training_rows
from .textbytes import fresh_names, slices
from .textstats import QUALITY_FEATURES, quality_matrix

THRESHOLD = 0.5


def with_features(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without the text and with ``_x``, the array of statistics."""
    where = rows.columns.index(text)
    keep = [c for c in rows.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text] + ["_x array<double>"])

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(where)):
                x = quality_matrix(data, offsets)
                first = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                cols = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns) if i != where]
                yield pa.record_batch([*cols, pa.ListArray.from_arrays(pa.array(first), pa.array(x.ravel()))], [*keep, "_x"])
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, and log density constant with log prior."""

    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray
    temper: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            density.append(self.constant[k] - 0.5 * (z ** 2).sum(axis=1))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temper, -35, 35)))


def moments(features: DataFrame, width: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per label: rows, sums and sums of products, from one grouped aggregation."""
    x = [F.col("_x")[i] for i in range(width)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(width) for j in range(i + 1)]
    out = {}
    for r in features.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():  # one row a class
        p = np.zeros((width, width))
        for i in range(width):
            for j in range(i + 1):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r.label] = (r.n, np.array([r[f"s{i}"] for i in range(width)]), p)
    return out


def fit(rows: DataFrame, pooled: float = 0.1, ridge: float = 0.02, temper: float = 4.0) -> Discriminant | float:
    """The model of (text, label) rows, or the share of label 1 where a class has fewer than two rows."""
    width = len(QUALITY_FEATURES)
    m = moments(with_features(rows.select("text", "label")), width)
    total = sum(n for n, _, _ in m.values())
    if any(k not in m or m[k][0] < 2 for k in (0, 1)):
        return (m[1][0] if 1 in m else 0) / total if total else 0.5
    mean = np.stack([m[k][1] / m[k][0] for k in (0, 1)])
    own = [m[k][2] / m[k][0] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    both = sum(m[k][0] * own[k] for k in (0, 1)) / total
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    factor, constant = [], []
    for k in (0, 1):
        shrunk = (1 - pooled) * own[k] + pooled * both + ridge * np.diag(scale ** 2)
        low = np.linalg.cholesky(shrunk)
        factor.append(np.linalg.inv(low))
        constant.append(np.log(m[k][0] / total) - np.log(np.diag(low)).sum())
    return Discriminant(mean, np.stack(factor), np.array(constant), temper)


def scored(docs: DataFrame, model: Discriminant | float, text: str = "text") -> DataFrame:
    """``docs`` plus ``_score`` as the last column (with more underscores where ``docs`` has that name)."""
    where, name = docs.columns.index(text), fresh_names(docs.columns, "_score")[0]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` double"])

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(where)):
                s = np.full(hi - lo, model) if isinstance(model, float) else model.score(quality_matrix(data, offsets))
                yield pa.record_batch([*b.slice(lo, hi - lo).columns, pa.array(s.astype(np.float64))], [*b.schema.names, name])
    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, bound: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = fit(training_rows(docs, labels, "quality", text, id_col, bound))
    d = scored(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), model, text)
    return d.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col("_score").alias("score"),
                    (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, bound: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    model = fit(training_rows(docs, labels, "quality", text, id_col, bound))
    d = scored(docs, model, text)
    return d.where(F.col(d.columns[-1]) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
