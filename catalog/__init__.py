"""Named queries and their SQL counterparts, grouped by subject."""

from . import bar_queries, feature_queries, matrix_queries, assembled_queries, trade_queries, validation_queries, edge_queries, condition_queries, log_queries  # noqa: F401
from .base import QUERIES, run

__all__ = ["QUERIES", "run"]
