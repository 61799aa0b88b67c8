"""Evaluate independent feature modules side by side.

A module is a chain of ``withColumns`` steps.  Running modules one after another gives Spark a long
stack of Window operators over the same sort order, each copying every row.  ``together`` lines up
the n-th steps of all modules and adds them in one projection, so there are as many Window operators
as the deepest module has steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame


class _Steps:
    """Stands in for a DataFrame while a module describes its columns."""

    def __init__(self, columns: list[str], steps: list[dict[str, Column]], dropped: list[str]) -> None:
        self.columns, self._steps, self._dropped, self._depth = list(columns), steps, dropped, 0

    def withColumns(self, cols: dict[str, Column]) -> "_Steps":
        if self._depth == len(self._steps):
            self._steps.append({})
        self._steps[self._depth].update(cols)
        self._depth += 1
        self.columns += [c for c in cols if c not in self.columns]
        return self

    def withColumn(self, name: str, col: Column) -> "_Steps":
        return self.withColumns({name: col})

    def drop(self, *names: str) -> "_Steps":
        self._dropped.extend(names)
        return self


def together(df: DataFrame, *modules: Callable) -> DataFrame:
    """Columns of all ``modules``; none may read another one's output, and scratch names must differ."""
    steps: list[dict[str, Column]] = []
    dropped: list[str] = []
    for module in modules:
        module(_Steps(df.columns, steps, dropped))
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*dropped)
