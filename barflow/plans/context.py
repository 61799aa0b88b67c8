"""Warm-up context: each bar serves its own day and the few following trading days of its symbol.

Cross-session features start from a fixed number of earlier days.  Copying each bar to the days it
serves turns one endless per-symbol window into independent (symbol, target day) groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import resolve


def day_calendar(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, session_date) -> the days it serves: itself and the next ``n`` days that have bars."""
    days = bars.select("symbol", "session_date").distinct()
    ahead = Window.partitionBy("symbol").orderBy("session_date").rowsBetween(0, n)
    return days.withColumn("serves", F.collect_list("session_date").over(ahead))


def with_context(bars: DataFrame, narrow: list[str] | None = None, params: dict | None = None,
                 days_of: DataFrame | None = None) -> DataFrame:
    """Explode bars to the target days they serve, as ``target_date``.

    ``narrow`` lists the columns the context operators read; all other columns travel only with the
    bar's own day, packed in one nullable struct, so warm-up copies stay small.  ``days_of`` is the
    table the calendar is read from when ``bars`` is already a long plan over it.
    """
    n = int(resolve(params)["context_days"])
    out = bars.join(day_calendar(bars if days_of is None else days_of, n), ["symbol", "session_date"]).withColumn("target_date", F.explode("serves")).drop(
        "serves")
    keys = ["symbol", "session_date", "target_date", "ts_event", "seq"]
    if narrow is None:
        return out
    narrow = [c for c in dict.fromkeys(narrow) if c in bars.columns and c not in keys]
    wide = [c for c in bars.columns if c not in narrow and c not in keys]
    if not wide:
        return out
    own = F.when(F.col("session_date") == F.col("target_date"), F.struct(*wide))
    return out.select(*keys, *narrow, own.alias("carried"))


def trim_context(df: DataFrame) -> DataFrame:
    """Keep target-day rows only and unpack carried columns."""
    out = df.filter(F.col("session_date") == F.col("target_date")).drop("target_date")
    if "carried" not in out.columns:
        return out
    return out.select(*[c for c in out.columns if c != "carried"], "carried.*")
