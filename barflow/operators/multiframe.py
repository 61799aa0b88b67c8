"""Roll-up of fine-grained features into larger windows, and the fallback choice of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .bars import size_seconds

# The one-minute features rolled up by default.
FIXED_FEATURES = [
    "cancel_count", "buy_volume", "volume", "trade_count", "message_count", "sell_volume", "add_count", "volume_ma5",
    "message_intensity_ma5", "modify_count", "cvd", "order_flow_imbalance", "volume_delta", "mean_trade_interval_us",
    "latency_mean", "vwap_deviation", "weighted_book_imbalance", "trade_count_micro", "trade_intensity",
    "buy_sell_ratio",
]
# The aggregations of the roll-up.
DEFAULT_OPS = ["mean", "std", "last", "delta", "min", "max"]

# Columns the fallback never takes - times, raw prices and labels (``seq`` is ours).
NEVER = ["seq", "ts_event", "ts_close", "bar_duration_ns", "open", "high", "low", "close", "vwap", "bid_price", "ask_price", "mid_price", "poc_price", "va_high",
         "va_low", "rolling_poc", "rolling_va_high", "rolling_va_low", "fwd_return_1bar", "fwd_return_3bar", "fwd_return_5bar", "fwd_return_6bar",
         "fwd_return_10bar", "fwd_return_12bar", "label_1bar", "label_3bar", "label_5bar"]


def chosen_features(features: DataFrame, names: list[str] | None = None, top_n: int = 20) -> list[str]:
    """The wanted (by default the fixed) features that are there; if none is, the ``top_n`` numeric columns of largest variance."""
    there = [c for c in (names or FIXED_FEATURES) if c in features.columns]
    if there:
        return there
    numeric = [f.name for f in features.schema.fields if isinstance(f.dataType, NumericType) and f.name not in NEVER]
    return [r.column_name for r in most_variable(features, numeric, top_n).orderBy("rank").collect()] if numeric else []  # top_n names


def roll_up(features: DataFrame, size: str, names: list[str] | None = None, ops: list[str] | None = None, top_n: int = 20) -> DataFrame:
    """Aggregate bar features into ``size`` windows; columns are named ``m1f_<feature>__<op>``."""
    width = size_seconds(size)
    names = chosen_features(features, names, top_n)
    ops = ops or DEFAULT_OPS
    when, aggs = F.struct("ts_event", "seq"), []
    for c in names:
        x = F.col(c)
        first, last = F.min_by(x, when), F.max_by(x, when)
        n = F.count(F.lit(1))
        known = {"mean": F.avg(x), "std": F.stddev_samp(x), "last": last, "delta": last - first, "min": F.min(x), "max": F.max(x),
                 "slope": F.when(n > 1, (last - first) / F.nullif(n - 1, F.lit(0)).cast("double")).otherwise(0.0)}
        aggs += [known[o].alias(f"m1f_{c}__{o}") for o in ops]
    return features.groupBy("symbol", F.window("ts_event", f"{width} seconds").alias("_w")).agg(*aggs).select(
        "symbol", F.col("_w.start").alias("ts_event"), *[f"m1f_{c}__{o}" for c in names for o in ops])


def most_variable(df: DataFrame, names: list[str], top_n: int) -> DataFrame:
    """The ``top_n`` columns by sample variance; undefined variance ranks last, ties go by name."""
    from pyspark.sql import Window
    var = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in names])
    long = var.unpivot([], names, "column_name", "variance")
    long = long.withColumn("variance", F.when(~F.isnan("variance") & (F.abs("variance") != float("inf")), F.col("variance")))
    w = Window.orderBy(F.col("variance").desc_nulls_last(), "column_name")
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, min(top_n, len(names))))
