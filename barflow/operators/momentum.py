"""Momentum, candle geometry, forward-return labels and time of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import bar_index, eastern_minute, rolling, running, session_window
from ..params import resolve

LABEL_HORIZONS = (1, 3, 5, 6, 10, 12)
CLASS_HORIZONS = (1, 3, 5)


def momentum(bars: DataFrame) -> DataFrame:
    w = session_window()
    prev = F.lag("close").over(w)
    df = bars.withColumns({
        "return_1bar": F.when(bar_index(w) == 0, 0.0).when(F.abs(prev) > 1e-12, (F.col("close") - prev) / prev),
        "vwap_deviation": F.expr("(close - vwap) / (vwap + 0.0001)"),
        "high_low_range": F.expr("(high - low) / (close + 0.0001)"),
        "volume_ma5": rolling(F.avg, F.col("volume"), w, 5),
    })
    df = df.withColumns({
        "return_5bar": rolling(F.sum, F.col("return_1bar"), w, 5),
        "return_12bar": rolling(F.sum, F.col("return_1bar"), w, 12),
        "vwap_deviation_ma5": rolling(F.avg, F.col("vwap_deviation"), w, 5),
        "range_ma5": rolling(F.avg, F.col("high_low_range"), w, 5),
    })
    flat = "abs(high - low) < 0.0001"
    return df.withColumns({
        "volume_ratio": F.expr("volume / (volume_ma5 + 0.0001)"),
        "momentum_volume": F.expr("return_1bar * volume"),
        "close_position": F.expr(f"if({flat}, 0.5D, (close - low) / (high - low + 0.0001))"),
        "upper_wick_ratio": F.expr(f"if({flat}, 0D, (high - greatest(open, close)) / (high - low + 1e-9))"),
        "lower_wick_ratio": F.expr(f"if({flat}, 0D, (least(open, close) - low) / (high - low + 1e-9))"),
        "body_ratio": F.expr(f"if({flat}, 0D, abs(close - open) / (high - low + 1e-9))"),
    })


def labels(bars: DataFrame) -> DataFrame:
    """Forward returns inside the session and their binary classes; null near the session end."""
    w = session_window()
    base = F.expr("if(abs(close) > 1e-12, close, null)")
    df = bars.withColumns({
        f"fwd_return_{n}bar": (F.lead("close", n).over(w) - F.col("close")) / base for n in LABEL_HORIZONS})
    return df.withColumns({f"label_{n}bar": (F.col(f"fwd_return_{n}bar") > 0).cast("int") for n in CLASS_HORIZONS})


def time_of_day(df: DataFrame, params: dict | None = None) -> DataFrame:
    p = resolve(params)
    since = (eastern_minute(F.col("ts_event")) - int(p["rth_open_min"])).cast("double")
    return df.withColumn("minutes_since_open", since).withColumns({
        "session_progress": F.col("minutes_since_open") / float(p["rth_minutes"]),
        "is_power_hour": F.expr("if(minutes_since_open >= 0 and minutes_since_open < 90, 1D, 0D)"),
        "is_london_session": F.expr("if(minutes_since_open < 0, 1D, 0D)"),
    })


def opening_range(bars: DataFrame, params: dict | None = None) -> DataFrame:
    """High and low of the first regular-session minutes, visible only once that period is over."""
    p = resolve(params)
    n = int(p["or_minutes"])
    w = session_window()
    since = eastern_minute(F.col("ts_event")) - int(p["rth_open_min"])
    forming = since.between(0, n - 1)
    # Bars after the period see all of it, so a running extreme equals the finished range.
    seen = running(w)
    df = bars.withColumns({
        "or_high": F.when(since >= n, F.max(F.when(forming, F.col("high"))).over(seen)),
        "or_low": F.when(since >= n, F.min(F.when(forming, F.col("low"))).over(seen)),
        "_ready": since >= n,
    })
    mid = "(or_high + or_low) / 2"
    return df.withColumns({
        "or_width": F.expr(f"if(abs({mid}) > 1e-9, (or_high - or_low) / abs({mid}), null)"),
        "position_in_or": F.expr("""case when or_high is null then null when abs(or_high - or_low) <= 1e-9 then 0.5D
                                    else (close - or_low) / (or_high - or_low) end"""),
        "or_broken_up": F.expr("case when not _ready then null when close > or_high then 1D else 0D end"),
        "or_broken_down": F.expr("case when not _ready then null when close < or_low then 1D else 0D end"),
    }).drop("_ready", "or_high", "or_low")
