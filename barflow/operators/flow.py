"""Order flow, aggressor flow, toxicity and scalping features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import (bar_index, context_window, last_n, nearest_quantile, prior_n, rolling, rolling_corr,
                                 running, session_window, zscore)
from ..params import resolve


def orderflow(bars: DataFrame, params: dict | None = None) -> DataFrame:
    p, w = resolve(params), session_window()
    delta, close = F.col("volume_delta"), F.col("close")

    def diverging(n: int):
        move = close - F.lag("close", n).over(w)
        flow = rolling(F.sum, delta, w, n)
        return F.when(move.isNotNull() & (F.signum(flow) != F.signum(move)), 1.0).otherwise(0.0)

    span, frame = F.col("high") - F.col("low"), last_n(w, 12)
    absorbed = ((F.col("volume") > nearest_quantile(F.col("volume").cast("double"), frame, 0.9))
                & (span < nearest_quantile(span, frame, 0.2)))
    df = bars.withColumn("volume_delta", F.expr("buy_volume - sell_volume")).withColumns({
        "volume_imbalance": F.expr("volume_delta / cast(buy_volume + sell_volume + 1 as double)"),
        "trade_intensity": F.expr("trade_count / (bar_duration_ns / 1e9D + 1e-9D)"),
        "large_trade_ratio": F.expr("large_trade_count / cast(trade_count + 1 as double)"),
        "orderflow_ratio": F.expr("greatest(buy_volume, sell_volume) / cast(volume + 1 as double)"),
        "order_flow_imbalance": rolling(F.sum, delta, w, 5),
        "absorption_factor": F.expr(
            f"volume * abs(volume_delta) / (greatest(round((high - low) / {p['tick_size']}), 0D) + 1D)"),
        "cvd_price_divergence_3": diverging(3),
        "cvd_price_divergence_6": diverging(6),
        "absorption_signal": F.when(absorbed, 1.0).otherwise(0.0),
    })
    return df


def aggressor(bars: DataFrame, params: dict | None = None) -> DataFrame:
    p, w = resolve(params), session_window()
    tick, lag_n = float(p["tick_size"]), int(p["divergence_lag"])
    df = bars.withColumn("volume_delta", F.expr("buy_volume - sell_volume")).withColumn(
        "cvd", F.sum("volume_delta").over(running(w)))
    prev = F.lag("close").over(w)
    cvd = F.col("cvd").cast("double")
    df = df.withColumns({
        "_ret": (F.col("close") - prev) / (prev + tick),
        "_cvd_step": cvd - F.lag(cvd).over(w),
        "_idx": bar_index(w),
        "cvd_divergence_6": F.when((F.col("close") - F.lag("close", lag_n).over(w))
                                   * (cvd - F.lag(cvd, lag_n).over(w)) < 0, 1.0).otherwise(0.0),
        **{f"cvd_slope_{n}": (cvd - F.lag(cvd, n).over(w)) / float(n) for n in (3, 6, 12)},
    })
    n = int(p["alignment_window"])
    mean24 = rolling(F.avg, F.col("trade_count").cast("double"), w, 24)
    return df.withColumns({
        "cvd_accel_3": F.when(F.col("_idx") >= 6, F.col("cvd_slope_3") - F.lag("cvd_slope_3", 3).over(w)),
        "cvd_accel_6": F.when(F.col("_idx") >= 12, F.col("cvd_slope_6") - F.lag("cvd_slope_6", 6).over(w)),
        "cvd_price_alignment": F.when(F.col("_idx") >= n, rolling_corr(
            F.col("_ret"), F.col("_cvd_step"), w, n, int(p["alignment_min"]))),
        "buy_sell_ratio": F.expr("buy_volume / cast(buy_volume + sell_volume + 1 as double)"),
        "trade_intensity_aggressor": F.col("trade_count").cast("double"),
        "relative_intensity": F.when(mean24 > 1e-12, F.col("trade_count") / mean24).otherwise(0.0),
        "large_lot_fraction": F.expr("(large_buy_volume + large_sell_volume) / (buy_volume + sell_volume + 1D)"),
        "large_lot_imbalance": F.expr(
            "(large_buy_volume - large_sell_volume) / (large_buy_volume + large_sell_volume + 1D)"),
    }).drop("_ret", "_cvd_step", "_idx")


def toxicity(bars: DataFrame, window: int = 20, z_window: int = 100, risk_off: float = 0.7) -> DataFrame:
    """Session VPIN, its z-score (null until enough bars) and the risk-off flag."""
    w = session_window()
    imbalance = F.expr("abs(buy_volume - sell_volume) / (buy_volume + sell_volume + 1D)")
    need = max(2, min(z_window, max(10, z_window // 4)))
    return bars.withColumn("vpin_toxicity", rolling(F.avg, imbalance, w, window)).withColumns({
        "vpin_zscore": zscore(F.col("vpin_toxicity"), w, z_window, need, null_when_undefined=True),
        "vpin_risk_off": F.when(F.col("vpin_toxicity") > risk_off, 1).otherwise(0),
    })


def scalping(bars: DataFrame, params: dict | None = None) -> DataFrame:
    """Reversal, absorption and intensity signals over the context window (sessions are not separated)."""
    tick, w = float(resolve(params)["tick_size"]), context_window()
    delta, close, span = F.expr("buy_volume - sell_volume"), F.col("close"), F.expr("high - low")
    before = prior_n(w, 10)
    prior = prior_n(w, 24)
    absorbed = ((F.col("volume") > nearest_quantile(F.col("volume").cast("double"), prior, 0.9, 5))
                & (span < nearest_quantile(span, prior, 0.2, 5)))
    return bars.withColumns({
        "delta_divergence_bull": F.when((close < F.min(close).over(before))
                                        & (delta > F.min(delta).over(before)), 1.0).otherwise(0.0),
        "delta_divergence_bear": F.when((close > F.max(close).over(before))
                                        & (delta < F.max(delta).over(before)), 1.0).otherwise(0.0),
        "effort_vs_result": F.expr(f"volume / greatest(abs(high - low), {tick})"),
        "absorption_signal_scalp": F.when(absorbed, 1.0).otherwise(0.0),
        "intensity": F.expr("trade_count / greatest(bar_duration_ns / 1e9D, 1D)"),
    }).withColumn("intensity_z", zscore(F.col("intensity"), w, 20, 2, eps=1e-9)).withColumn(
        "tape_speed_spike_scalp", F.expr("if(intensity_z > 2.5, 1D, 0D)"))
