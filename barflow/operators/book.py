"""Book, message-level microstructure and footprint features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import (bar_index, context_window, last_n, nearest_quantile, rolling, running, session_window,
                                 zscore)
from ..params import resolve


def book(bars: DataFrame) -> DataFrame:
    w = session_window()
    df = bars.withColumns({
        "mid_price": F.expr("(bid_price + ask_price) / 2D"),
        "spread": F.expr("ask_price - bid_price"),
        "book_imbalance": F.expr("(bid_size - ask_size) / cast(bid_size + ask_size + 1 as double)"),
        "depth_ratio": F.expr("bid_count / (ask_count + 1D)"),
    })
    prev = F.lag("mid_price").over(w)
    df = df.withColumns({
        "spread_bps": F.expr("if(abs(mid_price) > 1e-12, spread / mid_price * 10000D, null)"),
        "book_imbalance_ma5": rolling(F.avg, F.col("book_imbalance"), w, 5),
        "spread_volatility": F.coalesce(rolling(F.stddev_samp, F.col("spread"), w, 5), F.lit(0.0)),
        "mid_price_return": F.when(bar_index(w) == 0, 0.0).when(prev > 0, (F.col("mid_price") - prev) / prev),
    })
    return df.withColumn("mid_price_return_5", rolling(F.sum, F.col("mid_price_return"), w, 5))


def microstructure(bars: DataFrame, params: dict | None = None) -> DataFrame:
    p, w = resolve(params), session_window()
    prev_cancel = F.lag("cancel_count").over(w)
    df = bars.withColumns({
        "cancel_trade_ratio": F.expr("cancel_count / (trade_count + 1)"),
        "modify_trade_ratio": F.expr("modify_count / (trade_count + 1)"),
        "mean_trade_interval_us": F.expr("if(trade_count > 1, bar_duration_ns / (trade_count - 1) / 1000D, null)"),
        "message_intensity_ma5": rolling(F.avg, F.col("msg_count"), w, 5),
        "cancel_rate_change": F.when(prev_cancel > 0, (F.col("cancel_count") - prev_cancel) / prev_cancel),
        "tape_speed": F.expr("trade_count / (bar_duration_ns / 1e6D + 1e-9D)"),
        "price_velocity": F.expr("abs(close - open) / (bar_duration_ns / 1e9D + 1e-9D)"),
    })
    df = df.withColumns({"tape_speed_z": zscore(F.col("tape_speed"), w, 24),
                         "price_velocity_z": zscore(F.col("price_velocity"), w, 24)})
    df = df.withColumns({"tape_speed_spike": F.expr(f"if(tape_speed_z > {p['tape_spike_z']}, 1D, 0D)"),
                         "is_whip": F.expr(f"if(price_velocity_z > {p['whip_z']}, 1D, 0D)")})
    after_whip = F.lag("is_whip").over(w) == 1.0
    body = F.abs(F.lag(F.col("close") - F.col("open")).over(w))
    recoil = F.abs(F.lag("close").over(w) - F.col("close")) / (body + 1e-9)
    return df.withColumn("recoil_pct", F.when(after_whip, recoil).otherwise(0.0)).withColumn(
        "recoil_50pct", F.expr(f"if(recoil_pct > {p['recoil_low']} and recoil_pct < {p['recoil_high']}, 1D, 0D)"))


def arrival(bars: DataFrame) -> DataFrame:
    """Bar-local arrival and queue imbalance measures."""
    return bars.withColumns({
        "trade_arrival_imbalance": F.expr("if(buy_volume + sell_volume > 0, "
                                          "(buy_volume - sell_volume) / cast(buy_volume + sell_volume as double), null)"),
        "cancel_ratio": F.expr("cancel_count / cast(trade_count + 1 as double)"),
        "weighted_book_imbalance": F.expr("(cast(bid_size as double) * bid_count - cast(ask_size as double) * ask_count)"
                                          " / (cast(bid_size as double) * bid_count + ask_size * ask_count + 1D)"),
    })


def arrival_context(bars: DataFrame) -> DataFrame:
    """Rolling VPIN and micro-price momentum; both run across sessions inside the context window."""
    w = context_window()
    df = bars.withColumn("_micro", F.expr("(bid_price * ask_size + ask_price * bid_size) / (bid_size + ask_size + 1e-9D)"))
    prev = F.lag("_micro").over(w)
    imbalance = F.expr("if(buy_volume + sell_volume > 0, "
                       "abs(buy_volume - sell_volume) / cast(buy_volume + sell_volume as double), null)")
    return df.withColumns({
        "vpin": rolling(F.avg, imbalance, w, 20),
        "micro_price_momentum": (F.col("_micro") - prev) / (prev + 1e-9),
    }).drop("_micro")


def footprint(bars: DataFrame, params: dict | None = None) -> DataFrame:
    p, w = resolve(params), session_window()
    df = bars.withColumns({
        "stacked_imb_strength": F.expr("cast(stacked_imbalance_count * stacked_imbalance_direction as double)"),
        "_idx": bar_index(w),
    }).withColumn("_sign", F.signum("stacked_imb_strength"))
    turned = F.when(F.col("_sign") != F.coalesce(F.lag("_sign").over(w), F.lit(0.0)), F.col("_idx"))
    df = df.withColumn("_run_start", F.coalesce(F.last(turned, ignorenulls=True).over(running(w)), F.lit(0)))

    def since(flag: str):
        return (F.col("_idx") - F.last(F.when(F.col(flag) == 1, F.col("_idx")), ignorenulls=True).over(running(w))).cast(
            "double")

    zero = F.col("zero_print_count").cast("double")
    aggression = float(p["extreme_aggression"])
    df = df.withColumns({
        "stacked_imb_ma3": rolling(F.avg, F.col("stacked_imb_strength"), w, 3),
        "stacked_imb_streak": F.expr("if(_sign <> 0, cast(_idx - _run_start + 1 as double), 0D)"),
        "zero_print_expansion": F.when(
            zero > nearest_quantile(zero, last_n(w, int(p["zero_print_window"])), 0.75), 1.0).otherwise(0.0),
        "zero_print_direction": F.expr("if(zero_print_count > 0, signum(close - open), 0D)"),
        "bars_since_unfinished_high": since("unfinished_high"),
        "bars_since_unfinished_low": since("unfinished_low"),
        "fp_zero_print_ratio": F.col("zero_print_ratio"),
        "fp_unfinished_high": F.col("unfinished_high").cast("double"),
        "fp_unfinished_low": F.col("unfinished_low").cast("double"),
        "delta_per_second": F.expr("(buy_volume - sell_volume) / (bar_duration_ns / 1e9D + 1e-9D)"),
        "max_level_vol_ratio": F.expr("max_level_volume / (volume + 1D)"),
        "high_low_vol_ratio": F.expr("(volume_at_high + volume_at_low) / (volume + 1D)"),
        "extreme_buy_ratio_high": F.expr("buy_vol_at_high / (buy_vol_at_high + sell_vol_at_high + 1D)"),
        "extreme_buy_ratio_low": F.expr("buy_vol_at_low / (buy_vol_at_low + sell_vol_at_low + 1D)"),
        "extreme_aggression_high": F.expr(f"if(sell_vol_at_high > buy_vol_at_high * {aggression}D, 1D, 0D)"),
        "extreme_aggression_low": F.expr(f"if(buy_vol_at_low > sell_vol_at_low * {aggression}D, 1D, 0D)"),
    })
    return df.withColumn("delta_intensity_z", zscore(F.col("delta_per_second"), w, int(p["delta_z_window"]))).withColumn(
        "delta_heat", F.abs("delta_intensity_z")).drop("_idx", "_sign", "_run_start")
