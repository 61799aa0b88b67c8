"""Features that combine modules: regime, interactions, previous session, accumulation, auction, squeeze."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import BAR_ORDER, CONTEXT_KEYS, context_window, prior_n, rolling, rolling_corr, rolling_median, session_window, zscore
from ..params import resolve

# Columns the context-scope features read; everything else need not be copied to warm-up rows.
CONTEXT_INPUTS = [
    "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "trade_count", "bar_duration_ns",
    "bid_price", "ask_price", "bid_size", "ask_size", "range_ma5", "high_low_range", "order_flow_imbalance",
    "volume_imbalance", "rolling_va_position", "whale_buy_volume_30", "whale_sell_volume_30", "absorption_signal",
    "recoil_50pct", "cvd_accel_3", "poc_price", "va_high", "va_low",
]


def regime_autocorr(df: DataFrame, params: dict | None = None) -> DataFrame:
    p, w = resolve(params), session_window()
    df = df.withColumn("_lag_ret", F.lag("return_1bar").over(w))
    return df.withColumn("regime_autocorr", rolling_corr(
        F.col("return_1bar"), F.col("_lag_ret"), w, int(p["autocorr_window"]), int(p["autocorr_min"]))).drop("_lag_ret")


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "ix_ofi_x_vol": F.expr("order_flow_imbalance * range_ma5"),
        "ix_ofi_x_spread": F.expr("order_flow_imbalance * spread_bps"),
        "ix_bbo_imb_x_vdelta": F.expr("book_imbalance * volume_delta"),
    })


def previous_session(df: DataFrame) -> DataFrame:
    """Levels of the last session before the target day.

    The context group of a target day already holds the sessions before it, so yesterday's levels are
    whole-group aggregates: no session table and no join back.
    """
    group = Window.partitionBy(*CONTEXT_KEYS)
    has_profile = {"poc_price", "va_high", "va_low"} <= set(df.columns)
    df = df.withColumn("_prev", F.max(F.when(F.col("session_date") < F.col("target_date"), F.col("session_date"))).over(group))
    before, today = F.col("session_date") == F.col("_prev"), F.col("session_date") == F.col("target_date")
    last = ["close"] + (["poc_price", "va_high", "va_low"] if has_profile else [])
    df = df.withColumns({
        "prev_day_high": F.max(F.when(before, F.col("high"))).over(group),
        "prev_day_low": F.min(F.when(before, F.col("low"))).over(group),
        "_last": F.max(F.when(before, F.struct(*BAR_ORDER, *last))).over(group),
        "_first": F.min(F.when(today, F.struct(*BAR_ORDER, "open"))).over(group),
    })
    out = df.withColumn("prev_day_close", F.col("_last.close")).withColumn(
        "gap_open", F.expr("if(abs(prev_day_close) > 1e-9, (_first.open - prev_day_close) / prev_day_close, null)"))
    if has_profile:
        out = out.withColumns({"prev_day_poc": F.col("_last.poc_price"), "prev_day_vah": F.col("_last.va_high"),
                               "prev_day_val": F.col("_last.va_low")})
    out = out.drop("_prev", "_last", "_first")
    atr = "if(abs(range_ma5) > 1e-9, range_ma5, 1e-9D)"
    out = out.withColumns({"dist_prev_high": F.expr(f"(close - prev_day_high) / {atr}"),
                           "dist_prev_low": F.expr(f"(close - prev_day_low) / {atr}")})
    if not has_profile:
        return out
    atr = "if(close * range_ma5 > 1e-9, close * range_ma5, 1D)"
    width = "if(abs(prev_day_vah - prev_day_val) > 1e-9, prev_day_vah - prev_day_val, 1e-9D)"
    return out.withColumns({
        "dist_prev_poc": F.expr(f"(close - prev_day_poc) / {atr}"),
        "dist_prev_vah": F.expr(f"(close - prev_day_vah) / {atr}"),
        "dist_prev_val": F.expr(f"(close - prev_day_val) / {atr}"),
        "prev_day_va_position": F.expr(f"(close - prev_day_val) / {width}"),
    })


def regime_volatility(df: DataFrame, params: dict | None = None) -> DataFrame:
    median = rolling_median(F.col("range_ma5"), context_window(), int(resolve(params)["regime_vol_window"]))
    return df.withColumn("_rmed", median).withColumn(
        "regime_vol_relative", F.expr("if(_rmed <> 0, range_ma5 / _rmed, null)")).drop("_rmed")


def _recent_absorption():
    w, x = context_window(), F.col("absorption_signal")
    return F.greatest(x, F.coalesce(F.lag(x, 1).over(w), F.lit(0.0)), F.coalesce(F.lag(x, 2).over(w), F.lit(0.0)))


def accumulation(df: DataFrame, params: dict | None = None) -> DataFrame:
    p, w = resolve(params), context_window()
    r, n, m = F.col("high_low_range"), int(p["range_window"]), int(p["range_z_window"])
    df = df.withColumns({"_mean": rolling(F.avg, r, w, n), "_std": rolling(F.stddev_samp, r, w, n),
                         "_med": rolling_median(r, w, int(p["accum_window"]))})
    df = df.withColumns({
        "range_compression": F.expr("_std / if(abs(_mean) > 1e-9, _mean, 1e-9D)"),
        "volatility_compression_1bar": F.expr("high_low_range / if(_mean = 0, 1e-9D, _mean)"),
    })
    c = F.col("range_compression")
    std = rolling(F.stddev_samp, c, w, m, 2)
    recent = _recent_absorption() if "absorption_signal" in df.columns else F.lit(0.0)
    stall = F.lit(False)
    if "recoil_50pct" in df.columns:
        stall = (F.col("recoil_50pct") == 1.0) & (F.col("volatility_compression_1bar") < float(p["stall_compression"]))
    return df.withColumns({
        "range_compression_z": (c - rolling(F.avg, c, w, m, 2)) / F.when(std > 1e-9, std).otherwise(1e-9),
        "post_absorption_contraction": F.when((recent > 0) & (r < F.col("_med")), 1.0).otherwise(0.0),
        "post_recoil_stall": F.when(stall, 1.0).otherwise(0.0),
    }).drop("_mean", "_std", "_med")


def flow_context(df: DataFrame) -> DataFrame:
    """Order-flow impulse, whale alignment and auction scores; absent inputs take neutral values."""
    w = context_window()

    def given(name: str, neutral: float):
        return F.col(name).cast("double") if name in df.columns else F.lit(neutral)

    df = df.withColumns({
        "_ofi": given("order_flow_imbalance", 0.0), "_imb": given("volume_imbalance", 0.0),
        "_pos": given("rolling_va_position", 0.5),
        "_wd": given("whale_buy_volume_30", 0.0) - given("whale_sell_volume_30", 0.0),
        "_wt": given("whale_buy_volume_30", 0.0) + given("whale_sell_volume_30", 0.0), "_vol": given("volume", 0.0),
    })
    df = df.withColumns({
        "_oma": rolling(F.avg, F.abs("_ofi"), w, 50), "_wma": rolling(F.avg, F.abs("_wd"), w, 50),
        "ofi_impulse_z": zscore(F.col("_ofi"), w, 50, 2, eps=1e-9),
        "value_acceptance_rate_8": rolling(F.avg, F.col("_pos").between(0.0, 1.0).cast("double"), w, 8),
        "_hi12": F.max("high").over(prior_n(w, 12)),
        "_lo12": F.min("low").over(prior_n(w, 12)),
        "_n12": F.count("high").over(prior_n(w, 12)),
        "whale_imbalance_ratio_30": F.expr("_wd / (_wt + 1D)"),
        "whale_participation_rate_30": F.expr("_wt / (_vol + 1D)"),
    })
    df = df.withColumns({
        "_on": F.expr("if(_oma > 1e-9, tanh(_ofi / _oma), 0D)"), "_wn": F.expr("if(_wma > 1e-9, tanh(_wd / _wma), 0D)"),
        "_rng": F.expr("greatest(high - low, 1e-9D)"),
    }).withColumns({
        "_combo": F.expr("0.5D * _imb + 0.5D * _on"),
        "_lw": F.expr("greatest(least((least(open, close) - low) / _rng, 1D), 0D)"),
        "_uw": F.expr("greatest(least((high - greatest(open, close)) / _rng, 1D), 0D)"),
        "_nv": F.expr("greatest(least((0.2D - _pos) / 0.2D, 1D), 0D)"),
        "_nh": F.expr("greatest(least((_pos - 0.8D) / 0.2D, 1D), 0D)"),
    }).withColumns({"_pf": F.expr("greatest(_combo, 0D)"), "_nf": F.expr("greatest(-_combo, 0D)")})
    df = df.withColumns({
        "whale_ofi_alignment": F.expr("_wn * _on"),
        "va_rejection_score": F.expr("_nv * _lw * _pf - _nh * _uw * _nf"),
        "price_discovery_score": F.expr("(greatest(_pos - 1D, 0D) - greatest(-_pos, 0D)) * _combo"),
        "structure_break_score": F.expr("if(_n12 = 12 and close > _hi12, _pf, 0D) - if(_n12 = 12 and close < _lo12, _nf, 0D)"),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def failed_auction(df: DataFrame) -> DataFrame:
    """Probe beyond yesterday's value edge that closes back inside, confirmed by absorption or whales."""
    def confirmed(whale: str) -> str:
        parts = [f"{c} > 0" for c in ("absorption_signal", whale) if c in df.columns]
        return "(" + (" or ".join(parts) or "false") + ")"

    known = "prev_day_val is not null and prev_day_vah is not null"
    return df.withColumns({
        "failed_auction_bull": F.expr(f"if({known} and low < prev_day_val and close > prev_day_val and "
                                      f"{confirmed('whale_buy_volume_30')}, 1D, 0D)"),
        "failed_auction_bear": F.expr(f"if({known} and high > prev_day_vah and close < prev_day_vah and "
                                      f"{confirmed('whale_sell_volume_30')}, 1D, 0D)"),
    }).withColumn("failed_auction_score", F.expr("failed_auction_bull - failed_auction_bear"))


def squeeze(df: DataFrame) -> DataFrame:
    w = context_window()
    recent = _recent_absorption() > 0 if "absorption_signal" in df.columns else F.lit(False)
    wide = F.col("high_low_range") > 2.0 * rolling_median(F.col("high_low_range"), w, 6)
    accel = F.coalesce("cvd_accel_3", F.lit(0.0)) if "cvd_accel_3" in df.columns else None
    up, down = (F.lit(True), F.lit(True)) if accel is None else (accel > 0, accel < 0)
    return df.withColumns({
        "squeeze_bull": F.when(recent & wide & (F.col("volume_imbalance") > 0.15) & up, 1.0).otherwise(0.0),
        "squeeze_bear": F.when(recent & wide & (F.col("volume_imbalance") < -0.15) & down, 1.0).otherwise(0.0),
    }).withColumn("squeeze_score", F.expr("squeeze_bull - squeeze_bear"))
