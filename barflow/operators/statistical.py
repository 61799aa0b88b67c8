"""Volatility, VWAP deviation, fractional differencing and technical indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import (BAR_ORDER, CONTEXT_KEYS, bar_index, context_window, last_n, rolling, running,
                                 session_window, with_ewm, zscore)


def statistical(bars: DataFrame, window: int = 20) -> DataFrame:
    w = session_window()

    def ln(c: str):
        return F.when(F.col(c) > 0, F.log(F.col(c)))

    df = bars.withColumns({"_lo": ln("open"), "_lh": ln("high"), "_ll": ln("low"), "_lc": ln("close")})
    prev = F.lag("_lc").over(w)
    df = df.withColumns({
        "log_return": F.when(bar_index(w) == 0, 0.0).otherwise(F.col("_lc") - prev),
        "_gap": F.col("_lo") - prev,
        "_cc": F.col("_lc") - prev,
        "_rs": F.expr("(_lh - _lo) * (_lh - _lc) + (_ll - _lo) * (_ll - _lc)"),
        "_svwap": (F.sum(F.expr("vwap * volume")).over(running(w)) / F.sum("volume").over(running(w))),
    })
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    var = (rolling(F.var_samp, F.col("_gap"), w, window, window)
           + k * rolling(F.var_samp, F.col("_cc"), w, window, window)
           + (1 - k) * rolling(F.avg, F.col("_rs"), w, window, window))
    df = df.withColumns({"yz_volatility": F.when(var > 0, F.sqrt(var)).otherwise(0.0),
                         "vwap_deviation_stat": F.col("close") - F.col("_svwap")})
    return df.withColumns({
        "vol_zscore": zscore(F.col("yz_volatility"), w, 50, 2, eps=1e-12),
        "vwap_dev_zscore": zscore(F.col("vwap_deviation_stat"), w, 24, 2, eps=1e-12),
    }).drop("_lo", "_lh", "_ll", "_lc", "_gap", "_cc", "_rs", "_svwap")


def fracdiff_weights(d: float, taps: int) -> list[float]:
    out = [1.0]
    for k in range(1, taps):
        out.append(out[-1] * (k - 1 - d) / k)
    return out


def fracdiff(bars: DataFrame, d: float = 0.4, taps: int = 50) -> DataFrame:
    """Fixed-width fractional difference of the close; null until every tap has a positive price."""
    w = context_window()
    price = F.when(F.col("close") > 0, F.col("close"))
    weights = F.array(*[F.lit(x) for x in reversed(fracdiff_weights(d, taps))])
    past = F.collect_list(price).over(last_n(w, taps))
    dot = F.aggregate(F.zip_with(past, weights, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return bars.withColumn("fracdiff_close", F.when(F.size(past) == taps, dot))


def obv_slope(bars: DataFrame, n: int = 14) -> DataFrame:
    w = session_window()
    df = bars.withColumn("_sv", F.coalesce(
        F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume"), F.lit(0.0)))
    df = df.withColumn("_obv", F.sum("_sv").over(running(w)))
    flow = rolling(F.sum, F.abs("_sv"), w, n, n)
    change = F.col("_obv") - F.lag("_obv", n).over(w)
    return df.withColumn(f"obv_slope_{n}", F.when(flow > 1e-10, change / flow).otherwise(0.0)).drop("_sv", "_obv")


def indicators(bars: DataFrame) -> DataFrame:
    """Trend, oscillator and range indicators over the context window."""
    w = context_window()
    eps, wilder = 1e-10, 1.0 / 14
    prev_close = F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    change = F.col("close") - prev_close
    df = bars.withColumns({
        "_gain": F.greatest(change, change * 0.0), "_loss": F.greatest(-change, change * 0.0),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev_close), F.abs(F.col("low") - prev_close)),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    df = with_ewm(df, {
        **{f"_ema{n}": ("close", 2.0 / (n + 1), n) for n in (8, 21, 50, 12, 26)},
        "_ag": ("_gain", wilder, 14), "_al": ("_loss", wilder, 14), "_atr": ("_tr", wilder, 14),
        "_sp": ("_pdm", wilder, 14), "_sm": ("_mdm", wilder, 14),
    }, CONTEXT_KEYS, BAR_ORDER)
    df = df.withColumns({
        "_macd": F.expr("_ema12 - _ema26"),
        "plus_di_14": F.expr(f"if(_atr > {eps}, _sp / _atr * 100D, null)"),
        "minus_di_14": F.expr(f"if(_atr > {eps}, _sm / _atr * 100D, null)"),
    }).withColumn("_dx", F.expr(f"abs(plus_di_14 - minus_di_14) / (plus_di_14 + minus_di_14 + {eps}D) * 100D"))
    df = with_ewm(df, {"_signal": ("_macd", 2.0 / 10, 9), "adx_14": ("_dx", wilder, 14)}, CONTEXT_KEYS, BAR_ORDER)
    sma = {n: rolling(F.avg, F.col("close"), w, n, n) for n in (8, 21, 50, 200)}
    df = df.withColumns({
        **{f"_sma{n}": c for n, c in sma.items()},
        "_bbm": rolling(F.avg, F.col("close"), w, 20, 20), "_bbs": rolling(F.stddev_samp, F.col("close"), w, 20, 20),
        "_ll": rolling(F.min, F.col("low"), w, 14, 14), "_hh": rolling(F.max, F.col("high"), w, 14, 14),
    })
    df = df.withColumns({
        **{f"sma_ratio_{n}": F.expr(f"if(abs(_sma{n}) > {eps}, close / _sma{n} - 1D, null)") for n in sma},
        **{f"ema_ratio_{n}": F.expr(f"if(abs(_ema{n}) > {eps}, close / _ema{n} - 1D, null)") for n in (8, 21, 50)},
        "rsi_14": F.expr(f"100D - 100D / (1D + _ag / (_al + {eps}D))"),
        "atr_norm_14": F.expr(f"_atr / (close + {eps}D)"),
        "bb_bandwidth_20": F.expr(f"4D * _bbs / (_bbm + {eps}D)"),
        "bb_pctb_20": F.expr(f"(close - (_bbm - 2D * _bbs)) / (4D * _bbs + {eps}D)"),
        "macd_norm": F.expr(f"_macd / (close + {eps}D)"),
        "macd_signal_norm": F.expr(f"_signal / (close + {eps}D)"),
        "macd_hist_norm": F.expr(f"(_macd - _signal) / (close + {eps}D)"),
        "stoch_k_14": F.expr(f"""case when _hh is null then null when abs(_hh - _ll) <= {eps} then 50D
            else least(greatest((close - _ll) / (_hh - _ll + {eps}D) * 100D, 0D), 100D) end"""),
    }).withColumn("stoch_d_14", rolling(F.avg, F.col("stoch_k_14"), w, 3, 3))
    return df.drop(*[c for c in df.columns if c.startswith("_")])
