"""Trade PnL, daily series, adaptive costs and performance metrics, for many strategies at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import eastern_minute
from ..params import resolve
from .trades import with_day, with_series_order

METRICS = ["trade_count", "win_count", "loss_count", "win_rate", "gross_pnl", "total_costs", "net_pnl", "avg_trade_pnl", "max_win",
           "max_loss", "profit_factor", "sharpe_ratio", "max_drawdown", "max_drawdown_pct", "avg_holding_time_min", "avg_bars_held"]


def trade_pnl(trades: DataFrame, cost_col: str | None = None, cost_multiplier: float = 1.0, params: dict | None = None) -> DataFrame:
    p = resolve(params)
    unit = F.col(cost_col) if cost_col and cost_col in trades.columns else F.lit(float(p["cost_rt"]))
    return trades.withColumns({
        "gross_pnl_points": F.expr("(exit_price - entry_price) * direction"),
        "costs": unit * F.col("size") * float(cost_multiplier),
        "holding_time_min": (F.unix_seconds("exit_time") - F.unix_seconds("entry_time")) / 60.0,
    }).withColumn("gross_pnl", F.col("gross_pnl_points") / float(p["tick_size"]) * float(p["tick_value"]) * F.col("size")).withColumn(
        "net_pnl", F.col("gross_pnl") - F.col("costs"))


def _weekday_spine(days: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``days`` (keys, date, value) zero-filled over the weekdays between its first and last date."""
    span = days.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    zeros = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("date"), F.lit(0).cast(days.schema[value].dataType).alias(value))
    return days.unionByName(zeros.filter(F.weekday("date") < 5)).groupBy(*keys, "date").agg(F.sum(value).alias(value))


def daily_pnl(pnl: DataFrame, keys: list[str]) -> DataFrame:
    """Net PnL by exit date on the weekday calendar; weekend trade dates stay."""
    days = pnl.groupBy(*keys, F.to_date("exit_time").alias("date")).agg(F.sum("net_pnl").alias("net_pnl"))
    return _weekday_spine(days, keys, "net_pnl")


def daily_trade_counts(trades: DataFrame, keys: list[str]) -> DataFrame:
    days = trades.groupBy(*keys, F.to_date("exit_time").alias("date")).agg(F.count(F.lit(1)).alias("trade_count"))
    return _weekday_spine(days, keys, "trade_count")


def daily_stats(pnl: DataFrame, keys: list[str]) -> DataFrame:
    """Sharpe, share of positive days and largest day share, as if the weekday calendar were filled in.

    Missing weekdays are zeros, so only their number is needed; the calendar is never built.
    """
    days = pnl.groupBy(*keys, F.to_date("exit_time").alias("date")).agg(F.sum("net_pnl").alias("x"))
    agg = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_m"), F.var_pop("x").alias("_v"), F.count_if(F.weekday("date") >= 5).alias("_we"),
        F.min("date").alias("_a"), F.max("date").alias("_b"), F.count_if(F.col("x") > 0).alias("_pos"),
        F.max(F.abs("x")).alias("_big"), F.sum(F.abs("x")).alias("_abs"))
    weekdays = F.size(F.filter(F.sequence("_a", "_b"), lambda d: F.weekday(d) < 5))
    agg = agg.withColumn("day_count", (weekdays + F.col("_we")).cast("double"))
    m2 = F.col("_n") * F.col("_v") + F.col("_n") * (F.col("day_count") - F.col("_n")) / F.col("day_count") * F.col("_m") * F.col("_m")
    agg = agg.withColumn("_sd", F.when(F.col("day_count") > 1, F.sqrt(m2 / F.greatest(F.col("day_count") - 1, F.lit(1.0)))))
    return agg.select(*keys, "day_count", F.when(
        F.col("_sd") > 0, F.col("_m") * F.col("_n") / F.col("day_count") / F.col("_sd") * math.sqrt(252.0)).alias("sharpe_ratio"),
        (F.col("_pos") / F.col("day_count")).alias("positive_day_fraction"),
        F.when(F.col("_abs") > 0, F.col("_big") / F.col("_abs")).otherwise(1.0).alias("max_day_concentration"))


def metrics(trades: DataFrame, keys: list[str], bar_minutes: float = 5.0, cost_col: str | None = "adaptive_cost_rt",
            params: dict | None = None) -> DataFrame:
    """The 16 performance metrics, one row per key.  An undefined Sharpe is null; no losses give an infinite profit factor."""
    capital = float(resolve(params)["capital"])
    pnl = trade_pnl(trades, cost_col, params=params)
    # Equity path in two levels: totals per exit day, then trades inside the day, so no series is one task.
    pnl = pnl.withColumn("_day", F.to_date("exit_time"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_day").orderBy("exit_time", "entry_time").rowsBetween(Window.unboundedPreceding, 0)
    pnl = pnl.withColumn("_run", F.sum("net_pnl").over(inside))
    days = pnl.groupBy(*keys, "_day").agg(F.sum("net_pnl").alias("_tot"), F.max("_run").alias("_top"))
    base = F.coalesce(F.sum("_tot").over(before), F.lit(0.0))
    days = days.withColumn("_base", base).withColumn("_peak", F.greatest(
        F.coalesce(F.max(F.col("_base") + F.col("_top")).over(before), F.lit(0.0)), F.lit(0.0))).select(*keys, "_day", "_base", "_peak")
    pnl = pnl.join(days, [*keys, "_day"]).withColumn("_eq", F.col("_base") + F.col("_run"))
    pnl = pnl.withColumn("_hi", F.greatest(F.max("_eq").over(inside), "_peak"))
    win, loss = F.col("net_pnl") > 0, F.col("net_pnl") < 0
    drop = F.col("_hi") - F.col("_eq")
    agg = pnl.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"), F.count_if(win).alias("win_count"), F.count_if(loss).alias("loss_count"),
        F.sum("gross_pnl").alias("gross_pnl"), F.sum("costs").alias("total_costs"), F.sum("net_pnl").alias("net_pnl"),
        F.avg("net_pnl").alias("avg_trade_pnl"), F.coalesce(F.max(F.when(win, F.col("net_pnl"))), F.lit(0.0)).alias("max_win"),
        F.coalesce(F.min(F.when(loss, F.col("net_pnl"))), F.lit(0.0)).alias("max_loss"),
        F.coalesce(F.sum(F.when(win, F.col("net_pnl"))), F.lit(0.0)).alias("_wins"),
        F.coalesce(F.sum(F.when(loss, F.col("net_pnl"))), F.lit(0.0)).alias("_losses"),
        F.greatest(F.max(drop), F.lit(0.0)).alias("max_drawdown"),
        F.greatest(F.max(F.when(F.col("_hi") > -capital, drop / (F.col("_hi") + capital) * 100.0)), F.lit(0.0)).alias("max_drawdown_pct"),
        F.avg("holding_time_min").alias("avg_holding_time_min"),
        F.avg(F.when(F.col("direction") > 0, F.col("net_pnl"))).alias("long_avg_trade_pnl"),
        F.avg(F.when(F.col("direction") < 0, F.col("net_pnl"))).alias("short_avg_trade_pnl"))
    agg = agg.withColumns({
        "win_rate": F.col("win_count") / F.col("trade_count"),
        "profit_factor": F.expr("case when _losses < 0 then _wins / abs(_losses) when _wins > 0 then double('Infinity') else 0D end"),
        "avg_bars_held": F.col("avg_holding_time_min") / float(bar_minutes)})
    out = agg.join(daily_stats(pnl, keys), keys)
    return out.select(*keys, *METRICS, "positive_day_fraction", "max_day_concentration", "long_avg_trade_pnl", "short_avg_trade_pnl")


def _with_halo(df: DataFrame, keys: list[str], depth: int, block: int = 4096) -> DataFrame:
    """Cut each series into blocks by position; every block also holds the ``depth`` rows before it."""
    blk = F.call_function("div", F.col("pos"), F.lit(block))
    tail = F.col("pos") % block >= block - depth
    return df.withColumn("_own", blk).withColumn(
        "_blk", F.explode(F.when(tail, F.array(blk, blk + 1)).otherwise(F.array(blk))))


def market_state(bars: DataFrame, keys: list[str] = ("symbol",), params: dict | None = None, keep_columns: bool = False) -> DataFrame:
    """Spread in ticks, volatility z, volume z and session progress per bar; rolling windows cross days."""
    keys, p = list(keys), resolve(params)
    n = int(p["cost_lookback"])
    df = bars
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(1.0))
    if "signal" not in df.columns:
        df = df.withColumn("signal", F.lit(0))
    df = _with_halo(with_series_order(df, keys), keys, 2 * n + 2)
    w = Window.partitionBy(*keys, "_blk").orderBy("pos")
    frame = w.rowsBetween(-(n - 1), 0)
    prev = F.lag("close").over(w)

    def z(c: str):
        sd = F.stddev_samp(c).over(frame)
        return F.when((F.count(c).over(frame) >= 2) & (sd > 0), (F.col(c) - F.avg(c).over(frame)) / sd).otherwise(0.0)

    df = df.withColumn("_ret", F.when(prev != 0, F.col("close") / prev - 1))
    df = df.withColumn("_vol", F.when(F.count("_ret").over(frame) >= 2, F.stddev_samp("_ret").over(frame)))
    quotes = {"ask_price", "bid_price"} <= set(bars.columns)
    minute = eastern_minute(F.col("ts_event"))
    df = df.withColumns({
        "spread_ticks": F.expr(f"(ask_price - bid_price) / {float(p['tick_size'])}D") if quotes else F.lit(1.0),
        "volatility_z": z("_vol"), "volume_z": z("volume"),
        "rth_progress": F.when(minute.between(int(p["rth_open_min"]), int(p["rth_close_min"])),
                               (minute - int(p["rth_open_min"])) / float(p["rth_minutes"])).otherwise(0.5)})
    out = df.filter("_blk = _own")
    fields = ["spread_ticks", "volatility_z", "volume_z", "rth_progress"]
    if keep_columns:
        return out.select(*bars.columns, *fields)
    return out.select(*keys, "date_utc", "ts_event", "seq", *fields)


def with_bar_cost(bars: DataFrame, keys: list[str], params: dict | None = None) -> DataFrame:
    """Each bar's round-trip cost as ``bar_cost``; trades that enter on a bar take it along without an as-of join."""
    fields = ["spread_ticks", "volatility_z", "volume_z", "rth_progress"]
    return market_state(bars, keys, params, keep_columns=True).withColumn("bar_cost", cost_rt(params)).drop(*fields)


def asof_state(trades: DataFrame, state: DataFrame, on: list[str] = ("symbol",)) -> DataFrame:
    """Latest state at or before each trade's entry; trades before the first bar get neutral values.

    Only the distinct entry times of a key meet its bars, so a window holds a day's bars and times however many
    strategies trade there, and the trades themselves are joined by their time.  The last state of the previous bar day is
    carried in, so no group grows with the length of the series.
    """
    on = list(on)
    fields = ["spread_ticks", "volatility_z", "volume_z", "rth_progress"]
    t = trades.select(*on, F.col("entry_time").alias("_ts")).distinct().select(
        *on, F.to_date("_ts").alias("date_utc"), "_ts", F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_seq"))
    b = state.select(*on, "date_utc", F.col("ts_event").alias("_ts"), F.lit(0).alias("_side"), F.col("seq").alias("_seq"),
                     F.struct(*fields).alias("_state"))
    rows = t.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*on, "date_utc").orderBy("_ts", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    days = rows.groupBy(*on, "date_utc").agg(F.max_by("_state", F.when(F.col("_side") == 0, F.struct("_ts", "_seq"))).alias("_d"))
    earlier = Window.partitionBy(*on).orderBy("date_utc").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*on, "date_utc", F.last("_d", ignorenulls=True).over(earlier).alias("_carry"))
    known = rows.withColumn("_state", F.last("_state", ignorenulls=True).over(w)).filter("_side = 1").join(days, [*on, "date_utc"], "left").select(
        *on, F.col("_ts").alias("entry_time"), F.coalesce("_state", "_carry").alias("_state"))
    neutral = {"spread_ticks": 1.0, "volatility_z": 0.0, "volume_z": 0.0, "rth_progress": 0.5}
    return trades.join(known, [*on, "entry_time"], "left").select(*trades.columns, *[F.coalesce(F.col(f"_state.{c}"), F.lit(v)).alias(c) for c, v in neutral.items()])


def cost_rt(params: dict | None = None):
    """Round-trip cost from the four state columns."""
    p = resolve(params)
    v, base = float(p["tick_value"]), float(p["slippage_per_side"])
    side = (f"{base}D + {p['cost_vol_mult'] * v}D * greatest(volatility_z, 0D) + {p['cost_spread_mult'] * v}D * greatest(spread_ticks - 1, 0D)"
            f" - {p['cost_volume_discount'] * v}D * greatest(volume_z, 0D)"
            f" + {p['cost_session_mult'] * v}D * 4D * pow(rth_progress - 0.5D, 2)")
    return F.expr(f"greatest({p['commission_rt']}D, {p['commission_rt']}D + 2D * greatest({base * 0.5}D, {side}))")


def adaptive_costs(trades: DataFrame, bars: DataFrame, on: list[str] = ("symbol",), params: dict | None = None) -> DataFrame:
    return asof_state(trades, market_state(bars, on, params), on).withColumn("adaptive_cost_rt", cost_rt(params)).drop(
        "spread_ticks", "volatility_z", "volume_z", "rth_progress")


def score(trades: DataFrame, bars: DataFrame, keys: list[str], on: list[str] = ("symbol",), params: dict | None = None) -> DataFrame:
    """Metrics with adaptive costs when the bars carry time and close, else flat costs."""
    if {"ts_event", "close"} <= set(bars.columns):
        trades = adaptive_costs(trades, bars, on, params)
    return metrics(trades, keys, params=params)
