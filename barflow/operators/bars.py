"""Bar aggregation: time, volume and tick bars with footprint and volume-at-price detail.

The tick table is read and shuffled once.  Ticks first collapse to one row per (bar, price level)
with map-side partial aggregation, so a heavily traded bar or symbol is split over its levels and
over the scan tasks; the second, much smaller aggregation folds levels into bars.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import eastern_date
from ..params import resolve

BAR_COLUMNS = [
    "ts_event", "ts_close", "bar_duration_ns", "open", "high", "low", "close", "volume", "vwap", "trade_count",
    "buy_volume", "sell_volume", "large_trade_count", "large_buy_volume", "large_sell_volume",
    "whale_trade_count_30", "whale_buy_volume_30", "whale_sell_volume_30",
    "bid_price", "ask_price", "bid_size", "ask_size", "bid_count", "ask_count",
    "msg_count", "add_count", "cancel_count", "modify_count", "latency_mean",
    "stacked_imbalance_count", "stacked_imbalance_direction", "zero_print_count", "zero_print_ratio",
    "unfinished_high", "unfinished_low", "max_level_volume", "volume_at_high", "volume_at_low",
    "buy_vol_at_high", "sell_vol_at_high", "buy_vol_at_low", "sell_vol_at_low", "vap_prices", "vap_volumes",
]
BAR_KEYS = ["symbol", "session_date", "seq"]

_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600}


def size_seconds(size: str) -> int:
    m = re.fullmatch(r"(\d+)([smh])", size)
    if not m or int(m.group(1)) == 0:
        raise ValueError(f"bad bar size {size!r}")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def bar_config_label(kind: str, value) -> str:
    if kind == "time":
        size_seconds(str(value))
        return f"time_{value}"
    if kind not in ("tick", "volume"):
        raise ValueError(f"unknown bar type {kind!r}")
    if int(value) <= 0:
        raise ValueError("bar threshold must be positive")
    return f"{kind}_{int(value)}"


def parse_bar_config(label: str) -> dict:
    """``tick_610``, ``vol_2000``/``volume_2000``, ``time_5m``; prefix ``eth_`` selects the long session."""
    session, rest = ("eth", label[4:]) if label.startswith("eth_") else ("rth", label)
    kind, _, value = rest.partition("_")
    kind = {"vol": "volume"}.get(kind, kind)
    if kind == "time":
        return {"kind": "time", "value": value, "seconds": size_seconds(value), "session": session}
    if kind not in ("tick", "volume"):
        raise ValueError(f"unknown bar config {label!r}")
    if not value.isdigit() or int(value) <= 0:
        raise ValueError(f"bar threshold must be positive in {label!r}")
    return {"kind": kind, "value": int(value), "session": session}


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def _when_sum(cond: Column, value: Column, name: str) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0).cast("bigint"))).alias(name)


def _price_levels(ticks: DataFrame, keys: list[str], p: dict) -> DataFrame:
    """One row per (bar, price level) carrying every partial statistic the bar needs.

    Messages that are not trades share the null level.
    """
    trade = F.col("action") == "T"
    buy, sell = trade & (F.col("side") == "A"), trade & (F.col("side") == "B")
    large, whale = F.col("size") >= int(p["large_lot"]), F.col("size") >= int(p["whale_lot"])
    one, size = F.lit(1).cast("bigint"), F.col("size")
    printed = F.struct("ts_event", "seq", "price")
    latency = (F.unix_micros("ts_recv") - F.unix_micros("ts_event")) * 1000
    book = F.struct("ts_event", "seq", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "bid_ct_00", "ask_ct_00")
    level = F.when(trade, F.round(F.col("price") / p["tick_size"]).cast("bigint"))
    return ticks.withColumn("level", level).groupBy(*keys, "level").agg(
        F.count(F.lit(1)).alias("n_msg"),
        _when_sum(F.col("action") == "A", one, "n_add"),
        _when_sum(F.col("action") == "C", one, "n_cancel"),
        _when_sum(F.col("action") == "M", one, "n_modify"),
        F.sum(latency).alias("lat_ns"),
        F.count(latency).alias("lat_n"),
        _when_sum(trade, one, "n_trade"),
        _when_sum(trade, size, "vol"),
        _when_sum(buy, size, "buy"),
        _when_sum(sell, size, "sell"),
        _when_sum(trade & large, one, "n_large"),
        _when_sum(buy & large, size, "buy_large"),
        _when_sum(sell & large, size, "sell_large"),
        _when_sum(trade & whale, one, "n_whale"),
        _when_sum(buy & whale, size, "buy_whale"),
        _when_sum(sell & whale, size, "sell_whale"),
        F.sum(F.when(trade, F.col("price") * size)).alias("pv"),
        F.max(F.when(trade, F.col("price"))).alias("px_max"),
        F.min(F.when(trade, F.col("price"))).alias("px_min"),
        F.min(F.when(trade, printed)).alias("first_print"),
        F.max(F.when(trade, printed)).alias("last_print"),
        F.max(book).alias("book"),
    )


def _mark_stacks(levels: DataFrame, keys: list[str], p: dict) -> DataFrame:
    """Flag the level at which a run of diagonal imbalances reaches the stacking length.

    A buy imbalance compares buys with the sells one tick lower, a sell imbalance compares sells with
    the buys one tick higher; a run breaks at an unflagged level or at an untraded tick.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("level").asc_nulls_first())
    ratio, need = float(p["stack_ratio"]), int(p["stack_levels"])
    below = F.lag("level").over(w) == F.col("level") - 1
    above = F.lead("level").over(w) == F.col("level") + 1
    df = levels.withColumns({
        "_i": F.row_number().over(w),
        "_adj": F.coalesce(below, F.lit(False)),
        "_up": F.coalesce(below & (F.col("buy") > 0) & (F.col("buy") >= ratio * F.lag("sell").over(w)), F.lit(False)),
        "_dn": F.coalesce(above & (F.col("sell") > 0) & (F.col("sell") >= ratio * F.lead("buy").over(w)), F.lit(False)),
    })
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    for flag, name in (("_up", "stack_up"), ("_dn", "stack_dn")):
        broken = F.when(~F.col(flag), F.col("_i")).when(~F.col("_adj"), F.col("_i") - 1)
        streak = F.col("_i") - F.coalesce(F.max(broken).over(run), F.lit(0))
        df = df.withColumn(name, F.when(F.col(flag) & (streak == need), 1).otherwise(0))
    return df.drop("_i", "_adj", "_up", "_dn")


def stack_counts(cells: Column, p: dict) -> tuple[Column, Column]:
    """Buy and sell stacks of a bar from its sorted array of (level, vol, buy, sell): the rule of ``_mark_stacks`` without a window."""
    ratio, need = float(p["stack_ratio"]), int(p["stack_levels"])
    place = F.sequence(F.lit(0), F.size(cells) - 1)

    def count(flag) -> Column:
        def step(acc: Column, i: Column) -> Column:
            c, before, after = F.get(cells, i), F.get(cells, i - 1), F.get(cells, i + 1)
            joined = F.coalesce(before["level"] == c["level"] - 1, F.lit(False))
            streak = F.when(F.coalesce(flag(c, before, after), F.lit(False)), F.when(joined, acc["s"]).otherwise(0) + 1).otherwise(0)
            return F.struct(streak.cast("int").alias("s"), (acc["n"] + F.when(streak == need, 1).otherwise(0)).cast("int").alias("n"))
        start = F.struct(F.lit(0).cast("int").alias("s"), F.lit(0).cast("int").alias("n"))
        return F.when(F.size(cells) > 0, F.aggregate(place, start, step)["n"]).otherwise(0)
    up = count(lambda c, before, after: (before["level"] == c["level"] - 1) & (c["buy"] > 0) & (c["buy"] >= ratio * before["sell"]))
    down = count(lambda c, before, after: (after["level"] == c["level"] + 1) & (c["sell"] > 0) & (c["sell"] >= ratio * after["buy"]))
    return up, down


def _fold_levels(levels: DataFrame, keys: list[str], p: dict, windows: bool = True) -> DataFrame:
    """Bars from their price levels; without ``windows`` (streams) the stacks are counted in each bar's own array of levels."""
    traded = F.col("level").isNotNull()
    by_level = F.col("level")
    cell = F.struct("level", "vol", "buy", "sell")
    total = {n: F.sum(n).alias(n) for n in (
        "n_msg", "n_add", "n_cancel", "n_modify", "n_trade", "vol", "buy", "sell", "n_large", "buy_large",
        "sell_large", "n_whale", "buy_whale", "sell_whale", "pv", "lat_ns", "lat_n", "stack_up", "stack_dn")}
    if windows:
        levels, cells = _mark_stacks(levels, keys, p), []
    else:
        total, cells = {k: v for k, v in total.items() if not k.startswith("stack_")}, [F.sort_array(F.collect_list(F.when(traded, cell))).alias("_cells")]
    out = levels.groupBy(*keys).agg(
        *total.values(), *cells,
        F.max("px_max").alias("high"), F.min("px_min").alias("low"),
        F.min("first_print").alias("first_print"), F.max("last_print").alias("last_print"),
        F.max("book").alias("book"),
        F.max("vol").alias("max_vol"), F.count("level").alias("n_levels"),
        F.max(F.when(traded, cell)).alias("top"), F.min(F.when(traded, cell)).alias("bottom"),
        F.sort_array(F.collect_list(F.when(traded, F.struct(by_level, F.col("vol"))))).alias("vap"),
    ).filter(F.col("n_trade") > 0)
    if not windows:
        up, down = stack_counts(F.col("_cells"), p)
        out = out.withColumns({"stack_up": up, "stack_dn": down}).drop("_cells")
    return out


def _bar_projection(folded: DataFrame, start: Column, seq: Column, p: dict) -> DataFrame:
    tick = float(p["tick_size"])
    span = F.col("top.level") - F.col("bottom.level") + 1
    zero = span - F.col("n_levels")
    out = folded.select(
        "symbol",
        eastern_date(start).alias("session_date"),
        seq.alias("seq"),
        start.alias("ts_event"),
        F.col("last_print.ts_event").alias("ts_close"),
        ((F.unix_micros("last_print.ts_event") - F.unix_micros(start)) * 1000).alias("bar_duration_ns"),
        F.col("first_print.price").alias("open"), "high", "low", F.col("last_print.price").alias("close"),
        F.col("vol").alias("volume"), (F.col("pv") / F.col("vol")).alias("vwap"), F.col("n_trade").alias("trade_count"),
        F.col("buy").alias("buy_volume"), F.col("sell").alias("sell_volume"),
        F.col("n_large").alias("large_trade_count"),
        F.col("buy_large").alias("large_buy_volume"), F.col("sell_large").alias("large_sell_volume"),
        F.col("n_whale").alias("whale_trade_count_30"),
        F.col("buy_whale").alias("whale_buy_volume_30"), F.col("sell_whale").alias("whale_sell_volume_30"),
        F.col("book.bid_px_00").alias("bid_price"), F.col("book.ask_px_00").alias("ask_price"),
        F.col("book.bid_sz_00").alias("bid_size"), F.col("book.ask_sz_00").alias("ask_size"),
        F.col("book.bid_ct_00").alias("bid_count"), F.col("book.ask_ct_00").alias("ask_count"),
        F.col("n_msg").alias("msg_count"), F.col("n_add").alias("add_count"),
        F.col("n_cancel").alias("cancel_count"), F.col("n_modify").alias("modify_count"),
        (F.col("lat_ns") / F.col("lat_n")).alias("latency_mean"),
        (F.col("stack_up") + F.col("stack_dn")).cast("int").alias("stacked_imbalance_count"),
        F.signum(F.col("stack_up") - F.col("stack_dn")).cast("int").alias("stacked_imbalance_direction"),
        zero.cast("int").alias("zero_print_count"), (zero / span).alias("zero_print_ratio"),
        F.when((F.col("top.buy") > 0) & (F.col("top.sell") > 0), 1).otherwise(0).alias("unfinished_high"),
        F.when((F.col("bottom.buy") > 0) & (F.col("bottom.sell") > 0), 1).otherwise(0).alias("unfinished_low"),
        F.col("max_vol").alias("max_level_volume"),
        F.col("top.vol").alias("volume_at_high"), F.col("bottom.vol").alias("volume_at_low"),
        F.col("top.buy").alias("buy_vol_at_high"), F.col("top.sell").alias("sell_vol_at_high"),
        F.col("bottom.buy").alias("buy_vol_at_low"), F.col("bottom.sell").alias("sell_vol_at_low"),
        F.transform("vap", lambda c: c["level"] * F.lit(tick)).alias("vap_prices"),
        F.transform("vap", lambda c: c["vol"]).alias("vap_volumes"),
    )
    return out


def time_bars(ticks: DataFrame, size: str, params: dict | None = None) -> DataFrame:
    """Left-closed, left-labelled windows; a window without trades gives no bar."""
    p, width = resolve(params), size_seconds(size) * 1_000_000
    keyed = ticks.withColumn("bar_id", _div(F.unix_micros("ts_event"), width))
    keys = ["symbol", "bar_id"]
    folded = _fold_levels(_price_levels(keyed, keys, p), keys, p)
    return _bar_projection(folded, F.timestamp_micros(F.col("bar_id") * width), F.lit(0).cast("bigint"), p)


def windowed_bars(ticks: DataFrame, size: str, params: dict | None = None) -> DataFrame:
    """``time_bars`` from two chained windowed aggregations (price levels, then bars), which streams can run too."""
    p, width = resolve(params), f"{size_seconds(size)} seconds"
    levels = _price_levels(ticks.withColumn("_w", F.window("ts_event", width)), ["symbol", "_w"], p)
    levels = levels.withColumn("_b", F.window(F.window_time("_w"), width)).drop("_w")
    folded = _fold_levels(levels, ["symbol", "_b"], p, windows=False)
    return _bar_projection(folded, F.col("_b.start"), F.lit(0).cast("bigint"), p)


def _day_prefix(trades: DataFrame, amount: Column, slice_minutes: int = 1) -> DataFrame:
    """Running total of ``amount`` through each trade of its (symbol, day), as ``running_total``.

    Two levels keep a busy day out of a single task: totals per short time slice give each slice its
    starting offset (at most 1440 slices per day), and the ordered sum runs inside slices only.
    """
    width = slice_minutes * 60_000_000
    day = ["symbol", "session_date"]
    t = trades.withColumn("_amt", amount).withColumn("_slice", _div(F.unix_micros("ts_event"), width))
    before = Window.partitionBy(*day).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (t.groupBy(*day, "_slice").agg(F.sum("_amt").alias("_slice_total"))
               .select(*day, "_slice", F.coalesce(F.sum("_slice_total").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*day, "_slice").orderBy("ts_event", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return (t.join(offsets, [*day, "_slice"])
            .withColumn("running_total", F.col("_offset") + F.sum("_amt").over(inside))
            .drop("_amt", "_slice", "_offset"))


def numbered_bars(trades: DataFrame, p: dict) -> DataFrame:
    """Bars of trades that carry their ``bar_id`` within (symbol, session_date)."""
    keys = ["symbol", "session_date", "bar_id"]
    folded = _fold_levels(_price_levels(trades, keys, p), keys, p)
    return _bar_projection(folded, F.col("first_print.ts_event"), F.col("first_print.seq"), p)


def _bucket_bars(ticks: DataFrame, amount: Column, threshold: int, p: dict) -> DataFrame:
    if int(threshold) <= 0:
        raise ValueError("bar threshold must be positive")
    trades = ticks.filter(F.col("action") == "T").withColumn("session_date", eastern_date(F.col("ts_event")))
    return numbered_bars(_day_prefix(trades, amount).withColumn("bar_id", _div(F.col("running_total") - 1, int(threshold))), p)


def volume_bars(ticks: DataFrame, threshold: int, params: dict | None = None) -> DataFrame:
    """Bars of about ``threshold`` traded units per day; a trade is never split, volume is preserved."""
    return _bucket_bars(ticks, F.col("size"), threshold, resolve(params))


def tick_bars(ticks: DataFrame, threshold: int, params: dict | None = None) -> DataFrame:
    """Bars of ``threshold`` trades per day; a block trade counts once."""
    return _bucket_bars(ticks, F.lit(1).cast("bigint"), threshold, resolve(params))


def bar_date(config: str) -> Column:
    """Session date of the bar that a tick belongs to."""
    c, at = parse_bar_config(config), F.col("ts_event")
    if c["kind"] == "time":
        width = size_seconds(c["value"]) * 1_000_000
        at = F.timestamp_micros(_div(F.unix_micros(at), width) * width)
    return eastern_date(at)


def build_bars(ticks: DataFrame, config: str, params: dict | None = None) -> DataFrame:
    """Bars for a configuration label."""
    c = parse_bar_config(config)
    if c["kind"] == "time":
        return time_bars(ticks, c["value"], params)
    return (volume_bars if c["kind"] == "volume" else tick_bars)(ticks, c["value"], params)


def range_summary(bars: DataFrame, params: dict | None = None) -> DataFrame:
    """Bar-range distribution in ticks, per symbol."""
    tick = resolve(params)["tick_size"]
    ticks = (F.col("high") - F.col("low")) / tick
    q = F.percentile(ticks, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("row_count"), q.alias("q")).select(
        "symbol", "row_count", F.lit(len(bars.columns)).alias("column_count"),
        *[F.col("q")[i].alias(n) for i, n in enumerate(("range_p25", "range_p50", "range_p75", "range_p90"))])
