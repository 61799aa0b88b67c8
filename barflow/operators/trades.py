"""Signals to trades as set operations: runs, barriers, entry events and horizon trades.

``keys`` name the independent series (symbol, strategy, iteration, ...).  Everything is scoped to
(keys, UTC day), so a long series is split over its days; the few facts that cross a day boundary
travel in a one-row-per-day table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts_event", "seq"]


def signal_from_conditions(long: Column, short: Column) -> Column:
    return F.when(long, 1).when(short, -1).otherwise(0).cast("tinyint")


def safe_double(df: DataFrame, name: str, fill: float = 0.0) -> Column:
    """The column as a finite double; a missing column, null, NaN or infinity becomes ``fill``."""
    if name not in df.columns:
        return F.lit(float(fill))
    c = F.col(name).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), float(fill)).otherwise(c)


def sign_signal(raw: Column) -> Column:
    """Normalise any numeric strategy output to -1, 0 or 1."""
    c = raw.cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok, F.signum(c)).otherwise(0.0).cast("tinyint")


def session_start(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "session_date").orderBy(*ORDER)
    return df.withColumn("session_start", F.row_number().over(w) == 1)


def check_signal(df: DataFrame, expected_rows: DataFrame) -> DataFrame:
    """One row telling whether ``signal`` keeps the contract against the frame it was made from."""
    s = F.col("signal").cast("double")
    got = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(s.isNull() | F.isnan(s)).alias("missing"),
                 F.count_if(s.isNotNull() & ~F.isnan(s) & ~s.isin(-1.0, 0.0, 1.0)).alias("out_of_range"))
    want = expected_rows.agg(F.count(F.lit(1)).alias("expected_rows"))
    both = got.withColumn("_k", F.lit(1)).join(want.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("valid", F.expr("row_count = expected_rows and missing = 0 and out_of_range = 0"))


def with_day(df: DataFrame) -> DataFrame:
    return df if "date_utc" in df.columns else df.withColumn("date_utc", F.to_date("ts_event"))


def day_window(keys: list[str]):
    return Window.partitionBy(*keys, "date_utc").orderBy(*ORDER)


def day_ahead(keys: list[str]):
    """The later bars of the day, nearest last: a running frame in falling order, so its cost is linear."""
    falling = [F.col(c).desc() for c in ORDER]
    return Window.partitionBy(*keys, "date_utc").orderBy(*falling).rowsBetween(Window.unboundedPreceding, -1)


def with_series_order(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Position in the whole series, its length, and the signal before each bar, without a whole-series sort."""
    df = with_day(bars)
    order = F.struct(*ORDER)
    days = Window.partitionBy(*keys).orderBy("date_utc")
    table = df.groupBy(*keys, "date_utc").agg(F.count(F.lit(1)).alias("_n"), F.max_by("signal", order).alias("_last")).select(
        *keys, "date_utc",
        F.coalesce(F.sum("_n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("series_rows"), F.lag("_last").over(days).alias("_carry"))
    w = day_window(keys)
    return df.join(table, [*keys, "date_utc"]).withColumns({
        "pos": F.col("_offset") + F.row_number().over(w) - 1,
        "prev_signal": F.coalesce(F.lag("signal").over(w), F.col("_carry")),
    }).drop("_offset", "_carry")


def _trade_columns(keys: list[str], carry: list[str]) -> list[str]:
    return [*keys, "entry_time", "exit_time", "entry_price", "exit_price", "direction", "size",
            *[f"{s}_{c}" for c in carry for s in ("entry", "exit")]]


def run_trades(bars: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """Same-bar mode: a run of constant non-zero signal opens at its first close and closes at the first
    close after the run or at the day's last close; a run starting on the last bar does not trade."""
    w = day_window(keys)
    at = F.struct("ts_event", "close", *carry)
    rest = day_ahead(keys)
    df = with_day(bars).withColumn("_turn", F.col("signal") != F.coalesce(F.lag("signal").over(w), F.lit(0)))
    df = df.withColumns({
        "_exit": F.coalesce(F.last(F.when(F.col("_turn"), at), ignorenulls=True).over(rest), F.first(at).over(rest)),
    })
    return df.filter(F.col("_turn") & (F.col("signal") != 0) & F.col("_exit").isNotNull()).select(
        *keys, F.col("ts_event").alias("entry_time"), F.col("_exit.ts_event").alias("exit_time"),
        F.col("close").alias("entry_price"), F.col("_exit.close").alias("exit_price"),
        F.col("signal").cast("int").alias("direction"), F.lit(1).alias("size"),
        *[F.col(c if s == "entry" else f"_exit.{c}").alias(f"{s}_{c}") for c in carry for s in ("entry", "exit")])


def _with_carry_in(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Day-first rows learn the signal left pending by the previous day's last bar, as ``carry_in``."""
    w = day_window(keys)
    order = F.struct(*ORDER)
    df = with_day(bars).withColumn("_before", F.lag("signal").over(w))
    fresh = F.when(F.coalesce("_before", F.lit(0)) == 0, F.col("signal")).otherwise(0)
    days = Window.partitionBy(*keys).orderBy("date_utc")
    table = df.groupBy(*keys, "date_utc").agg(F.max_by(fresh, order).alias("_left")).select(
        *keys, "date_utc", F.coalesce(F.lag("_left").over(days), F.lit(0)).alias("_left"))
    return df.join(table, [*keys, "date_utc"]).withColumn(
        "carry_in", F.when(F.row_number().over(w) == 1, F.col("_left")).otherwise(0)).drop("_left", "_before")


def next_open_trades(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Next-open mode: a run a..b opens at the open after ``a`` and closes at the close after ``b`` or the
    day's last close.  A signal that appears on a day's last bar fills at the next day's first open."""
    w = day_window(keys)
    rest = day_ahead(keys)
    at = F.struct("ts_event", "close")
    df = _with_carry_in(bars, keys).withColumn("_turn", F.col("signal") != F.coalesce(F.lag("signal").over(w), F.lit(0)))
    df = df.withColumns({
        "_exit": F.coalesce(F.last(F.when(F.col("_turn"), at), ignorenulls=True).over(rest), F.first(at).over(rest)),
        "_next": F.lead(F.struct("ts_event", "open")).over(w),
    })
    held = (F.col("carry_in") != 0) & (F.col("carry_in") == F.col("signal"))
    here = F.struct("ts_event", "open")
    opened = F.when(held, here).otherwise(F.col("_next"))
    runs = df.filter(F.col("_turn") & (F.col("signal") != 0) & F.col("_exit").isNotNull()).select(
        *keys, opened.alias("o"), F.col("_exit").alias("c"), F.col("signal").alias("d"))
    brief = df.filter((F.col("carry_in") != 0) & ((F.col("carry_in") != F.col("signal")) | F.col("_exit").isNull())).select(
        *keys, here.alias("o"), at.alias("c"), F.col("carry_in").alias("d"))
    return runs.unionByName(brief).select(
        *keys, F.col("o.ts_event").alias("entry_time"), F.col("c.ts_event").alias("exit_time"),
        F.col("o.open").alias("entry_price"), F.col("c.close").alias("exit_price"),
        F.col("d").cast("int").alias("direction"), F.lit(1).alias("size"))


def entry_events(bars: DataFrame, keys: list[str], next_open: bool, keep: list[str] = (), horizons: list[int] = (), fill: list[str] = ()) -> DataFrame:
    """Flat-to-signal transitions with signal and fill bar.

    ``keep`` columns are read at the signal bar, ``fill`` columns at the fill bar.  With ``horizons`` the close of the bar each horizon
    reaches inside the fill's day comes along as an array, so no bar-to-bar join is needed.
    """
    w = day_window(keys)
    signal_bar = F.struct("ts_event", *keep)
    shift = 1 if next_open else 0
    exits = F.array(*[F.struct(F.lit(int(h)).alias("horizon_bars"), *[
        F.lead(c, int(h) - shift).over(w).alias(c) for c in ("ts_event", "close")]) for h in horizons]) if horizons else None
    if not next_open:
        df = with_day(bars).withColumns({
            "_turn": (F.col("signal") != 0) & (F.col("signal") != F.coalesce(F.lag("signal").over(w), F.lit(0))),
            "_more": F.lead("ts_event").over(w).isNotNull(), **({"exits": exits} if horizons else {})})
        out = df.filter(F.col("_turn") & F.col("_more"))
        return out.select(*keys, F.col("ts_event").alias("signal_time"), F.col("ts_event").alias("entry_time"), F.col("seq").alias("entry_seq"),
                          F.col("close").alias("entry_price"), F.col("signal").cast("int").alias("direction"),
                          *keep, *fill, *(["exits"] if horizons else []))
    order = F.struct(*ORDER)
    df = with_day(bars).withColumn("_before", F.lag("signal").over(w))
    df = df.withColumn("_new", F.when((F.col("signal") != 0) & (F.col("signal") != F.coalesce("_before", F.lit(0))), F.struct(
        F.col("signal").alias("d"), *[F.col(c) for c in ("ts_event", *keep)])))
    fresh = F.when(F.coalesce("_before", F.lit(0)) == 0, F.col("_new"))
    days = Window.partitionBy(*keys).orderBy("date_utc")
    # max_by over a struct keeps the last bar's value even when it is null.
    table = df.groupBy(*keys, "date_utc").agg(F.max(F.struct(*ORDER, fresh.alias("p"))).alias("_l")).select(
        *keys, "date_utc", F.lag("_l").over(days).alias("_l"))
    df = df.join(table, [*keys, "date_utc"]).withColumns({
        "_rn": F.row_number().over(w), "_pend": F.lag("_new").over(w), "_first_sig": F.first("signal").over(w),
        **({"exits": exits} if horizons else {})})
    # A held carry-in already owns the first run of the day, so that run gives no second event.
    carried = F.col("_l.p")
    owns = (F.col("_rn") == 2) & (carried["d"] == F.col("_first_sig"))
    pend = F.when(F.col("_rn") == 1, carried).when(owns, None).otherwise(F.col("_pend"))
    return df.withColumn("_p", pend).filter(F.col("_p").isNotNull()).select(
        *keys, F.col("_p.ts_event").alias("signal_time"), F.col("ts_event").alias("entry_time"), F.col("seq").alias("entry_seq"),
        F.col("open").alias("entry_price"), F.col("_p.d").cast("int").alias("direction"),
        *[F.col(f"_p.{c}").alias(c) for c in keep], *fill, *(["exits"] if horizons else []))


def horizon_trades(bars: DataFrame, keys: list[str], horizons: list[int], next_open: bool, keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """One trade per event and horizon that still ends inside the fill's UTC day."""
    return event_trades(entry_events(bars, keys, next_open, keep, horizons, fill), [*keys, *keep, *fill])


def event_trades(events: DataFrame, keep: list[str]) -> DataFrame:
    """The trades of events that carry the bars their horizons reach."""
    return events.select(*[c for c in events.columns if c != "exits"], F.explode("exits").alias("x")).filter(
        F.col("x.ts_event").isNotNull()).select(
        *keep, "signal_time", "entry_time", F.col("x.ts_event").alias("exit_time"), "entry_price",
        F.col("x.close").alias("exit_price"), "direction", F.lit(1).alias("size"), F.col("x.horizon_bars").alias("horizon_bars"))


TOUCH_BLOCK = 64


def first_touch(bars: DataFrame, entries: DataFrame, keys: list[str], target: float | None, stop: float | None, max_bars: int | None = None,
                as_return: bool = False, with_fill_bar: bool = False) -> DataFrame:
    """Exit of each entry at stop, target, time limit or day end; the stop wins inside one bar and a gap
    through the stop fills at the open.

    ``target`` and ``stop`` are optional.  The search begins after the entry bar, or at it ``with_fill_bar``
    (next-open entries).  A day is cut into blocks of ``TOUCH_BLOCK`` bars; an entry reads the outline of its day
    (one high and low a block) and then at most two blocks: the one it begins in and the first later one that can end it.
    """
    d = with_day(bars).withColumn("_pos", F.row_number().over(day_window(keys)) - 1)
    d = d.select(*keys, "date_utc", "ts_event", "seq", "open", "high", "low", "close", "_pos", F.expr(f"_pos div {TOUCH_BLOCK}").alias("_blk"))
    on = [*keys, "date_utc"]
    blocks = d.groupBy(*on, "_blk").agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"), F.count(F.lit(1)).alias("_n"),
                                        F.sort_array(F.collect_list(F.struct("_pos", "ts_event", "open", "high", "low", "close"))).alias("_cells"))
    outline = blocks.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("_blk", "_hi", "_lo"))).alias("_outline"), F.sum("_n").alias("_bars"))
    scale = "entry_price" if as_return else "1D"
    price = {"stop_px": f"entry_price - direction * {float(stop)}D * {scale}" if stop is not None else "cast(null as double)",
             "target_px": f"entry_price + direction * {float(target)}D * {scale}" if target is not None else "cast(null as double)"}
    e = entries.withColumn("date_utc", F.to_date("entry_time")).withColumns({k: F.expr(v) for k, v in price.items()})
    at = d.select(*on, F.col("ts_event").alias("entry_time"), F.col("seq").alias("entry_seq"), "_pos")
    if "entry_seq" in entries.columns:
        e = e.join(at, [*on, "entry_time", "entry_seq"])
    else:  # without a sequence number the last bar of the entry's time counts, or the first one with the fill bar
        e = e.join(at.groupBy(*on, "entry_time").agg((F.min if with_fill_bar else F.max)("_pos").alias("_pos")), [*on, "entry_time"])
    limit = "_bars - 1" if max_bars is None else f"least(_begin + {int(max_bars) - 1}, _bars - 1)"
    stopped = "coalesce(if(direction > 0, {b}{low} <= stop_px, {b}{high} >= stop_px), false)"
    reached = "coalesce(if(direction > 0, {b}{high} >= target_px, {b}{low} <= target_px), false)"
    block = dict(b="b.", low="_lo", high="_hi")
    e = e.join(outline, on).withColumn("_begin", F.col("_pos") + (0 if with_fill_bar else 1)).filter("_begin < _bars").withColumn("_limit", F.expr(limit))
    e = e.withColumn("_own", F.expr(f"_begin div {TOUCH_BLOCK}")).withColumn("_end", F.expr(f"_limit div {TOUCH_BLOCK}"))
    later = f"filter(_outline, b -> b._blk > _own and (b._blk >= _end or {stopped.format(**block)} or {reached.format(**block)}))"
    e = e.withColumn("_blk", F.explode(F.array_compact(F.array(F.col("_own"), F.expr(f"try_element_at({later}, 1)._blk"))))).drop("_outline")
    cell = dict(b="c.", low="low", high="high")
    ends = f"filter(_cells, c -> c._pos >= _begin and (c._pos >= _limit or {stopped.format(**cell)} or {reached.format(**cell)}))"
    e = e.join(blocks.select(*on, "_blk", "_cells"), [*on, "_blk"]).withColumn("_hit", F.expr(f"try_element_at({ends}, 1)")).filter("_hit is not null")
    keep = [c for c in entries.columns if c not in ("exit_time", "exit_price", "size")]
    e = e.groupBy(*keep, "stop_px", "target_px").agg(F.min("_hit").alias("c"))
    gap = "if(direction > 0, least(stop_px, c.open), greatest(stop_px, c.open))"
    why = f"case when {stopped.format(**cell)} then 'stop' when {reached.format(**cell)} then 'target' else 'time' end"
    e = e.withColumn("exit_reason", F.expr(why))
    return e.select(*keep, F.col("c.ts_event").alias("exit_time"),
                    F.expr(f"case exit_reason when 'stop' then {gap} when 'target' then target_px else c.close end").alias("exit_price"),
                    "exit_reason", F.lit(1).alias("size"))


def project_to_windows(trades: DataFrame, windows: DataFrame, keys: list[str], window: str = "fold") -> DataFrame:
    """Clip trades to the windows they overlap and reprice clipped ends at the window's open or close.

    ``trades`` carries ``entry_<window>`` and ``exit_<window>``; ``windows`` has one row per (keys,
    window) with start, end, first open and last close.  The overlap is an equi join on window ids.
    """
    spread = trades.withColumn(window, F.explode(F.sequence(f"entry_{window}", f"exit_{window}")))
    j = spread.join(windows, [*keys, window]).filter(
        (F.col("entry_time") < F.col("win_end")) & (F.col("exit_time") >= F.col("win_start")))
    early, late = F.col("entry_time") < F.col("win_start"), F.col("exit_time") > F.col("win_end")
    return j.select(*keys, window, F.when(early, F.col("win_start")).otherwise(F.col("entry_time")).alias("entry_time"),
                    F.when(late, F.col("win_end")).otherwise(F.col("exit_time")).alias("exit_time"),
                    F.when(early, F.col("win_open")).otherwise(F.col("entry_price")).alias("entry_price"),
                    F.when(late, F.col("win_close")).otherwise(F.col("exit_price")).alias("exit_price"), "direction", "size")
