"""Structured Streaming: incremental time, volume and tick bars and a duplicate-free experiment log."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.windows import EASTERN, eastern_date
from ..operators.bars import numbered_bars, parse_bar_config, windowed_bars
from ..operators.logstats import trial_keys, trial_totals
from ..params import resolve


def streaming_bars(ticks: DataFrame, size: str, lateness: str = "10 minutes", params: dict | None = None) -> DataFrame:
    """All columns of the time bars of a tick stream in append mode; ticks older than the watermark are dropped.

    Two chained built-in aggregations: price levels of a window, then the bar of its levels.  State is bounded by the windows
    that are open; on closed input the bars equal ``time_bars``.
    """
    return windowed_bars(ticks.withWatermark("ts_event", lateness), size, params)


def deduplicated_log(log: DataFrame, window: str = "1 day") -> DataFrame:
    """Log rows with repeated event ids removed within the watermark."""
    return log.withWatermark("timestamp", window).dropDuplicatesWithinWatermark(["event_id"])


def run_log_stream(log: DataFrame, checkpoint: str, update: Callable[[DataFrame, int], None], window: str = "1 day") -> StreamingQuery:
    """Feed each duplicate-free micro-batch to ``update`` (which may refresh trial counts and scorecards)."""
    return (deduplicated_log(log, window).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def batch_sink(path: str, partials: str | None = None) -> Callable[[DataFrame, int], None]:
    """``update`` of a log stream that stores each batch under its own id, so a batch that is replayed replaces itself.

    With ``partials`` the batch's trials, counted by family and key, are stored likewise; see :func:`counted_trials`.
    """
    def update(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            kept.write.mode("overwrite").parquet(f"{path}/batch={int(batch_id)}")
            if partials:
                keyed = trial_keys(kept).groupBy("family", "key").agg(F.sum("n").alias("n"))
                keyed.write.mode("overwrite").parquet(f"{partials}/batch={int(batch_id)}")
        finally:
            kept.unpersist()
    return update


def counted_trials(partials: DataFrame) -> DataFrame:
    """Trial counts from the counts of all batches: the rows read are families and keys, not the log."""
    return trial_totals(partials.groupBy("family", "key").agg(F.sum("n").alias("n")))


def run_bar_stream(ticks: DataFrame, size: str, path: str, checkpoint: str, lateness: str = "10 minutes") -> StreamingQuery:
    return (streaming_bars(ticks, size, lateness).writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# --- volume and tick bars
def _held(data: bytes) -> list[pd.DataFrame]:
    return [pd.read_parquet(io.BytesIO(data))] if data else []


def _assigner(by_size: bool, threshold: int, columns: list[str]):
    """Number the trades of one (symbol, day) in the order of their time, once the watermark has passed them.

    State: the running total, and the rows of the open bar and of trades that the watermark has not passed (``bar_id`` -1).
    """
    def assign(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, data = state.get if state.exists else (0, b"")
        new = [f.drop(columns="ts_event").assign(bar_id=-1) for f in frames if len(f)]
        rows = pd.concat(_held(bytes(data)) + new, ignore_index=True) if data or new else pd.DataFrame(columns=[*columns, "bar_id", "_us", "_end"])
        if rows.empty:
            state.remove()
            return
        mark, end = state.getCurrentWatermarkMs(), int(rows["_end"].iloc[0])
        waits = (rows["bar_id"] < 0) & (rows["_us"] > mark * 1000)
        ready = rows[(rows["bar_id"] < 0) & ~waits].sort_values(["_us", "seq"])
        if len(ready):
            running = total + (ready["size"].astype("int64").cumsum() if by_size else pd.Series(range(1, len(ready) + 1), index=ready.index))
            rows.loc[ready.index, "bar_id"] = (running - 1) // threshold
            total = int(running.iloc[-1])
        if mark * 1000 >= end:
            closed = rows
            state.remove()
        else:
            # A bar is closed by the first trade of the next one.
            done = (rows["bar_id"] >= 0) & (rows["bar_id"] < rows["bar_id"].max())
            closed, kept = rows[done], rows[~done]
            out = io.BytesIO()
            kept.to_parquet(out)
            state.update((total, out.getvalue()))
            state.setTimeoutTimestamp(max(int(rows.loc[waits, "_us"].min()) // 1000 if waits.any() else end // 1000, mark + 1))
        if len(closed):
            yield closed[[*columns, "bar_id"]]
    return assign


def closed_bar_trades(ticks: DataFrame, config: str, lateness: str = "10 minutes") -> DataFrame:
    """The trades of volume or tick bars with their ``bar_id``: all trades of a bar come in the micro-batch that closes it.

    A bar is closed when the watermark has passed a trade of the next bar, or the end of its Eastern day.  State holds, for each
    (symbol, day) that is open, one bar and the trades of ``lateness``; older trades are dropped.
    """
    c = parse_bar_config(config)
    if c["kind"] == "time":
        raise ValueError("time bars are windows: see streaming_bars")
    given = [n for n in ticks.columns if n not in ("ts_event", "session_date")]
    day_end = F.unix_micros(F.to_utc_timestamp(F.date_add("session_date", 1).cast("timestamp"), EASTERN))
    trades = ticks.filter(F.col("action") == "T").withWatermark("ts_event", lateness).withColumn("session_date", eastern_date(F.col("ts_event")))
    trades = trades.select("ts_event", "session_date", *[F.unix_micros(n).alias(n) if n == "ts_recv" else F.col(n) for n in given],
                           F.unix_micros("ts_event").alias("_us"), day_end.alias("_end"))
    kept = [f for f in trades.schema if f.name not in ("ts_event", "_end")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", bar_id long"
    out = trades.groupBy("symbol", "session_date").applyInPandasWithState(
        _assigner(c["kind"] == "volume", int(c["value"]), [f.name for f in kept]), schema, "total long, rows binary", "append", "EventTimeTimeout")
    return out.select("session_date", "bar_id", F.timestamp_micros("_us").alias("ts_event"), *[F.timestamp_micros(n).alias(n) if n == "ts_recv" else F.col(n) for n in given])


def run_numbered_bar_stream(ticks: DataFrame, config: str, path: str, checkpoint: str, lateness: str = "10 minutes", params: dict | None = None) -> StreamingQuery:
    """All columns of volume or tick bars as they close, stored under the id of their batch, so a replayed batch replaces itself."""
    p = resolve(params)

    def update(batch: DataFrame, batch_id: int) -> None:
        numbered_bars(batch, p).write.mode("overwrite").parquet(f"{path}/batch={int(batch_id)}")
    return (closed_bar_trades(ticks, config, lateness).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
