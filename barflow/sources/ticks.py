"""Tick sources: partitioned Parquet, split selection, session filters and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import eastern_date, eastern_minute
from ..params import resolve

TICKS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts_event", T.TimestampType()),
    T.StructField("ts_recv", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("bid_px_00", T.DoubleType()),
    T.StructField("ask_px_00", T.DoubleType()),
    T.StructField("bid_sz_00", T.LongType()),
    T.StructField("ask_sz_00", T.LongType()),
    T.StructField("bid_ct_00", T.LongType()),
    T.StructField("ask_ct_00", T.LongType()),
])

# The calendar ranges of the three research splits (inclusive days).
SPLITS = {
    "train": ("2022-10-01", "2024-08-31"),
    "validate": ("2024-09-01", "2025-03-31"),
    "test": ("2025-04-01", "2026-02-28"),
}


class AccessMode:
    """Which splits a study may read.  Set once; research may never read ``test``."""

    MODES = ("research", "promotion")

    def __init__(self) -> None:
        self._mode: str | None = None

    @property
    def mode(self) -> str | None:
        return self._mode

    def set(self, mode: str) -> None:
        if mode not in self.MODES:
            raise ValueError(f"unknown access mode {mode!r}")
        if self._mode is not None and self._mode != mode:
            raise RuntimeError("access mode is already set")
        self._mode = mode

    def check(self, split: str, splits: dict = SPLITS) -> tuple[str, str]:
        if split not in splits:
            raise ValueError(f"unknown split {split!r}; known: {sorted(splits)}")
        if split == "test" and self._mode is None:
            raise RuntimeError("set an access mode before reading the test split")
        if split == "test" and self._mode == "research":
            raise PermissionError("research mode may not read the test split")
        return splits[split]


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Ticks stored as ``path/date=YYYY-MM-DD/*.parquet``; pruning and pushdown are the scan's job."""
    schema = T.StructType(TICKS.fields + [T.StructField("date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def select_split(df: DataFrame, split: str, access: AccessMode, splits: dict = SPLITS,
                 day_col: str = "date") -> DataFrame:
    """Keep the days of one split; the access check happens before any plan is built."""
    lo, hi = access.check(split, splits)
    return df.filter(F.col(day_col).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def filter_session(df: DataFrame, session: str, params: dict | None = None) -> DataFrame:
    """RTH 09:30-16:00 or ETH 03:00-16:00 US/Eastern, half-open; ``all`` keeps everything."""
    p = resolve(params)
    if session == "all":
        return df
    opens = {"rth": p["rth_open_min"], "eth": p["eth_open_min"]}
    if session not in opens:
        raise ValueError(f"unknown session {session!r}")
    minute = eastern_minute(F.col("ts_event"))
    return df.filter((minute >= int(opens[session])) & (minute < int(p["rth_close_min"])))


def table_check(df: DataFrame, ts_col: str = "ts_event") -> DataFrame:
    """One row: row count, nulls per column, first and last timestamp; a single scan."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("row_count"), *nulls,
                  F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"))


def ticks_from_events(events: DataFrame, params: dict | None = None) -> DataFrame:
    """Top-of-book messages derived deterministically from an ``events`` table."""
    tick = resolve(params)["tick_size"]
    eid = F.col("event_id")
    price = F.round((F.lit(100.0) + F.col("value") % 10) / tick) * tick
    action = (F.when(F.col("event_type").isin("purchase", "click", "view"), "T")
              .when(F.col("event_type") == "signup", "A")
              .when(eid % 2 == 1, "M").otherwise("C"))
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        ts.alias("ts_event"),
        F.timestamp_micros(F.unix_micros(ts) + eid % 1000).alias("ts_recv"),
        eid.alias("seq"),
        action.alias("action"),
        F.when(eid % 2 == 0, "A").otherwise("B").alias("side"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("size"),
        price.alias("price"),
        (price - tick).alias("bid_px_00"),
        (price + tick * (1 + eid % 3)).alias("ask_px_00"),
        (1 + eid % 17).alias("bid_sz_00"),
        (1 + eid % 13).alias("ask_sz_00"),
        (1 + eid % 5).alias("bid_ct_00"),
        (1 + eid % 7).alias("ask_ct_00"),
    )


def with_trading_day(df: DataFrame, name: str = "date") -> DataFrame:
    """The US/Eastern day of each message: the storage partition and the session key."""
    return df.withColumn(name, eastern_date(F.col("ts_event")))


def write_ticks(df: DataFrame, path: str) -> None:
    """One directory per trading day; re-running a day replaces only that day."""
    (with_trading_day(df).repartition("date", "symbol").sortWithinPartitions("date", "symbol", "ts_event", "seq")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))
