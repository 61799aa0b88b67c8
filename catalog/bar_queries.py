"""Tick sources and bar aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.sources import ticks as T

from .base import CTES, add

CTES["ticks"] = """
SELECT 'S' || (user_id % 4) AS symbol, ts AS ts_event, ts + to_microseconds(event_id % 1000) AS ts_recv,
       event_id AS seq, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session_date,
       CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'T' WHEN event_type = 'signup' THEN 'A'
            WHEN event_id % 2 = 1 THEN 'M' ELSE 'C' END AS action,
       CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS side,
       1 + CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS size,
       round((100 + value % 10) / 0.25) * 0.25 AS price,
       round((100 + value % 10) / 0.25) * 0.25 - 0.25 AS bid_px_00,
       round((100 + value % 10) / 0.25) * 0.25 + 0.25 * (1 + event_id % 3) AS ask_px_00,
       1 + event_id % 17 AS bid_sz_00, 1 + event_id % 13 AS ask_sz_00,
       1 + event_id % 5 AS bid_ct_00, 1 + event_id % 7 AS ask_ct_00
FROM events"""


def bar_ctes(tag: str, key: str, source: str, start: str, seq: str) -> None:
    """CTEs ``bars_<tag>`` (and its helpers) for one bucketing of the ticks."""
    CTES[f"keyed_{tag}"] = f"SELECT *, {key} AS bar_id FROM {source}"
    CTES[f"lv_{tag}"] = f"""
SELECT symbol, kday, bar_id, CAST(round(price / 0.25) AS BIGINT) AS level, sum(size) AS vol,
       coalesce(sum(size) FILTER (side = 'A'), 0) AS buy, coalesce(sum(size) FILTER (side = 'B'), 0) AS sell
FROM keyed_{tag} WHERE action = 'T' GROUP BY ALL"""
    CTES[f"st_{tag}"] = f"""
WITH near AS (
  SELECT a.symbol, a.kday, a.bar_id, a.level,
         a.buy > 0 AND a.buy >= 3 * lo.sell AS up, a.sell > 0 AND a.sell >= 3 * hi.buy AS dn
  FROM lv_{tag} a
  LEFT JOIN lv_{tag} lo ON lo.symbol = a.symbol AND lo.kday = a.kday AND lo.bar_id = a.bar_id AND lo.level = a.level - 1
  LEFT JOIN lv_{tag} hi ON hi.symbol = a.symbol AND hi.kday = a.kday AND hi.bar_id = a.bar_id AND hi.level = a.level + 1),
runs AS (
  SELECT symbol, kday, bar_id, 1 AS dir, level - row_number() OVER (PARTITION BY symbol, kday, bar_id ORDER BY level) AS grp
  FROM near WHERE up
  UNION ALL
  SELECT symbol, kday, bar_id, -1, level - row_number() OVER (PARTITION BY symbol, kday, bar_id ORDER BY level)
  FROM near WHERE dn),
long_runs AS (SELECT symbol, kday, bar_id, dir FROM runs GROUP BY symbol, kday, bar_id, dir, grp HAVING count(*) >= 3)
SELECT symbol, kday, bar_id, count(*) AS n, sign(sum(dir)) AS dir FROM long_runs GROUP BY ALL"""
    CTES[f"bars_{tag}"] = f"""
WITH base AS (
  SELECT symbol, kday, bar_id,
    min(ts_event) FILTER (action = 'T') AS first_ts, max(ts_event) FILTER (action = 'T') AS ts_close,
    first(seq ORDER BY ts_event, seq) FILTER (action = 'T') AS first_seq,
    first(price ORDER BY ts_event, seq) FILTER (action = 'T') AS open,
    max(price) FILTER (action = 'T') AS high, min(price) FILTER (action = 'T') AS low,
    last(price ORDER BY ts_event, seq) FILTER (action = 'T') AS close,
    sum(size) FILTER (action = 'T') AS volume,
    sum(price * size) FILTER (action = 'T') / sum(size) FILTER (action = 'T') AS vwap,
    count(*) FILTER (action = 'T') AS trade_count,
    coalesce(sum(size) FILTER (action = 'T' AND side = 'A'), 0) AS buy_volume,
    coalesce(sum(size) FILTER (action = 'T' AND side = 'B'), 0) AS sell_volume,
    count(*) FILTER (action = 'T' AND size >= 10) AS large_trade_count,
    coalesce(sum(size) FILTER (action = 'T' AND side = 'A' AND size >= 10), 0) AS large_buy_volume,
    coalesce(sum(size) FILTER (action = 'T' AND side = 'B' AND size >= 10), 0) AS large_sell_volume,
    count(*) FILTER (action = 'T' AND size >= 30) AS whale_trade_count_30,
    coalesce(sum(size) FILTER (action = 'T' AND side = 'A' AND size >= 30), 0) AS whale_buy_volume_30,
    coalesce(sum(size) FILTER (action = 'T' AND side = 'B' AND size >= 30), 0) AS whale_sell_volume_30,
    last(bid_px_00 ORDER BY ts_event, seq) AS bid_price, last(ask_px_00 ORDER BY ts_event, seq) AS ask_price,
    last(bid_sz_00 ORDER BY ts_event, seq) AS bid_size, last(ask_sz_00 ORDER BY ts_event, seq) AS ask_size,
    last(bid_ct_00 ORDER BY ts_event, seq) AS bid_count, last(ask_ct_00 ORDER BY ts_event, seq) AS ask_count,
    count(*) AS msg_count, count(*) FILTER (action = 'A') AS add_count,
    count(*) FILTER (action = 'C') AS cancel_count, count(*) FILTER (action = 'M') AS modify_count,
    avg(epoch_us(ts_recv) - epoch_us(ts_event)) * 1000 AS latency_mean
  FROM keyed_{tag} GROUP BY ALL HAVING count(*) FILTER (action = 'T') > 0),
prof AS (
  SELECT symbol, kday, bar_id, max(level) - min(level) + 1 AS span, count(*) AS n_levels, max(vol) AS max_level_volume,
    arg_max(vol, level) AS volume_at_high, arg_min(vol, level) AS volume_at_low,
    arg_max(buy, level) AS buy_vol_at_high, arg_max(sell, level) AS sell_vol_at_high,
    arg_min(buy, level) AS buy_vol_at_low, arg_min(sell, level) AS sell_vol_at_low,
    list(level * 0.25 ORDER BY level) AS vap_prices, list(vol ORDER BY level) AS vap_volumes
  FROM lv_{tag} GROUP BY ALL)
SELECT b.*, {start} AS ts_event, {seq} AS seq, CAST({start} - INTERVAL 5 HOUR AS DATE) AS session_date,
  (epoch_us(b.ts_close) - epoch_us({start})) * 1000 AS bar_duration_ns,
  coalesce(s.n, 0) AS stacked_imbalance_count, coalesce(s.dir, 0) AS stacked_imbalance_direction,
  p.span - p.n_levels AS zero_print_count, (p.span - p.n_levels) / p.span AS zero_print_ratio,
  CASE WHEN buy_vol_at_high > 0 AND sell_vol_at_high > 0 THEN 1 ELSE 0 END AS unfinished_high,
  CASE WHEN buy_vol_at_low > 0 AND sell_vol_at_low > 0 THEN 1 ELSE 0 END AS unfinished_low,
  p.max_level_volume, p.volume_at_high, p.volume_at_low, p.buy_vol_at_high, p.sell_vol_at_high,
  p.buy_vol_at_low, p.sell_vol_at_low, p.vap_prices, p.vap_volumes
FROM base b JOIN prof p USING (symbol, kday, bar_id) LEFT JOIN st_{tag} s USING (symbol, kday, bar_id)"""


CTES["whole"] = "SELECT *, 0 AS kday FROM ticks"
CTES["day_trades"] = """
SELECT *, session_date AS kday, sum(size) OVER d AS cumvol, row_number() OVER d AS trade_no
FROM ticks WHERE action = 'T' WINDOW d AS (PARTITION BY symbol, session_date ORDER BY ts_event, seq)"""
bar_ctes("60", "epoch_us(ts_event) // 3600000000", "whole", "make_timestamp(bar_id * 3600000000)", "0")
bar_ctes("30", "epoch_us(ts_event) // 1800000000", "whole", "make_timestamp(bar_id * 1800000000)", "0")
bar_ctes("v", "(CAST(cumvol AS BIGINT) - 1) // 500", "day_trades", "first_ts", "first_seq")
bar_ctes("t", "(trade_no - 1) // 10", "day_trades", "first_ts", "first_seq")
CTES["b"] = "SELECT * EXCLUDE (kday, bar_id, first_ts, first_seq) FROM bars_60"

KEY = "symbol:s session_date:D ts_event:t seq:i"
PRICE = "ts_close:t bar_duration_ns:i open:d high:d low:d close:d volume:i vwap:d trade_count:i"
SPLIT = ("buy_volume:i sell_volume:i large_trade_count:i large_buy_volume:i large_sell_volume:i "
         "whale_trade_count_30:i whale_buy_volume_30:i whale_sell_volume_30:i")
BOOK = "bid_price:d ask_price:d bid_size:i ask_size:i bid_count:i ask_count:i"
MSG = "msg_count:i add_count:i cancel_count:i modify_count:i latency_mean:d"
FOOT = ("stacked_imbalance_count:i stacked_imbalance_direction:i zero_print_count:i zero_print_ratio:d "
        "unfinished_high:i unfinished_low:i max_level_volume:i volume_at_high:i volume_at_low:i "
        "buy_vol_at_high:i sell_vol_at_high:i buy_vol_at_low:i sell_vol_at_low:i")

add("tick_scan", "symbol:s ts_event:t ts_recv:t seq:i action:s side:s size:i price:d bid_px_00:d ask_px_00:d "
    "bid_sz_00:i ask_sz_00:i bid_ct_00:i ask_ct_00:i", lambda x: x.ticks, "SELECT * FROM ticks")

_SPLITS = {"train": ("2024-01-01", "2024-01-14"), "validate": ("2024-01-15", "2024-01-22"),
           "test": ("2024-01-23", "2024-01-31")}


def _split_days(x):
    access = T.AccessMode()
    access.set("promotion")
    days = T.with_trading_day(x.ticks)
    parts = [T.select_split(days, s, access, _SPLITS).groupBy(F.lit(s).alias("split"))
             .agg(F.count(F.lit(1)).alias("tick_count"), F.countDistinct("date").alias("day_count")) for s in _SPLITS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


add("split_selection", "split:s tick_count:i day_count:i", _split_days, """
SELECT CASE WHEN session_date <= DATE '2024-01-14' THEN 'train' WHEN session_date <= DATE '2024-01-22' THEN 'validate'
       ELSE 'test' END AS split, count(*) AS tick_count, count(DISTINCT session_date) AS day_count
FROM ticks WHERE session_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1""")

for _s, _lo in (("rth", 570), ("eth", 180)):
    add(f"session_filter_{_s}", "symbol:s seq:i ts_event:t", lambda x, s=_s: T.filter_session(x.ticks, s),
        f"""SELECT symbol, seq, ts_event FROM ticks
WHERE hour(ts_event - INTERVAL 5 HOUR) * 60 + minute(ts_event - INTERVAL 5 HOUR) BETWEEN {_lo} AND 959""")

add("tick_table_check", "row_count:i null_symbol:i null_price:i null_size:i null_side:i first_ts:t last_ts:t",
    lambda x: T.table_check(x.ticks),
    """SELECT count(*) AS row_count, count(*) FILTER (symbol IS NULL) AS null_symbol, count(*) FILTER (price IS NULL)
AS null_price, count(*) FILTER (size IS NULL) AS null_size, count(*) FILTER (side IS NULL) AS null_side,
min(ts_event) AS first_ts, max(ts_event) AS last_ts FROM ticks""")

add("time_bars", f"{KEY} {PRICE}", lambda x: x.bars(), "SELECT * FROM b")
add("bar_aggressor_split", f"{KEY} {SPLIT}", lambda x: x.bars(), "SELECT * FROM b")
add("bar_book_snapshot", f"{KEY} {BOOK}", lambda x: x.bars(), "SELECT * FROM b")
add("bar_message_counts", f"{KEY} {MSG}", lambda x: x.bars(), "SELECT * FROM b")
add("bar_footprint", f"{KEY} {FOOT}", lambda x: x.bars(), "SELECT * FROM b")
for _n, _cfg, _tag in (("volume_bars", "vol_500", "v"), ("tick_bars", "tick_10", "t")):
    add(_n, f"{KEY} {PRICE} {SPLIT} {BOOK} {MSG} {FOOT}", lambda x, c=_cfg: x.bars(c), f"SELECT * FROM bars_{_tag}")
add("bar_volume_at_price", f"{KEY} pos:i vap_price:d vap_volume:i",
    lambda x: x.bars().select("symbol", "session_date", "ts_event", "seq", F.posexplode(
        F.arrays_zip("vap_prices", "vap_volumes")).alias("pos", "v")).select(
        "*", F.col("v.vap_prices").alias("vap_price"), F.col("v.vap_volumes").alias("vap_volume")),
    """SELECT symbol, session_date, ts_event, seq, generate_subscripts(vap_prices, 1) - 1 AS pos,
unnest(vap_prices) AS vap_price, unnest(vap_volumes) AS vap_volume FROM b""")
add("bar_range_summary", "symbol:s row_count:i range_p25:d range_p50:d range_p75:d range_p90:d",
    lambda x: B.range_summary(x.bars()),
    """SELECT symbol, count(*) AS row_count, quantile_cont((high - low) / 0.25, 0.25) AS range_p25,
quantile_cont((high - low) / 0.25, 0.5) AS range_p50, quantile_cont((high - low) / 0.25, 0.75) AS range_p75,
quantile_cont((high - low) / 0.25, 0.9) AS range_p90 FROM b GROUP BY symbol""")


def _config_counts(x):
    out = None
    for label in ("eth_time_30m", "vol_500", "tick_10"):
        c = B.parse_bar_config(label)
        ticks = T.filter_session(x.ticks, c["session"])
        one = B.build_bars(ticks, label).groupBy(F.lit(label).alias("bar_config"), "symbol").agg(
            F.count(F.lit(1)).alias("bar_count"), F.sum("volume").alias("volume"))
        out = one if out is None else out.unionByName(one)
    return out


add("bar_config_dispatch", "bar_config:s symbol:s bar_count:i volume:i", _config_counts, """
WITH f AS (SELECT *, hour(ts_event - INTERVAL 5 HOUR) * 60 + minute(ts_event - INTERVAL 5 HOUR) AS mi
           FROM ticks WHERE action = 'T'),
r AS (SELECT *, sum(size) OVER d AS cv, row_number() OVER d AS rn FROM f WHERE mi BETWEEN 570 AND 959
      WINDOW d AS (PARTITION BY symbol, session_date ORDER BY ts_event, seq))
SELECT 'eth_time_30m' AS bar_config, symbol, count(DISTINCT epoch_us(ts_event) // 1800000000) AS bar_count,
       sum(size) AS volume FROM f WHERE mi BETWEEN 180 AND 959 GROUP BY symbol
UNION ALL SELECT 'vol_500', symbol, count(DISTINCT (session_date, (CAST(cv AS BIGINT) - 1) // 500)), sum(size) FROM r GROUP BY symbol
UNION ALL SELECT 'tick_10', symbol, count(DISTINCT (session_date, (rn - 1) // 10)), sum(size) FROM r GROUP BY symbol""")
