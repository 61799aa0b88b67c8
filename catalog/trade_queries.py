"""Signals, trades, costs and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import flow as O
from barflow.operators import pnl as L
from barflow.operators import trades as T

from .base import CTES, add
from .feature_queries import W, fr

KEYS = ["symbol"]
TRADE = "symbol:s entry_time:t exit_time:t entry_price:d exit_price:d direction:i size:i"


def signal_bars(x):
    """Bars with a three-state signal from the five-bar order-flow sum."""
    ofi = F.col("order_flow_imbalance")
    return O.orderflow(x.bars()).withColumn("signal", T.signal_from_conditions(ofi > 40, ofi < -40))


CTES["sig"] = """
SELECT *, CASE WHEN order_flow_imbalance > 40 THEN 1 WHEN order_flow_imbalance < -40 THEN -1 ELSE 0 END AS signal,
  CAST(ts_event AS DATE) AS date_utc FROM flow"""
CTES["sn"] = """
SELECT *, row_number() OVER d AS i, count(*) OVER (PARTITION BY symbol, date_utc) AS n, lag(signal) OVER d AS prev
FROM sig WINDOW d AS (PARTITION BY symbol, date_utc ORDER BY ts_event, seq)"""


def run_sql(src: str, keys: str, more: str = "") -> str:
    """Run trades of a numbered signal table by joining each run start to the first later change or the last bar; ``more`` columns of the entry bar."""
    on = " AND ".join(f"e.{k} = s.{k}" for k in [*keys.split(", "), "date_utc"])
    cols = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""
SELECT {cols}, s.date_utc, s.ts_event AS entry_time, e.ts_event AS exit_time, s.close AS entry_price, e.close AS exit_price,
  s.signal AS direction, 1 AS size{more}
FROM {src} s JOIN {src} e ON {on} AND e.i > s.i
WHERE s.signal <> 0 AND s.signal <> coalesce(s.prev, 0) AND (e.signal <> e.prev OR e.i = e.n)
QUALIFY row_number() OVER (PARTITION BY {cols}, s.date_utc, s.i ORDER BY e.i) = 1"""


CTES["tr"] = run_sql("sn", "symbol")
CTES["pnl"] = """
SELECT *, (exit_price - entry_price) * direction AS gross_pnl_points, size * 14.5 AS costs,
  (exit_price - entry_price) * direction * 20 * size AS gross_pnl, (exit_price - entry_price) * direction * 20 * size - 14.5 * size AS net_pnl,
  (epoch_us(exit_time) // 1000000 - epoch_us(entry_time) // 1000000) / 60 AS holding_time_min, CAST(exit_time AS DATE) AS xd FROM tr"""


def metric_sql(src: str, keys: str) -> str:
    """Metrics with the weekday calendar built row by row."""
    return f"""
WITH src AS (SELECT * FROM {src}),
dd AS (SELECT {keys}, xd, sum(net_pnl) AS x FROM src GROUP BY ALL),
sp AS (SELECT {keys}, CAST(unnest(generate_series(min(xd), max(xd), INTERVAL 1 DAY)) AS DATE) AS xd FROM dd GROUP BY {keys}),
cal AS (SELECT {keys}, xd, sum(x) AS x FROM (SELECT * FROM dd UNION ALL SELECT {keys}, xd, 0 FROM sp WHERE isodow(xd) <= 5) GROUP BY ALL),
sh AS (SELECT {keys}, CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(252) END AS sharpe_ratio,
         count(*) FILTER (x > 0) / count(*) AS positive_day_fraction,
         CASE WHEN sum(abs(x)) > 0 THEN max(abs(x)) / sum(abs(x)) ELSE 1 END AS max_day_concentration FROM cal GROUP BY ALL),
eq AS (SELECT *, sum(net_pnl) OVER (PARTITION BY {keys} ORDER BY exit_time, entry_time ROWS UNBOUNDED PRECEDING) AS e FROM src),
hi AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY {keys} ORDER BY exit_time, entry_time ROWS UNBOUNDED PRECEDING)) AS h FROM eq)
SELECT {keys}, count(*) AS trade_count, count(*) FILTER (net_pnl > 0) AS win_count, count(*) FILTER (net_pnl < 0) AS loss_count,
  count(*) FILTER (net_pnl > 0) / count(*) AS win_rate, sum(gross_pnl) AS gross_pnl, sum(costs) AS total_costs, sum(net_pnl) AS net_pnl,
  avg(net_pnl) AS avg_trade_pnl, coalesce(max(net_pnl) FILTER (net_pnl > 0), 0) AS max_win,
  coalesce(min(net_pnl) FILTER (net_pnl < 0), 0) AS max_loss,
  CASE WHEN count(*) FILTER (net_pnl < 0) > 0 THEN coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / -sum(net_pnl) FILTER (net_pnl < 0)
    WHEN count(*) FILTER (net_pnl > 0) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS profit_factor,
  any_value(sharpe_ratio) AS sharpe_ratio, greatest(max(h - e), 0) AS max_drawdown, greatest(max((h - e) / (h + 100000) * 100), 0) AS max_drawdown_pct,
  avg(holding_time_min) AS avg_holding_time_min, avg(holding_time_min) / 5 AS avg_bars_held,
  any_value(positive_day_fraction) AS positive_day_fraction, any_value(max_day_concentration) AS max_day_concentration,
  avg(net_pnl) FILTER (direction > 0) AS long_avg_trade_pnl, avg(net_pnl) FILTER (direction < 0) AS short_avg_trade_pnl
FROM hi JOIN sh USING ({keys}) GROUP BY {keys}"""


METRIC_SPEC = " ".join(f"{m}:{'i' if m in ('trade_count', 'win_count', 'loss_count') else 'd'}" for m in L.METRICS)

add("signal_conditions", "symbol:s ts_event:t seq:i signal:i", signal_bars, "SELECT * FROM sig")
add("safe_numeric_column", "symbol:s ts_event:t safe_close:d safe_missing:d safe_ratio:d",
    lambda x: signal_bars(x).withColumn("_bad", F.when(F.col("signal") == 0, float("nan")).otherwise(F.col("close"))).transform(
        lambda d: d.withColumns({"safe_close": T.safe_double(d, "close"), "safe_missing": T.safe_double(d, "absent", -1.0),
                                 "safe_ratio": T.safe_double(d, "_bad", 7.0)})), """
SELECT *, close AS safe_close, -1 AS safe_missing, CASE WHEN signal = 0 THEN 7 ELSE close END AS safe_ratio FROM sig""")
add("session_start_flag", "symbol:s ts_event:t session_start:i",
    lambda x: T.session_start(x.bars()).withColumn("session_start", F.col("session_start").cast("int")),
    f"SELECT *, CASE WHEN row_number() OVER s = 1 THEN 1 ELSE 0 END AS session_start FROM b {W}")
add("signal_contract", "row_count:i missing:i out_of_range:i expected_rows:i valid:i",
    lambda x: T.check_signal(signal_bars(x), x.bars()).withColumn("valid", F.col("valid").cast("int")),
    "SELECT count(*) AS row_count, 0 AS missing, 0 AS out_of_range, (SELECT count(*) FROM b) AS expected_rows, 1 AS valid FROM sig")
add("run_trades", TRADE, lambda x: T.run_trades(signal_bars(x), KEYS), "SELECT * FROM tr")

CTES["dl"] = """
SELECT symbol, date_utc, lag(CASE WHEN coalesce(pv, 0) = 0 THEN sg ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date_utc) AS carry
FROM (SELECT symbol, date_utc, last(signal ORDER BY i) AS sg, last(prev ORDER BY i) AS pv FROM sn GROUP BY ALL)"""
CTES["nx"] = """
SELECT sn.*, coalesce(CASE WHEN i = 1 THEN carry END, 0) AS carry_in, lead(ts_event) OVER d AS nts, lead(open) OVER d AS nop
FROM sn JOIN dl USING (symbol, date_utc) WINDOW d AS (PARTITION BY symbol, date_utc ORDER BY i)"""
CTES["tn"] = """
SELECT s.symbol, CASE WHEN s.carry_in = s.signal THEN s.ts_event ELSE s.nts END AS entry_time, e.ts_event AS exit_time,
  CASE WHEN s.carry_in = s.signal THEN s.open ELSE s.nop END AS entry_price, e.close AS exit_price, s.signal AS direction, 1 AS size
FROM nx s JOIN nx e ON e.symbol = s.symbol AND e.date_utc = s.date_utc AND e.i > s.i
WHERE s.signal <> 0 AND s.signal <> coalesce(s.prev, 0) AND (e.signal <> e.prev OR e.i = e.n)
QUALIFY row_number() OVER (PARTITION BY s.symbol, s.date_utc, s.i ORDER BY e.i) = 1
UNION ALL SELECT symbol, ts_event, ts_event, open, close, carry_in, 1 FROM nx WHERE carry_in <> 0 AND (carry_in <> signal OR n = 1)"""
add("next_open_trades", TRADE, lambda x: T.next_open_trades(signal_bars(x), KEYS), "SELECT * FROM tn")

EVENT = "symbol:s signal_time:t entry_time:t entry_price:d direction:i"
CTES["ev"] = """
SELECT symbol, date_utc, i, n, ts_event AS signal_time, ts_event AS entry_time, close AS entry_price, signal AS direction
FROM sn WHERE signal <> 0 AND signal <> coalesce(prev, 0) AND i < n"""
CTES["evn"] = """
WITH turn AS (SELECT *, signal <> 0 AND signal <> coalesce(prev, 0) AS t FROM nx),
last_bar AS (SELECT symbol, date_utc, ts_event AS lts FROM sn WHERE i = n),
pd AS (SELECT symbol, date_utc, lag(lts) OVER (PARTITION BY symbol ORDER BY date_utc) AS plts FROM last_bar)
SELECT symbol, date_utc, i, n, plts AS signal_time, ts_event AS entry_time, open AS entry_price, carry_in AS direction
FROM nx JOIN pd USING (symbol, date_utc) WHERE carry_in <> 0
UNION ALL
SELECT e.symbol, e.date_utc, e.i, e.n, s.ts_event, e.ts_event, e.open, s.signal FROM turn s JOIN nx e
  ON e.symbol = s.symbol AND e.date_utc = s.date_utc AND e.i = s.i + 1 WHERE s.t AND NOT (s.i = 1 AND s.carry_in = s.signal)"""
for _n, _open, _cte in (("entry_events", False, "ev"), ("entry_events_next_open", True, "evn")):
    add(_n, EVENT, lambda x, o=_open: T.entry_events(signal_bars(x), KEYS, o), f"SELECT * FROM {_cte}")
    add(_n.replace("entry_events", "horizon_trades"), f"{TRADE} horizon_bars:i",
        lambda x, o=_open: T.horizon_trades(signal_bars(x), KEYS, [1, 3, 6], o), f"""
SELECT v.symbol, entry_time, s.ts_event AS exit_time, entry_price, s.close AS exit_price, direction, 1 AS size, h AS horizon_bars
FROM {_cte} v CROSS JOIN (VALUES (1), (3), (6)) AS hs(h) JOIN sn s ON s.symbol = v.symbol AND s.date_utc = v.date_utc
  AND s.i = v.i + h - {int(_open)}""")

CTES["ft"] = """
SELECT v.*, x.ts_event AS exit_time, x.i AS xi, x.stop_hit, x.open AS xo, x.close AS xc, x.tgt_hit,
  v.entry_price - direction * 2 AS stop_px, v.entry_price + direction * 3 AS target_px
FROM ev v JOIN LATERAL (SELECT s.*, CASE WHEN v.direction > 0 THEN s.low <= v.entry_price - 2 ELSE s.high >= v.entry_price + 2 END AS stop_hit,
    CASE WHEN v.direction > 0 THEN s.high >= v.entry_price + 3 ELSE s.low <= v.entry_price - 3 END AS tgt_hit
  FROM sn s WHERE s.symbol = v.symbol AND s.date_utc = v.date_utc AND s.i > v.i) x ON true
WHERE x.stop_hit OR x.tgt_hit OR x.i = x.n OR x.i - v.i >= 8
QUALIFY row_number() OVER (PARTITION BY v.symbol, v.entry_time ORDER BY x.i) = 1"""
add("first_touch_barriers", f"{TRADE} exit_reason:s",
    lambda x: T.first_touch(signal_bars(x), T.entry_events(signal_bars(x), KEYS, False), KEYS, 3.0, 2.0, 8), """
SELECT *, 1 AS size, CASE WHEN stop_hit THEN CASE WHEN direction > 0 THEN least(stop_px, xo) ELSE greatest(stop_px, xo) END
    WHEN tgt_hit THEN target_px ELSE xc END AS exit_price,
  CASE WHEN stop_hit THEN 'stop' WHEN tgt_hit THEN 'target' ELSE 'time' END AS exit_reason FROM ft""")

CTES["ftn"] = """
SELECT v.*, x.ts_event AS exit_time, x.stop_hit, x.open AS xo, x.close AS xc, x.tgt_hit, v.entry_price - direction * 2 AS stop_px, v.entry_price + direction * 3 AS target_px
FROM evn v JOIN LATERAL (SELECT s.*, CASE WHEN v.direction > 0 THEN s.low <= v.entry_price - 2 ELSE s.high >= v.entry_price + 2 END AS stop_hit,
    CASE WHEN v.direction > 0 THEN s.high >= v.entry_price + 3 ELSE s.low <= v.entry_price - 3 END AS tgt_hit
  FROM sn s WHERE s.symbol = v.symbol AND s.date_utc = CAST(v.entry_time AS DATE) AND s.ts_event >= v.entry_time) x ON true
WHERE x.stop_hit OR x.tgt_hit OR x.i = x.n QUALIFY row_number() OVER (PARTITION BY v.symbol, v.entry_time ORDER BY x.i) = 1"""
add("first_touch_next_open", f"{TRADE} exit_reason:s",
    lambda x: T.first_touch(signal_bars(x), T.entry_events(signal_bars(x), KEYS, True), KEYS, 3.0, 2.0, with_fill_bar=True), """
SELECT *, 1 AS size, CASE WHEN stop_hit THEN CASE WHEN direction > 0 THEN least(stop_px, xo) ELSE greatest(stop_px, xo) END WHEN tgt_hit THEN target_px ELSE xc END AS exit_price,
  CASE WHEN stop_hit THEN 'stop' WHEN tgt_hit THEN 'target' ELSE 'time' END AS exit_reason FROM ftn""")
add("first_touch_stop_only", f"{TRADE} exit_reason:s",
    lambda x: T.first_touch(signal_bars(x), T.entry_events(signal_bars(x), KEYS, True), KEYS, None, 2.0, with_fill_bar=True), """
WITH f AS (SELECT v.*, x.ts_event AS exit_time, x.stop_hit, x.open AS xo, x.close AS xc, v.entry_price - direction * 2 AS stop_px
  FROM evn v JOIN LATERAL (SELECT s.*, CASE WHEN v.direction > 0 THEN s.low <= v.entry_price - 2 ELSE s.high >= v.entry_price + 2 END AS stop_hit
    FROM sn s WHERE s.symbol = v.symbol AND s.date_utc = CAST(v.entry_time AS DATE) AND s.ts_event >= v.entry_time) x ON true
  WHERE x.stop_hit OR x.i = x.n QUALIFY row_number() OVER (PARTITION BY v.symbol, v.entry_time ORDER BY x.i) = 1)
SELECT *, 1 AS size, CASE WHEN stop_hit THEN CASE WHEN direction > 0 THEN least(stop_px, xo) ELSE greatest(stop_px, xo) END ELSE xc END AS exit_price,
  CASE WHEN stop_hit THEN 'stop' ELSE 'time' END AS exit_reason FROM f""")

# --- money
add("trade_pnl", "symbol:s entry_time:t exit_time:t gross_pnl_points:d costs:d gross_pnl:d net_pnl:d holding_time_min:d",
    lambda x: L.trade_pnl(T.run_trades(signal_bars(x), KEYS)), "SELECT * FROM pnl")
CTES["dsp"] = """
SELECT symbol, CAST(unnest(generate_series(min(xd), max(xd), INTERVAL 1 DAY)) AS DATE) AS date FROM pnl GROUP BY symbol"""
add("daily_pnl", "symbol:s date:D net_pnl:d", lambda x: L.daily_pnl(L.trade_pnl(T.run_trades(signal_bars(x), KEYS)), KEYS), """
SELECT symbol, date, sum(v) AS net_pnl FROM (SELECT symbol, xd AS date, net_pnl AS v FROM pnl
  UNION ALL SELECT symbol, date, 0 FROM dsp WHERE isodow(date) <= 5) GROUP BY ALL""")
add("daily_trade_counts", "symbol:s date:D trade_count:i", lambda x: L.daily_trade_counts(T.run_trades(signal_bars(x), KEYS), KEYS), """
SELECT symbol, date, sum(v) AS trade_count FROM (SELECT symbol, xd AS date, 1 AS v FROM pnl
  UNION ALL SELECT symbol, date, 0 FROM dsp WHERE isodow(date) <= 5) GROUP BY ALL""")
add("strategy_metrics", f"symbol:s {METRIC_SPEC}", lambda x: L.metrics(T.run_trades(signal_bars(x), KEYS), KEYS),
    "SELECT * FROM (" + metric_sql("pnl", "symbol") + ")")
add("day_edge_stats", "symbol:s positive_day_fraction:d max_day_concentration:d long_avg_trade_pnl:d short_avg_trade_pnl:d",
    lambda x: L.metrics(T.run_trades(signal_bars(x), KEYS), KEYS), "SELECT * FROM (" + metric_sql("pnl", "symbol") + ")")



def _mz(c: str) -> str:
    return (f"CASE WHEN count({c}) OVER {fr(50)} >= 2 AND stddev_samp({c}) OVER {fr(50)} > 0 THEN coalesce(({c} - avg({c}) OVER {fr(50)}) / "
            f"stddev_samp({c}) OVER {fr(50)}, NULL) ELSE 0 END")


_COST = """greatest(4.5, 4.5 + 2 * greatest(2.5, 5 + 0.5 * greatest(volatility_z, 0) * 5 + greatest(spread_ticks - 1, 0) * 5
  - 0.1 * greatest(volume_z, 0) * 5 + 0.2 * 4 * (rth_progress - 0.5) ** 2 * 5))"""


def state_ctes(name: str, src: str, keys: str) -> None:
    """CTE ``name``: the rows of ``src`` with their market state and ``bar_cost``, rolling windows restarting on ``keys``."""
    a = f"WINDOW s AS (PARTITION BY {keys} ORDER BY ts_event, seq)"
    CTES[f"{name}1"] = f"SELECT *, close / lag(close) OVER s - 1 AS ret FROM {src} {a}"
    CTES[f"{name}2"] = f"SELECT *, CASE WHEN count(ret) OVER {fr(50)} >= 2 THEN stddev_samp(ret) OVER {fr(50)} END AS vol FROM {name}1 {a}"
    CTES[name] = f"""
SELECT *, {_COST} AS bar_cost FROM (SELECT *, (ask_price - bid_price) / 0.25 AS spread_ticks, {_mz('vol')} AS volatility_z, {_mz('volume')} AS volume_z,
  CASE WHEN epoch_us(ts_event - INTERVAL 5 HOUR) // 60000000 % 1440 BETWEEN 570 AND 960
    THEN (epoch_us(ts_event - INTERVAL 5 HOUR) // 60000000 % 1440 - 570) / 390 ELSE 0.5 END AS rth_progress FROM {name}2 {a})"""


state_ctes("ms", "b", "symbol")
add("cost_market_state", "symbol:s ts_event:t spread_ticks:d volatility_z:d volume_z:d rth_progress:d",
    lambda x: L.market_state(x.bars()), "SELECT * FROM ms")
CTES["late"] = "SELECT * REPLACE (entry_time - INTERVAL 90 MINUTE AS entry_time) FROM tr"
CTES["asof_j"] = """
SELECT l.*, coalesce(spread_ticks, 1) AS spread_ticks, coalesce(volatility_z, 0) AS volatility_z, coalesce(volume_z, 0) AS volume_z,
  coalesce(rth_progress, 0.5) AS rth_progress
FROM late l ASOF LEFT JOIN (SELECT symbol, ts_event, spread_ticks, volatility_z, volume_z, rth_progress FROM ms) m
  ON m.symbol = l.symbol AND l.entry_time >= m.ts_event"""


def _shifted(x):
    return T.run_trades(signal_bars(x), KEYS).withColumn("entry_time", F.col("entry_time") - F.expr("interval 90 minutes"))


add("asof_market_state", "symbol:s entry_time:t exit_time:t spread_ticks:d volatility_z:d volume_z:d rth_progress:d",
    lambda x: L.asof_state(_shifted(x), L.market_state(x.stored_bars())), "SELECT * FROM asof_j")
add("adaptive_round_trip_cost", "symbol:s entry_time:t exit_time:t adaptive_cost_rt:d",
    lambda x: L.adaptive_costs(_shifted(x), x.stored_bars()), f"SELECT *, {_COST} AS adaptive_cost_rt FROM asof_j")
CTES["ac"] = f"""
SELECT *, (exit_price - entry_price) * direction * 20 AS gross_pnl, (exit_price - entry_price) * direction * 20 - costs AS net_pnl,
  (epoch_us(exit_time) // 1000000 - epoch_us(entry_time) // 1000000) / 60 AS holding_time_min, CAST(exit_time AS DATE) AS xd
FROM (SELECT tr.*, {_COST} AS costs FROM tr JOIN ms ON ms.symbol = tr.symbol AND ms.ts_event = tr.entry_time)"""
add("scored_with_costs", f"symbol:s {METRIC_SPEC}",
    lambda x: L.score(T.run_trades(signal_bars(x), KEYS), x.stored_bars(), KEYS), "SELECT * FROM (" + metric_sql("ac", "symbol") + ")")
