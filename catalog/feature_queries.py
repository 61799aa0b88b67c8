"""Per-bar features in session and context scope."""

from __future__ import annotations

from barflow.operators import book as K
from barflow.operators import flow as O
from barflow.operators import momentum as M
from barflow.operators import statistical as S
from barflow.plans.context import trim_context, with_context

from .bar_queries import KEY
from .base import CTES, add

W = "WINDOW s AS (PARTITION BY symbol, session_date ORDER BY ts_event, seq)"


def fr(n: int) -> str:
    return f"(s ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def near(x: str, n: int, q: float, frame: str | None = None) -> str:
    l = f"list_sort(list({x}) OVER {frame or fr(n)})"
    return f"{l}[CAST(floor({q} * (len({l}) - 1) + 0.5) AS BIGINT) + 1]"


def z(x: str, n: int, eps: str = "0") -> str:
    return (f"CASE WHEN stddev_samp({x}) OVER {fr(n)} > {eps} THEN ({x} - avg({x}) OVER {fr(n)}) / "
            f"stddev_samp({x}) OVER {fr(n)} ELSE 0 END")


# --- momentum, labels, time of day, opening range
CTES["mom1"] = f"""
SELECT *, CASE WHEN row_number() OVER s = 1 THEN 0 WHEN abs(lag(close) OVER s) > 1e-12
  THEN close / lag(close) OVER s - 1 END AS return_1bar,
  (close - vwap) / (vwap + 0.0001) AS vwap_deviation, (high - low) / (close + 0.0001) AS high_low_range,
  avg(volume) OVER {fr(5)} AS volume_ma5 FROM b {W}"""
CTES["mom"] = f"""
SELECT *, sum(return_1bar) OVER {fr(5)} AS return_5bar, sum(return_1bar) OVER {fr(12)} AS return_12bar,
  avg(vwap_deviation) OVER {fr(5)} AS vwap_deviation_ma5, avg(high_low_range) OVER {fr(5)} AS range_ma5,
  volume / (volume_ma5 + 0.0001) AS volume_ratio, return_1bar * volume AS momentum_volume,
  CASE WHEN high - low < 0.0001 THEN 0.5 ELSE (close - low) / (high - low + 0.0001) END AS close_position,
  CASE WHEN high - low < 0.0001 THEN 0 ELSE (high - greatest(open, close)) / (high - low + 1e-9) END AS upper_wick_ratio,
  CASE WHEN high - low < 0.0001 THEN 0 ELSE (least(open, close) - low) / (high - low + 1e-9) END AS lower_wick_ratio,
  CASE WHEN high - low < 0.0001 THEN 0 ELSE abs(close - open) / (high - low + 1e-9) END AS body_ratio
FROM mom1 {W}"""
for _name, _cols in (
        ("bar_return", "return_1bar:d"), ("rolling_returns", "return_5bar:d return_12bar:d"),
        ("vwap_deviation", "vwap_deviation:d vwap_deviation_ma5:d"), ("bar_range", "high_low_range:d range_ma5:d"),
        ("volume_momentum", "volume_ma5:d volume_ratio:d momentum_volume:d"),
        ("candle_geometry", "close_position:d upper_wick_ratio:d lower_wick_ratio:d body_ratio:d")):
    add(_name, f"{KEY} {_cols}", lambda x: M.momentum(x.bars()), "SELECT * FROM mom")

_fwd = ", ".join(f"(lead(close, {n}) OVER s - close) / nullif(close, 0) AS fwd_return_{n}bar" for n in M.LABEL_HORIZONS)
CTES["lab1"] = f"SELECT symbol, session_date, ts_event, seq, {_fwd} FROM b {W}"
CTES["lab"] = "SELECT *, " + ", ".join(
    f"CAST(fwd_return_{n}bar > 0 AS INT) AS label_{n}bar" for n in M.CLASS_HORIZONS) + " FROM lab1"
add("forward_labels", KEY + "".join(f" fwd_return_{n}bar:d" for n in M.LABEL_HORIZONS)
    + "".join(f" label_{n}bar:d" for n in M.CLASS_HORIZONS), lambda x: M.labels(x.bars()), "SELECT * FROM lab")

CTES["tod"] = """
SELECT *, CAST(epoch_us(ts_event - INTERVAL 5 HOUR) // 60000000 % 1440 - 570 AS DOUBLE) AS minutes_since_open FROM b"""
add("time_of_day", f"{KEY} minutes_since_open:d session_progress:d is_power_hour:d is_london_session:d",
    lambda x: M.time_of_day(x.bars()), """
SELECT *, minutes_since_open / 390 AS session_progress,
  CASE WHEN minutes_since_open BETWEEN 0 AND 89 THEN 1 ELSE 0 END AS is_power_hour,
  CASE WHEN minutes_since_open < 0 THEN 1 ELSE 0 END AS is_london_session FROM tod""")

CTES["orr"] = """
WITH t AS (SELECT *, epoch_us(ts_event - INTERVAL 5 HOUR) // 60000000 % 1440 - 570 AS since FROM bars_30),
r AS (SELECT symbol, session_date, max(high) AS oh, min(low) AS ol FROM t WHERE since BETWEEN 0 AND 29 GROUP BY ALL)
SELECT t.*, CASE WHEN since >= 30 THEN oh END AS oh, CASE WHEN since >= 30 THEN ol END AS ol
FROM t LEFT JOIN r USING (symbol, session_date)"""
add("opening_range", f"{KEY} or_width:d position_in_or:d or_broken_up:d or_broken_down:d",
    lambda x: M.opening_range(x.bars("time_30m")), """
SELECT symbol, session_date, ts_event, seq, (oh - ol) / ((oh + ol) / 2) AS or_width,
  CASE WHEN oh = ol THEN 0.5 ELSE (close - ol) / (oh - ol) END AS position_in_or,
  CASE WHEN since < 30 THEN NULL WHEN close > oh THEN 1 ELSE 0 END AS or_broken_up,
  CASE WHEN since < 30 THEN NULL WHEN close < ol THEN 1 ELSE 0 END AS or_broken_down FROM orr""")

# --- order flow
CTES["flow"] = f"""
SELECT *, (buy_volume - sell_volume) / (buy_volume + sell_volume + 1) AS volume_imbalance,
  buy_volume - sell_volume AS volume_delta,
  trade_count / (bar_duration_ns / 1e9 + 1e-9) AS trade_intensity, large_trade_count / (trade_count + 1) AS large_trade_ratio,
  greatest(buy_volume, sell_volume) / (volume + 1) AS orderflow_ratio,
  sum(buy_volume - sell_volume) OVER {fr(5)} AS order_flow_imbalance,
  CASE WHEN sign(sum(buy_volume - sell_volume) OVER {fr(3)}) <> sign(close - lag(close, 3) OVER s) THEN 1 ELSE 0 END
    AS cvd_price_divergence_3,
  CASE WHEN sign(sum(buy_volume - sell_volume) OVER {fr(6)}) <> sign(close - lag(close, 6) OVER s) THEN 1 ELSE 0 END
    AS cvd_price_divergence_6,
  volume * abs(buy_volume - sell_volume) / (round((high - low) / 0.25) + 1) AS absorption_factor,
  CASE WHEN volume > {near('volume', 12, 0.9)} AND high - low < {near('high - low', 12, 0.2)} THEN 1 ELSE 0 END
    AS absorption_signal
FROM b {W}"""
for _name, _cols in (
        ("orderflow_ratios", "volume_imbalance:d trade_intensity:d large_trade_ratio:d orderflow_ratio:d"),
        ("order_flow_imbalance", "order_flow_imbalance:i"),
        ("cvd_price_divergence", "cvd_price_divergence_3:d cvd_price_divergence_6:d"),
        ("absorption_factor", "absorption_factor:d"), ("absorption_signal", "absorption_signal:d")):
    add(_name, f"{KEY} {_cols}", lambda x: O.orderflow(x.bars()), "SELECT * FROM flow")

CTES["agg1"] = f"""
SELECT *, buy_volume - sell_volume AS volume_delta, sum(buy_volume - sell_volume) OVER s AS cvd, row_number() OVER s - 1 AS idx,
  (close - lag(close) OVER s) / (lag(close) OVER s + 0.25) AS ret FROM b {W}"""
CTES["agg2"] = f"""
SELECT *, (cvd - lag(cvd, 3) OVER s) / 3 AS cvd_slope_3, (cvd - lag(cvd, 6) OVER s) / 6 AS cvd_slope_6,
  (cvd - lag(cvd, 12) OVER s) / 12 AS cvd_slope_12,
  CASE WHEN idx >= 12 AND count(ret) OVER {fr(12)} >= 6 THEN corr(ret, volume_delta) OVER {fr(12)} END AS cvd_price_alignment,
  CASE WHEN (close - lag(close, 6) OVER s) * (cvd - lag(cvd, 6) OVER s) < 0 THEN 1 ELSE 0 END AS cvd_divergence_6,
  trade_count / avg(trade_count) OVER {fr(24)} AS relative_intensity,
  buy_volume / (buy_volume + sell_volume + 1) AS buy_sell_ratio, trade_count AS trade_intensity_aggressor,
  (large_buy_volume + large_sell_volume) / (buy_volume + sell_volume + 1) AS large_lot_fraction,
  (large_buy_volume - large_sell_volume) / (large_buy_volume + large_sell_volume + 1) AS large_lot_imbalance
FROM agg1 {W}"""
CTES["agg3"] = f"""
SELECT *, cvd_slope_3 - lag(cvd_slope_3, 3) OVER s AS cvd_accel_3, cvd_slope_6 - lag(cvd_slope_6, 6) OVER s AS cvd_accel_6
FROM agg2 {W}"""
for _name, _cols in (
        ("cumulative_delta", "volume_delta:i cvd:i"), ("cvd_divergence", "cvd_divergence_6:d"),
        ("cvd_slope_acceleration", "cvd_slope_3:d cvd_slope_6:d cvd_slope_12:d cvd_accel_3:d cvd_accel_6:d"),
        ("cvd_price_alignment", "cvd_price_alignment:d"),
        ("aggressor_ratios", "buy_sell_ratio:d trade_intensity_aggressor:d relative_intensity:d large_lot_fraction:d "
                             "large_lot_imbalance:d")):
    add(_name, f"{KEY} {_cols}", lambda x: O.aggressor(x.bars()), "SELECT * FROM agg3")

CTES["tox"] = f"""
SELECT *, CASE WHEN sd IS NULL THEN NULL WHEN sd > 0 THEN (vpin_toxicity - mu) / sd ELSE 0 END AS vpin_zscore,
  CASE WHEN vpin_toxicity > 0.7 THEN 1 ELSE 0 END AS vpin_risk_off
FROM (SELECT *, CASE WHEN count(*) OVER {fr(100)} >= 25 THEN stddev_samp(vpin_toxicity) OVER {fr(100)} END AS sd,
        avg(vpin_toxicity) OVER {fr(100)} AS mu
      FROM (SELECT *, avg(abs(buy_volume - sell_volume) / (buy_volume + sell_volume + 1)) OVER {fr(20)} AS vpin_toxicity
            FROM bars_30 {W}) {W})"""
add("session_vpin", f"{KEY} vpin_toxicity:d vpin_zscore:d vpin_risk_off:i",
    lambda x: O.toxicity(x.bars("time_30m")), "SELECT * FROM tox")

# --- book and messages
CTES["bk1"] = f"""
SELECT *, (bid_price + ask_price) / 2 AS mid_price, ask_price - bid_price AS spread,
  (ask_price - bid_price) / ((bid_price + ask_price) / 2) * 10000 AS spread_bps,
  (bid_size - ask_size) / (bid_size + ask_size + 1) AS book_imbalance, bid_count / (ask_count + 1) AS depth_ratio FROM b"""
CTES["bk2"] = f"""
SELECT *, avg(book_imbalance) OVER {fr(5)} AS book_imbalance_ma5,
  coalesce(stddev_samp(spread) OVER {fr(5)}, 0) AS spread_volatility,
  CASE WHEN row_number() OVER s = 1 THEN 0 WHEN lag(mid_price) OVER s > 0
    THEN (mid_price - lag(mid_price) OVER s) / lag(mid_price) OVER s END AS mid_price_return FROM bk1 {W}"""
CTES["bk"] = f"SELECT *, sum(mid_price_return) OVER {fr(5)} AS mid_price_return_5 FROM bk2 {W}"
for _name, _cols in (
        ("book_state", "mid_price:d spread:d spread_bps:d book_imbalance:d depth_ratio:d"),
        ("book_rolling", "book_imbalance_ma5:d spread_volatility:d mid_price_return:d mid_price_return_5:d")):
    add(_name, f"{KEY} {_cols}", lambda x: K.book(x.bars()), "SELECT * FROM bk")

CTES["mic1"] = f"""
SELECT *, cancel_count / (trade_count + 1) AS cancel_trade_ratio, modify_count / (trade_count + 1) AS modify_trade_ratio,
  CASE WHEN trade_count > 1 THEN bar_duration_ns / (trade_count - 1) / 1000 END AS mean_trade_interval_us,
  avg(msg_count) OVER {fr(5)} AS message_intensity_ma5,
  CASE WHEN lag(cancel_count) OVER s > 0 THEN (cancel_count - lag(cancel_count) OVER s) / lag(cancel_count) OVER s END
    AS cancel_rate_change,
  trade_count / (bar_duration_ns / 1e6 + 1e-9) AS tape_speed,
  abs(close - open) / (bar_duration_ns / 1e9 + 1e-9) AS price_velocity,
  lag(close - open) OVER s AS prev_body, lag(close) OVER s AS prev_close FROM b {W}"""
CTES["mic2"] = f"SELECT *, {z('tape_speed', 24)} AS tape_speed_z, {z('price_velocity', 24)} AS price_velocity_z FROM mic1 {W}"
CTES["mic3"] = f"""
SELECT *, CASE WHEN tape_speed_z > 2.5 THEN 1 ELSE 0 END AS tape_speed_spike,
  CASE WHEN price_velocity_z > 3 THEN 1 ELSE 0 END AS is_whip,
  CASE WHEN lag(price_velocity_z) OVER s > 3 THEN abs(prev_close - close) / (abs(prev_body) + 1e-9) ELSE 0 END AS recoil_pct
FROM mic2 {W}"""
CTES["mic"] = "SELECT *, CASE WHEN recoil_pct > 0.4 AND recoil_pct < 0.7 THEN 1 ELSE 0 END AS recoil_50pct FROM mic3"
for _name, _cols in (
        ("message_features", "cancel_trade_ratio:d modify_trade_ratio:d mean_trade_interval_us:d latency_mean:d "
                             "message_intensity_ma5:d cancel_rate_change:d"),
        ("tape_speed", "tape_speed:d tape_speed_z:d tape_speed_spike:d"),
        ("price_velocity", "price_velocity:d price_velocity_z:d is_whip:d"),
        ("whip_recoil", "recoil_pct:d recoil_50pct:d")):
    add(_name, f"{KEY} {_cols}", lambda x: K.microstructure(x.bars()), "SELECT * FROM mic")

# --- context scope: every bar joined to the days it serves
CTES["days"] = "SELECT symbol, session_date, dense_rank() OVER (PARTITION BY symbol ORDER BY session_date) AS r FROM (SELECT DISTINCT symbol, session_date FROM b)"
CTES["ctx"] = """
SELECT b.*, t.session_date AS target_date
FROM b JOIN days d USING (symbol, session_date) JOIN days t ON t.symbol = b.symbol AND t.r BETWEEN d.r AND d.r + 4"""
WT = "WINDOW s AS (PARTITION BY symbol, target_date ORDER BY ts_event, seq)"


def in_context(build):
    return lambda x: trim_context(build(with_context(x.bars())))


CTES["arr"] = f"""
SELECT *, (buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0) AS trade_arrival_imbalance,
  avg(abs(buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0)) OVER {fr(20)} AS vpin,
  cancel_count / (trade_count + 1) AS cancel_ratio,
  (bid_size * bid_count - ask_size * ask_count) / (bid_size * bid_count + ask_size * ask_count + 1.0) AS weighted_book_imbalance,
  (micro - lag(micro) OVER s) / (lag(micro) OVER s + 1e-9) AS micro_price_momentum
FROM (SELECT *, (bid_price * ask_size + ask_price * bid_size) / (bid_size + ask_size + 1e-9) AS micro FROM ctx) {WT}"""
add("arrival_vpin", f"{KEY} trade_arrival_imbalance:d vpin:d",
    in_context(lambda d: K.arrival_context(K.arrival(d))), "SELECT * FROM arr WHERE session_date = target_date")
add("queue_imbalance_micro_price", f"{KEY} cancel_ratio:d weighted_book_imbalance:d micro_price_momentum:d",
    in_context(lambda d: K.arrival_context(K.arrival(d))), "SELECT * FROM arr WHERE session_date = target_date")

_PRE10, _PRE24 = "(s ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)", "(s ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
CTES["scalp1"] = f"""
SELECT *, CASE WHEN close < min(close) OVER {_PRE10} AND vd > min(vd) OVER {_PRE10} THEN 1 ELSE 0 END AS delta_divergence_bull,
  CASE WHEN close > max(close) OVER {_PRE10} AND vd < max(vd) OVER {_PRE10} THEN 1 ELSE 0 END AS delta_divergence_bear,
  volume / greatest(high - low, 0.25) AS effort_vs_result,
  CASE WHEN count(*) OVER {_PRE24} >= 5 AND volume > {near('volume', 24, 0.9, _PRE24)}
    AND high - low < {near('high - low', 24, 0.2, _PRE24)} THEN 1 ELSE 0 END AS absorption_signal_scalp,
  trade_count / greatest(bar_duration_ns / 1e9, 1) AS intensity
FROM (SELECT *, buy_volume - sell_volume AS vd FROM ctx) {WT}"""
CTES["scalp"] = f"""SELECT *, CASE WHEN intensity_z > 2.5 THEN 1 ELSE 0 END AS tape_speed_spike_scalp
FROM (SELECT *, {z('intensity', 20, '1e-9')} AS intensity_z FROM scalp1 {WT}) WHERE session_date = target_date"""
add("scalping_divergence", f"{KEY} delta_divergence_bull:d delta_divergence_bear:d", in_context(O.scalping),
    "SELECT * FROM scalp")
add("scalping_effort_intensity", f"{KEY} effort_vs_result:d absorption_signal_scalp:d intensity:d intensity_z:d "
    "tape_speed_spike_scalp:d", in_context(O.scalping), "SELECT * FROM scalp")

# --- footprint features
CTES["foot1"] = f"""
SELECT *, stacked_imbalance_count * stacked_imbalance_direction AS stacked_imb_strength,
  sign(stacked_imbalance_count * stacked_imbalance_direction) AS sg, row_number() OVER s AS rn,
  (buy_volume - sell_volume) / (bar_duration_ns / 1e9 + 1e-9) AS delta_per_second FROM b {W}"""
CTES["foot2"] = f"""
SELECT *, sum(brk) OVER s AS grp FROM (
  SELECT *, CASE WHEN sg <> coalesce(lag(sg) OVER s, 0) THEN 1 ELSE 0 END AS brk FROM foot1 {W}) {W}"""
CTES["foot"] = f"""
SELECT *, avg(stacked_imb_strength) OVER {fr(3)} AS stacked_imb_ma3,
  CASE WHEN sg <> 0 THEN row_number() OVER (PARTITION BY symbol, session_date, grp ORDER BY ts_event, seq) ELSE 0 END
    AS stacked_imb_streak,
  CASE WHEN zero_print_count > {near('zero_print_count', 24, 0.75)} THEN 1 ELSE 0 END AS zero_print_expansion,
  CASE WHEN zero_print_count > 0 THEN sign(close - open) ELSE 0 END AS zero_print_direction,
  rn - max(CASE WHEN unfinished_high = 1 THEN rn END) OVER s AS bars_since_unfinished_high,
  rn - max(CASE WHEN unfinished_low = 1 THEN rn END) OVER s AS bars_since_unfinished_low,
  zero_print_ratio AS fp_zero_print_ratio, unfinished_high AS fp_unfinished_high, unfinished_low AS fp_unfinished_low,
  {z('delta_per_second', 24)} AS delta_intensity_z, abs({z('delta_per_second', 24)}) AS delta_heat,
  max_level_volume / (volume + 1) AS max_level_vol_ratio, (volume_at_high + volume_at_low) / (volume + 1) AS high_low_vol_ratio,
  buy_vol_at_high / (buy_vol_at_high + sell_vol_at_high + 1) AS extreme_buy_ratio_high,
  buy_vol_at_low / (buy_vol_at_low + sell_vol_at_low + 1) AS extreme_buy_ratio_low,
  CASE WHEN sell_vol_at_high > buy_vol_at_high * 2 THEN 1 ELSE 0 END AS extreme_aggression_high,
  CASE WHEN buy_vol_at_low > sell_vol_at_low * 2 THEN 1 ELSE 0 END AS extreme_aggression_low
FROM foot2 {W}"""
for _name, _cols in (
        ("stacked_imbalance", "stacked_imb_strength:d stacked_imb_ma3:d"), ("stacked_streak", "stacked_imb_streak:d"),
        ("zero_prints", "zero_print_expansion:d zero_print_direction:d fp_zero_print_ratio:d fp_unfinished_high:d "
                        "fp_unfinished_low:d"),
        ("unfinished_business", "bars_since_unfinished_high:d bars_since_unfinished_low:d"),
        ("delta_heat", "delta_per_second:d delta_intensity_z:d delta_heat:d"),
        ("extreme_aggression", "max_level_vol_ratio:d high_low_vol_ratio:d extreme_buy_ratio_high:d "
                               "extreme_buy_ratio_low:d extreme_aggression_high:d extreme_aggression_low:d")):
    add(_name, f"{KEY} {_cols}", lambda x: K.footprint(x.bars()), "SELECT * FROM foot")

# --- statistical
CTES["stat1"] = f"""
SELECT *, CASE WHEN row_number() OVER s = 1 THEN 0 ELSE ln(close) - ln(lag(close) OVER s) END AS log_return,
  ln(open / lag(close) OVER s) AS gap, ln(close / lag(close) OVER s) AS cc,
  ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close) AS rs,
  close - sum(vwap * volume) OVER s / sum(volume) OVER s AS vwap_deviation_stat FROM bars_30 {W}"""
_K = 0.34 / (1.34 + 21 / 19)
CTES["stat2"] = f"""
SELECT *, CASE WHEN v > 0 THEN sqrt(v) ELSE 0 END AS yz_volatility FROM (
  SELECT *, CASE WHEN count(gap) OVER {fr(20)} >= 20 THEN var_samp(gap) OVER {fr(20)} + {_K} * var_samp(cc) OVER {fr(20)}
    + {1 - _K} * avg(rs) OVER {fr(20)} END AS v FROM stat1 {W})"""
CTES["stat"] = f"""SELECT *, {z('yz_volatility', 50, '1e-12')} AS vol_zscore, {z('vwap_deviation_stat', 24, '1e-12')} AS vwap_dev_zscore
FROM stat2 {W}"""
for _name, _cols in (("log_return", "log_return:d"), ("yang_zhang_volatility", "yz_volatility:d"),
                     ("volatility_vwap_zscores", "vol_zscore:d vwap_deviation_stat:d vwap_dev_zscore:d")):
    add(_name, f"{KEY} {_cols}", lambda x: S.statistical(x.bars("time_30m")), "SELECT * FROM stat")

_FD = "[" + ", ".join(repr(v) for v in reversed(S.fracdiff_weights(0.4, 50))) + "]"
add("fractional_difference", f"{KEY} fracdiff_close:d", in_context(S.fracdiff), f"""
SELECT *, CASE WHEN len(past) = 50 THEN list_sum(list_transform(list_zip(past, {_FD}), lambda p: p[1] * p[2])) END AS fracdiff_close
FROM (SELECT *, list(close) OVER {fr(50)} AS past FROM ctx {WT}) WHERE session_date = target_date""")

add("obv_slope", f"{KEY} obv_slope_14:d", lambda x: S.obv_slope(x.bars()), f"""
SELECT *, CASE WHEN n >= 14 AND flow > 1e-10 AND idx >= 14 THEN (obv - prev_obv) / flow
  WHEN n >= 14 AND flow > 1e-10 THEN NULL ELSE 0 END AS obv_slope_14 FROM (
  SELECT *, lag(obv, 14) OVER s AS prev_obv, sum(abs(sv)) OVER {fr(14)} AS flow, count(*) OVER {fr(14)} AS n,
    row_number() OVER s - 1 AS idx FROM (
    SELECT *, sum(sv) OVER s AS obv FROM (
      SELECT *, coalesce(sign(close - lag(close) OVER s) * volume, 0) AS sv FROM b {W}) {W}) {W})""")


# --- exponentially weighted indicators, by the closed form of the recurrence
def ewm(source: str, col: str, a: float, need: int, out: str) -> str:
    return f"""
SELECT y.symbol, y.target_date, y.rn, CASE WHEN count(*) >= {need} THEN
  sum(x.{col} * pow({1 - a!r}, y.rn - x.rn) * CASE WHEN x.rn = x.first_{col} THEN 1 ELSE {a!r} END) END AS {out}
FROM {source} y JOIN {source} x ON x.symbol = y.symbol AND x.target_date = y.target_date AND x.rn <= y.rn
  AND x.rn >= x.first_{col} AND x.{col} IS NOT NULL
WHERE y.session_date = y.target_date OR {int(out.startswith('k'))} = 1
GROUP BY y.symbol, y.target_date, y.rn"""


CTES["ind1"] = f"""
SELECT symbol, session_date, target_date, ts_event, seq, open, high, low, close, row_number() OVER s AS rn,
  close - lag(close) OVER s AS chg, high - lag(high) OVER s AS up, lag(low) OVER s - low AS dn,
  greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr FROM ctx {WT}"""
CTES["ind2"] = """
SELECT *, greatest(chg, 0) AS gain, CASE WHEN chg IS NULL THEN NULL ELSE greatest(-chg, 0) END AS loss,
  CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm,
  1 AS first_close, 1 AS first_tr, 1 AS first_pdm, 1 AS first_mdm, 2 AS first_gain, 2 AS first_loss FROM
  (SELECT * REPLACE (CASE WHEN rn = 1 THEN NULL ELSE chg END AS chg) FROM ind1)"""
_W = 1.0 / 14
for _o, _c, _a, _n in (("e8", "close", 2 / 9, 8), ("e21", "close", 2 / 22, 21), ("e50", "close", 2 / 51, 50),
                       ("k12", "close", 2 / 13, 12), ("k26", "close", 2 / 27, 26), ("ag", "gain", _W, 14),
                       ("al", "loss", _W, 14), ("katr", "tr", _W, 14), ("ksp", "pdm", _W, 14), ("ksm", "mdm", _W, 14)):
    CTES[f"ewm_{_o}"] = ewm("ind2", _c, _a, _n, _o)
CTES["macd1"] = """
SELECT i.symbol, i.session_date, i.target_date, i.rn, k12 - k26 AS line, 26 AS first_line
FROM ind2 i JOIN ewm_k12 USING (symbol, target_date, rn) JOIN ewm_k26 USING (symbol, target_date, rn)"""
CTES["ewm_sig"] = ewm("macd1", "line", 0.2, 9, "sig")
CTES["dx1"] = """
SELECT symbol, session_date, target_date, rn, close, katr, CASE WHEN katr > 1e-10 THEN ksp / katr * 100 END AS plus_di_14,
  CASE WHEN katr > 1e-10 THEN ksm / katr * 100 END AS minus_di_14
FROM ind2 JOIN ewm_katr USING (symbol, target_date, rn) JOIN ewm_ksp USING (symbol, target_date, rn)
  JOIN ewm_ksm USING (symbol, target_date, rn)"""
CTES["dx2"] = "SELECT *, abs(plus_di_14 - minus_di_14) / (plus_di_14 + minus_di_14 + 1e-10) * 100 AS dx, 14 AS first_dx FROM dx1"
CTES["ewm_adx"] = ewm("dx2", "dx", _W, 14, "adx")
_OWN = "WHERE session_date = target_date"


def own(build):
    return lambda x: trim_context(build(with_context(x.bars())))


def sma(n: int) -> str:
    return f"CASE WHEN count(*) OVER {fr(n)} >= {n} THEN close / avg(close) OVER {fr(n)} - 1 END AS sma_ratio_{n}"


add("sma_ratios", f"{KEY} sma_ratio_8:d sma_ratio_21:d sma_ratio_50:d sma_ratio_200:d", own(S.indicators),
    f"SELECT * FROM (SELECT *, {sma(8)}, {sma(21)}, {sma(50)}, {sma(200)} FROM ctx {WT}) {_OWN}")
add("ema_ratios", f"{KEY} ema_ratio_8:d ema_ratio_21:d ema_ratio_50:d", own(S.indicators), f"""
SELECT *, close / e8 - 1 AS ema_ratio_8, close / e21 - 1 AS ema_ratio_21, close / e50 - 1 AS ema_ratio_50 FROM ind2
LEFT JOIN ewm_e8 USING (symbol, target_date, rn) LEFT JOIN ewm_e21 USING (symbol, target_date, rn)
LEFT JOIN ewm_e50 USING (symbol, target_date, rn) {_OWN}""")
add("rsi", f"{KEY} rsi_14:d", own(S.indicators), f"""
SELECT *, 100 - 100 / (1 + ag / (al + 1e-10)) AS rsi_14 FROM ind2 LEFT JOIN ewm_ag USING (symbol, target_date, rn)
LEFT JOIN ewm_al USING (symbol, target_date, rn) {_OWN}""")
add("atr", f"{KEY} atr_norm_14:d", own(S.indicators), f"""
SELECT *, katr / (close + 1e-10) AS atr_norm_14 FROM ind2 LEFT JOIN ewm_katr USING (symbol, target_date, rn) {_OWN}""")
add("bollinger", f"{KEY} bb_bandwidth_20:d bb_pctb_20:d", own(S.indicators), f"""
SELECT *, 4 * sd / (mu + 1e-10) AS bb_bandwidth_20, (close - (mu - 2 * sd)) / (4 * sd + 1e-10) AS bb_pctb_20 FROM (
  SELECT *, CASE WHEN count(*) OVER {fr(20)} >= 20 THEN avg(close) OVER {fr(20)} END AS mu,
    stddev_samp(close) OVER {fr(20)} AS sd FROM ctx {WT}) {_OWN}""")
add("macd", f"{KEY} macd_norm:d macd_signal_norm:d macd_hist_norm:d", own(S.indicators), f"""
SELECT i.*, line / (close + 1e-10) AS macd_norm, sig / (close + 1e-10) AS macd_signal_norm,
  (line - sig) / (close + 1e-10) AS macd_hist_norm
FROM ind2 i LEFT JOIN macd1 m USING (symbol, target_date, rn) LEFT JOIN ewm_sig USING (symbol, target_date, rn)
WHERE i.session_date = i.target_date""")
add("stochastic", f"{KEY} stoch_k_14:d stoch_d_14:d", own(S.indicators), f"""
SELECT *, CASE WHEN count(k) OVER {fr(3)} >= 3 THEN avg(k) OVER {fr(3)} END AS stoch_d_14, k AS stoch_k_14 FROM (
  SELECT *, CASE WHEN n < 14 THEN NULL WHEN hh - ll <= 1e-10 THEN 50
    ELSE least(greatest((close - ll) / (hh - ll + 1e-10) * 100, 0), 100) END AS k FROM (
    SELECT *, max(high) OVER {fr(14)} AS hh, min(low) OVER {fr(14)} AS ll, count(*) OVER {fr(14)} AS n FROM ctx {WT}))
{WT} QUALIFY session_date = target_date""")
add("adx", f"{KEY} adx_14:d plus_di_14:d minus_di_14:d", own(S.indicators), f"""
SELECT i.*, adx AS adx_14, plus_di_14, minus_di_14 FROM ind2 i LEFT JOIN dx1 USING (symbol, target_date, rn)
LEFT JOIN ewm_adx USING (symbol, target_date, rn) WHERE i.session_date = i.target_date""")
