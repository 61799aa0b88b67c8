"""Volume profiles, cross-module context, matrix assembly and multi-timeframe roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import cross as X
from barflow.operators import flow as O
from barflow.operators import momentum as M
from barflow.operators import multiframe as MF
from barflow.operators import volume_profile as V
from barflow.plans import matrix as P
from barflow.plans.context import trim_context, with_context

from .bar_queries import KEY
from .base import CTES, add
from .feature_queries import W, WT, fr, z

# --- volume profile
CTES["vb0"] = f"""
SELECT *, row_number() OVER s - 1 AS idx, count(*) OVER (PARTITION BY symbol, session_date) - 1 AS last_idx,
  greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr,
  CASE WHEN row_number() OVER s > 12 AND close > max(high) OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) THEN 1
       WHEN row_number() OVER s > 12 AND close < min(low) OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) THEN -1 END AS broke
FROM b {W}"""
CTES["vb1"] = f"""
SELECT *, coalesce(last_value(broke IGNORE NULLS) OVER s, 0) AS dir, greatest(avg(tr) OVER {fr(14)}, 1e-9) AS atr FROM vb0 {W}"""
CTES["vb2"] = f"""
SELECT *, CASE WHEN dir <> coalesce(lag(dir) OVER s, 0) THEN idx END AS flip FROM vb1 {W}"""
CTES["vb"] = f"SELECT *, max(flip) OVER s AS anchor FROM vb2 {W}"
CTES["vx"] = """
SELECT symbol, session_date, idx, CAST(round(unnest(vap_prices) / 0.25) AS BIGINT) AS level, unnest(vap_volumes) AS vol FROM vb"""
CTES["ow"] = """
SELECT 's' AS kind, o.symbol, o.session_date, o.idx AS own, x.level, sum(x.vol) AS vol FROM vb o JOIN vx x
  ON x.symbol = o.symbol AND x.session_date = o.session_date AND x.idx <= o.idx GROUP BY ALL
UNION ALL SELECT 'r', o.symbol, o.session_date, o.idx, x.level, sum(x.vol) FROM vb o JOIN vx x
  ON x.symbol = o.symbol AND x.session_date = o.session_date AND x.idx BETWEEN o.idx - 23 AND o.idx GROUP BY ALL
UNION ALL SELECT 'w', o.symbol, o.session_date, o.idx, x.level, sum(x.vol) FROM vb o JOIN vx x
  ON x.symbol = o.symbol AND x.session_date = o.session_date AND x.idx BETWEEN o.anchor AND o.idx
  WHERE o.idx - o.anchor <= 30 GROUP BY ALL"""
CTES["hist"] = """
SELECT *, row_number() OVER k AS pos, coalesce(lag(vol) OVER k, lead(vol) OVER k) AS pv, lag(vol) OVER k AS lv, lead(vol) OVER k AS nv
FROM ow WINDOW k AS (PARTITION BY kind, symbol, session_date, own ORDER BY level)"""
CTES["pst"] = """
SELECT *, sqrt(var) AS sd FROM (
  SELECT kind, symbol, session_date, own, sum(vol) AS total, count(*) AS n, first(pos ORDER BY vol DESC, level) AS apos,
    max(vol) AS top, sum(vol * (level - mu) ** 2) / sum(vol) AS var, any_value(mu) AS mu,
    list(level * 0.25) FILTER (vol > lv AND vol > nv) AS hvn, list(level * 0.25) FILTER (vol < lv AND vol < nv) AS lvn
  FROM (SELECT *, sum(vol * level) OVER g / sum(vol) OVER g AS mu FROM hist
        WINDOW g AS (PARTITION BY kind, symbol, session_date, own)) GROUP BY ALL)"""
CTES["grow"] = """
SELECT kind, symbol, session_date, own, apos AS lo, apos AS hi, CAST(top AS DOUBLE) AS v, total, n FROM pst
UNION ALL
SELECT g.kind, g.symbol, g.session_date, g.own,
  CASE WHEN coalesce(h.vol, -1) >= coalesce(l.vol, -1) THEN g.lo ELSE g.lo - 1 END,
  CASE WHEN coalesce(h.vol, -1) >= coalesce(l.vol, -1) THEN g.hi + 1 ELSE g.hi END,
  g.v + greatest(coalesce(h.vol, -1), coalesce(l.vol, -1)), g.total, g.n
FROM grow g
LEFT JOIN hist h ON h.kind = g.kind AND h.symbol = g.symbol AND h.session_date = g.session_date AND h.own = g.own AND h.pos = g.hi + 1
LEFT JOIN hist l ON l.kind = g.kind AND l.symbol = g.symbol AND l.session_date = g.session_date AND l.own = g.own AND l.pos = g.lo - 1
WHERE g.v < 0.7 * g.total AND (g.lo > 1 OR g.hi < g.n)"""
CTES["pf"] = """
WITH va AS (SELECT kind, symbol, session_date, own, min(lo) AS lo, max(hi) AS hi FROM grow GROUP BY ALL),
m AS (SELECT kind, symbol, session_date, own, sum(h.vol * ((h.level - p.mu) / p.sd) ** 3) / any_value(p.total) AS sk,
        sum(h.vol * ((h.level - p.mu) / p.sd) ** 4) / any_value(p.total) AS ku
      FROM hist h JOIN pst p USING (kind, symbol, session_date, own) WHERE p.var > 0 GROUP BY ALL)
SELECT p.*, a.level * 0.25 AS poc, h.level * 0.25 AS vah, l.level * 0.25 AS val, coalesce(sk, 0) AS skew, coalesce(ku, 0) AS kurt,
  coalesce(len(hvn), 0) AS n_hvn, coalesce(len(lvn), 0) AS n_lvn
FROM pst p JOIN va USING (kind, symbol, session_date, own) LEFT JOIN m USING (kind, symbol, session_date, own)
JOIN hist a ON a.kind = p.kind AND a.symbol = p.symbol AND a.session_date = p.session_date AND a.own = p.own AND a.pos = p.apos
JOIN hist h ON h.kind = p.kind AND h.symbol = p.symbol AND h.session_date = p.session_date AND h.own = p.own AND h.pos = va.hi
JOIN hist l ON l.kind = p.kind AND l.symbol = p.symbol AND l.session_date = p.session_date AND l.own = p.own AND l.pos = va.lo"""


def profile(kind: str) -> str:
    return (f"(SELECT * FROM pf WHERE kind = '{kind}') {kind} ON {kind}.symbol = vb.symbol AND "
            f"{kind}.session_date = vb.session_date AND {kind}.own = vb.idx")


def inside(k: str, missing: str) -> str:
    return (f"CASE WHEN {k}.vah IS NULL THEN {missing} WHEN {k}.vah - {k}.val < 1e-9 THEN 0.5 "
            f"ELSE (close - {k}.val) / ({k}.vah - {k}.val) END")


def dist(nodes: str) -> str:
    return f"list_min(list_transform({nodes}, lambda q: abs(close - q))) / atr"


CTES["vps"] = f"""
SELECT vb.*, s.poc AS poc_price, s.vah AS va_high, s.val AS va_low, s.skew AS vp_skew, s.kurt AS vp_kurtosis, s.n_hvn AS hvn_count,
  (close - s.poc) / atr AS poc_distance, close - s.poc AS poc_distance_raw, (s.vah - s.val) / close AS va_width,
  {inside('s', '0.5')} AS position_in_va FROM vb LEFT JOIN {profile('s')}"""
CTES["vpr"] = f"""
SELECT vb.*, r.poc AS rolling_poc, r.vah AS rolling_va_high, r.val AS rolling_va_low, r.skew AS rolling_vp_skew,
  r.n_hvn AS rolling_hvn_count, r.n_lvn AS rolling_lvn_count, r.n_hvn / (r.n_lvn + 1) AS hvn_lvn_ratio,
  (close - r.poc) / atr AS rolling_poc_distance, {inside('r', '0.5')} AS rolling_va_position,
  {dist('r.hvn')} AS dist_nearest_hvn, {dist('r.lvn')} AS dist_nearest_lvn,
  CASE WHEN {dist('r.hvn')} < 0.5 THEN 1 ELSE 0 END AS at_hvn, CASE WHEN {dist('r.lvn')} < 0.5 THEN 1 ELSE 0 END AS at_lvn,
  (SELECT sum(h.vol) FROM hist h WHERE h.kind = 'r' AND h.symbol = vb.symbol AND h.session_date = vb.session_date
     AND h.own = vb.idx AND abs(h.level * 0.25 - r.poc) <= 0.5 * vb.atr) / r.total AS vol_concentration
FROM vb LEFT JOIN {profile('r')}"""
CTES["vpw"] = f"""
SELECT vb.*, dir AS breakout_direction, idx - anchor AS bars_since_breakout, (close - w.poc) / atr AS swing_poc_dist,
  {dist('w.lvn')} AS swing_lvn_dist, {dist('w.hvn')} AS swing_hvn_dist, {inside('w', 'NULL')} AS swing_va_position
FROM vb LEFT JOIN {profile('w')}"""


def vp(x):
    return V.volume_profile(x.stored_bars())


add("session_profile", f"{KEY} poc_price:d va_high:d va_low:d vp_skew:d vp_kurtosis:d hvn_count:i", vp, "SELECT * FROM vps")
add("session_profile_distance", f"{KEY} poc_distance:d poc_distance_raw:d va_width:d position_in_va:d", vp, "SELECT * FROM vps")
add("rolling_profile", f"{KEY} rolling_poc:d rolling_va_high:d rolling_va_low:d rolling_vp_skew:d rolling_hvn_count:i "
    "rolling_lvn_count:i hvn_lvn_ratio:d rolling_poc_distance:d rolling_va_position:d poc_slope_6:d", vp,
    f"SELECT *, (rolling_poc - lag(rolling_poc, 6) OVER s) / atr AS poc_slope_6 FROM vpr {W}")
add("profile_nodes", f"{KEY} dist_nearest_hvn:d dist_nearest_lvn:d at_hvn:d at_lvn:d vol_concentration:d", vp, "SELECT * FROM vpr")
add("swing_anchor", f"{KEY} breakout_direction:d bars_since_breakout:d", lambda x: V.swing_anchor(x.bars()), "SELECT * FROM vpw")
add("swing_profile", f"{KEY} swing_poc_dist:d swing_lvn_dist:d swing_hvn_dist:d swing_va_position:d", vp, "SELECT * FROM vpw")
add("profile_without_levels", f"{KEY} poc_price:d position_in_va:d rolling_hvn_count:i",
    lambda x: V.volume_profile(x.bars().drop("vap_prices", "vap_volumes")),
    "SELECT *, NULL AS poc_price, NULL AS position_in_va, 0 AS rolling_hvn_count FROM b")


# --- cross-module context (bars carry the inputs through the warm-up days)
def base(x):
    df = O.orderflow(M.momentum(V.volume_profile(x.stored_bars())))
    df = O.aggressor(df).withColumn("recoil_50pct", F.lit(1.0))
    return with_context(df, X.CONTEXT_INPUTS, None, x.stored_bars())


def in_base(*fns):
    def build(x):
        df = base(x)
        for f in fns:
            df = f(df)
        return trim_context(df)
    return build


_CK = "symbol, session_date, ts_event, seq"
CTES["xb"] = f"""
SELECT m.*, order_flow_imbalance, volume_imbalance, absorption_signal, volume_delta, cvd_accel_3, rolling_va_position,
  poc_price, va_high, va_low, spread_bps, book_imbalance
FROM mom m JOIN (SELECT {_CK}, order_flow_imbalance, volume_imbalance, absorption_signal, volume_delta FROM flow) USING ({_CK})
JOIN (SELECT {_CK}, cvd_accel_3 FROM agg3) USING ({_CK}) JOIN (SELECT {_CK}, rolling_va_position FROM vpr) USING ({_CK})
JOIN (SELECT {_CK}, poc_price, va_high, va_low FROM vps) USING ({_CK})
JOIN (SELECT {_CK}, spread_bps, book_imbalance FROM bk) USING ({_CK})"""
CTES["xc"] = """
SELECT x.*, t.session_date AS target_date
FROM xb x JOIN days d USING (symbol, session_date) JOIN days t ON t.symbol = x.symbol AND t.r BETWEEN d.r AND d.r + 4"""
_OWN = "WHERE session_date = target_date"
add("regime_volatility", f"{KEY} regime_vol_relative:d", in_base(X.regime_volatility), f"""
SELECT * FROM (SELECT *, range_ma5 / nullif(median(range_ma5) OVER {fr(50)}, 0) AS regime_vol_relative FROM xc {WT}) {_OWN}""")
add("regime_autocorrelation", f"{KEY} regime_autocorr:d", lambda x: X.regime_autocorr(M.momentum(x.bars())), f"""
SELECT *, CASE WHEN count(lr) OVER {fr(20)} >= 10 THEN corr(CASE WHEN lr IS NOT NULL THEN return_1bar END, lr) OVER {fr(20)} END
  AS regime_autocorr FROM (SELECT *, lag(return_1bar) OVER s AS lr FROM mom {W}) {W}""")


def _interactions(x):
    from barflow.operators import book as K
    return X.interactions(K.book(O.orderflow(M.momentum(x.bars()))))


add("interaction_terms", f"{KEY} ix_ofi_x_vol:d ix_ofi_x_spread:d ix_bbo_imb_x_vdelta:d", _interactions, """
SELECT *, order_flow_imbalance * range_ma5 AS ix_ofi_x_vol, order_flow_imbalance * spread_bps AS ix_ofi_x_spread,
  book_imbalance * volume_delta AS ix_bbo_imb_x_vdelta FROM xb""")
CTES["pday"] = """
SELECT symbol, session_date, lag(hi) OVER d AS prev_day_high, lag(lo) OVER d AS prev_day_low, lag(cl) OVER d AS prev_day_close,
  op / lag(cl) OVER d - 1 AS gap_open, lag(poc) OVER d AS prev_day_poc, lag(vah) OVER d AS prev_day_vah, lag(val) OVER d AS prev_day_val
FROM (SELECT symbol, session_date, max(high) AS hi, min(low) AS lo, last(close ORDER BY ts_event, seq) AS cl,
        first(open ORDER BY ts_event, seq) AS op, last(poc_price ORDER BY ts_event, seq) AS poc,
        last(va_high ORDER BY ts_event, seq) AS vah, last(va_low ORDER BY ts_event, seq) AS val FROM xb GROUP BY ALL)
WINDOW d AS (PARTITION BY symbol ORDER BY session_date)"""
CTES["xp"] = """
SELECT *, (close - prev_day_high) / greatest(range_ma5, 1e-9) AS dist_prev_high, (close - prev_day_low) / greatest(range_ma5, 1e-9)
  AS dist_prev_low, CASE WHEN close * range_ma5 > 1e-9 THEN close * range_ma5 ELSE 1 END AS pa FROM xb JOIN pday USING (symbol, session_date)"""
add("previous_session_levels", f"{KEY} prev_day_high:d prev_day_low:d prev_day_close:d gap_open:d dist_prev_high:d dist_prev_low:d",
    in_base(X.previous_session), """SELECT * REPLACE (CASE WHEN abs(range_ma5) > 1e-9 THEN dist_prev_high ELSE (close - prev_day_high) / 1e-9 END
AS dist_prev_high) FROM xp""")
add("previous_session_profile", f"{KEY} prev_day_poc:d prev_day_vah:d prev_day_val:d dist_prev_poc:d dist_prev_vah:d "
    "dist_prev_val:d prev_day_va_position:d", in_base(X.previous_session), """
SELECT *, (close - prev_day_poc) / pa AS dist_prev_poc, (close - prev_day_vah) / pa AS dist_prev_vah, (close - prev_day_val) / pa AS
  dist_prev_val, (close - prev_day_val) / greatest(prev_day_vah - prev_day_val, 1e-9) AS prev_day_va_position FROM xp""")
CTES["acc1"] = f"""
SELECT *, stddev_samp(high_low_range) OVER {fr(6)} / greatest(avg(high_low_range) OVER {fr(6)}, 1e-9) AS range_compression,
  high_low_range / CASE WHEN avg(high_low_range) OVER {fr(6)} = 0 THEN 1e-9 ELSE avg(high_low_range) OVER {fr(6)} END
    AS volatility_compression_1bar,
  median(high_low_range) OVER {fr(12)} AS med12, median(high_low_range) OVER {fr(6)} AS med6,
  greatest(absorption_signal, coalesce(lag(absorption_signal) OVER s, 0), coalesce(lag(absorption_signal, 2) OVER s, 0)) AS recent
FROM xc {WT}"""
CTES["acc"] = f"""
SELECT *, (range_compression - avg(range_compression) OVER {fr(24)}) / CASE WHEN stddev_samp(range_compression) OVER {fr(24)} > 1e-9
    THEN stddev_samp(range_compression) OVER {fr(24)} ELSE 1e-9 END AS rz, count(range_compression) OVER {fr(24)} AS rn,
  CASE WHEN recent > 0 AND high_low_range < med12 THEN 1 ELSE 0 END AS post_absorption_contraction,
  CASE WHEN volatility_compression_1bar < 0.5 THEN 1 ELSE 0 END AS post_recoil_stall,
  CASE WHEN recent > 0 AND high_low_range > 2 * med6 AND volume_imbalance > 0.15 AND coalesce(cvd_accel_3, 0) > 0 THEN 1 ELSE 0 END
    AS squeeze_bull,
  CASE WHEN recent > 0 AND high_low_range > 2 * med6 AND volume_imbalance < -0.15 AND coalesce(cvd_accel_3, 0) < 0 THEN 1 ELSE 0 END
    AS squeeze_bear FROM acc1 {WT}"""
add("accumulation", f"{KEY} range_compression:d volatility_compression_1bar:d range_compression_z:d post_absorption_contraction:d "
    "post_recoil_stall:d", in_base(X.accumulation),
    f"SELECT *, CASE WHEN rn >= 2 THEN rz END AS range_compression_z FROM acc {_OWN}")
add("squeeze", f"{KEY} squeeze_bull:d squeeze_bear:d squeeze_score:d", in_base(X.squeeze),
    f"SELECT *, squeeze_bull - squeeze_bear AS squeeze_score FROM acc {_OWN}")
_TH = "(2 / (1 + exp(-2 * ({})) ) - 1)".format
CTES["fc1"] = f"""
SELECT *, {z('order_flow_imbalance', 50, '1e-9')} AS ofi_impulse_z, wd / (wt + 1) AS whale_imbalance_ratio_30,
  wt / (volume + 1) AS whale_participation_rate_30,
  avg(CASE WHEN rolling_va_position BETWEEN 0 AND 1 THEN 1 ELSE 0 END) OVER {fr(8)} AS value_acceptance_rate_8,
  CASE WHEN avg(abs(order_flow_imbalance)) OVER {fr(50)} > 1e-9
    THEN {_TH(f'order_flow_imbalance / avg(abs(order_flow_imbalance)) OVER {fr(50)}')} ELSE 0 END AS onn,
  CASE WHEN avg(abs(wd)) OVER {fr(50)} > 1e-9 THEN {_TH(f'wd / avg(abs(wd)) OVER {fr(50)}')} ELSE 0 END AS wn,
  count(*) OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS n12, max(high) OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS h12,
  min(low) OVER (s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS l12, greatest(high - low, 1e-9) AS rng
FROM (SELECT *, whale_buy_volume_30 - whale_sell_volume_30 AS wd, whale_buy_volume_30 + whale_sell_volume_30 AS wt FROM xc) {WT}"""
CTES["fc"] = """
SELECT *, wn * onn AS whale_ofi_alignment, 0.5 * volume_imbalance + 0.5 * onn AS fl,
  least(1, greatest(0, (least(open, close) - low) / rng)) AS lw, least(1, greatest(0, (high - greatest(open, close)) / rng)) AS uw,
  least(1, greatest(0, (0.2 - rolling_va_position) / 0.2)) AS nv, least(1, greatest(0, (rolling_va_position - 0.8) / 0.2)) AS nh FROM fc1"""
add("flow_impulse_whales", f"{KEY} ofi_impulse_z:d whale_imbalance_ratio_30:d whale_participation_rate_30:d whale_ofi_alignment:d "
    "value_acceptance_rate_8:d", in_base(X.flow_context), f"SELECT * FROM fc {_OWN}")
add("auction_scores", f"{KEY} va_rejection_score:d price_discovery_score:d structure_break_score:d", in_base(X.flow_context), f"""
SELECT *, nv * lw * greatest(fl, 0) - nh * uw * greatest(-fl, 0) AS va_rejection_score,
  CASE WHEN rolling_va_position > 1 THEN rolling_va_position - 1 WHEN rolling_va_position < 0 THEN rolling_va_position ELSE 0 END * fl
    AS price_discovery_score,
  CASE WHEN n12 = 12 AND close > h12 THEN greatest(fl, 0) ELSE 0 END - CASE WHEN n12 = 12 AND close < l12 THEN greatest(-fl, 0) ELSE 0 END
    AS structure_break_score FROM fc {_OWN}""")


def _failed(x):
    df = base(x)
    return X.failed_auction(trim_context(X.previous_session(df)))


add("failed_auction", f"{KEY} failed_auction_bull:d failed_auction_bear:d failed_auction_score:d", _failed, """
SELECT *, failed_auction_bull - failed_auction_bear AS failed_auction_score FROM (
SELECT *, CASE WHEN low < prev_day_val AND close > prev_day_val AND (absorption_signal > 0 OR whale_buy_volume_30 > 0) THEN 1 ELSE 0 END
  AS failed_auction_bull, CASE WHEN high > prev_day_vah AND close < prev_day_vah AND (absorption_signal > 0 OR whale_sell_volume_30 > 0)
  THEN 1 ELSE 0 END AS failed_auction_bear FROM xp)""")

# --- assembly
_MCOLS = ("close:d return_12bar:d order_flow_imbalance:i vwap_deviation_stat:d vpin_toxicity:d trade_intensity_aggressor:d cvd:i "
          "stacked_imb_ma3:d poc_distance:d spread_bps:d fwd_return_3bar:d")


def _matrix(x, bars: bool = True):
    return P.feature_matrix(x.stored_bars(), include_bar_columns=bars)


CTES["mx"] = f"""
SELECT x.*, vpin_toxicity, trade_intensity_aggressor, cvd, stacked_imb_ma3, poc_distance, fwd_return_3bar, label_1bar, fwd_return_12bar,
  x.close - sum(x.vwap * x.volume) OVER w / sum(x.volume) OVER w AS vwap_deviation_stat
FROM xb x JOIN (SELECT {_CK}, avg(abs(buy_volume - sell_volume) / (buy_volume + sell_volume + 1)) OVER {fr(20)} AS vpin_toxicity FROM b {W})
  USING ({_CK})
JOIN (SELECT {_CK}, trade_intensity_aggressor, cvd FROM agg3) USING ({_CK}) JOIN (SELECT {_CK}, stacked_imb_ma3 FROM foot) USING ({_CK})
JOIN (SELECT {_CK}, poc_distance FROM vps) USING ({_CK}) JOIN (SELECT * EXCLUDE (label_3bar, label_5bar) FROM lab) USING ({_CK})
WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts_event, seq)"""
CTES["sm8"] = f"SELECT {_CK}, target_date, count(*) OVER {fr(8)} AS n8 FROM ctx {WT}"
add("feature_matrix", f"{KEY} {_MCOLS}", _matrix, "SELECT * FROM mx")
add("matrix_pass_through", f"{KEY} ts_close:t trade_count:i buy_volume:i sell_volume:i whale_buy_volume_30:i", _matrix,
    "SELECT * FROM mx")
add("matrix_output_filter", f"{KEY} close:d return_12bar:d", lambda x: P.output_filter(_matrix(x)), f"""
SELECT m.* FROM mx m JOIN sm8 USING ({_CK}) WHERE session_date = target_date AND n8 >= 8 AND fwd_return_12bar IS NOT NULL""")


def _filled(df, cols):
    """Values of each column of a matrix by symbol: how many there are, and what the finite ones sum up to."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.count(F.col(c)).alias("value_count")) for c in sorted(cols)]
    return df.groupBy("symbol").agg(F.array(*cells).alias("cells")).select("symbol", F.explode("cells").alias("c")).select("symbol", "c.*")


def _filled_sql(source: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT symbol, '{c}' AS column_name, count({c}) AS value_count FROM {source} GROUP BY symbol" for c in sorted(cols))


_MOM_FEATURES = ["body_ratio", "close_position", "high_low_range", "lower_wick_ratio", "momentum_volume", "range_ma5", "return_1bar", "return_5bar", "return_12bar",
                 "upper_wick_ratio", "volume_ma5", "volume_ratio", "vwap_deviation", "vwap_deviation_ma5"]
_BAR_FEATURES = ["bid_size", "ask_size", "bid_count", "ask_count", "msg_count", "add_count", "cancel_count", "modify_count", "latency_mean", "stacked_imbalance_count",
                 "stacked_imbalance_direction", "zero_print_count", "zero_print_ratio", "unfinished_high", "unfinished_low", "max_level_volume", "volume_at_high", "volume_at_low",
                 "buy_vol_at_high", "sell_vol_at_high", "buy_vol_at_low", "sell_vol_at_low", "vap_prices", "vap_volumes"]


def _plain_matrix(x):
    """Momentum features and labels with all bar columns: ids, raw prices and raw flow are there to be left out."""
    return M.labels(M.momentum(x.bars()))


CTES["pm"] = f"SELECT m.*, {', '.join(f'fwd_return_{k}bar' for k in (1, 3, 6, 12))} FROM mom m JOIN lab USING ({_CK})"
add("feature_columns", "symbol:s column_name:s value_count:i", lambda x: _filled(_plain_matrix(x), P.feature_columns(_plain_matrix(x))),
    _filled_sql("pm", [*_MOM_FEATURES, "volume", *_BAR_FEATURES]))
add("feature_group_columns", "symbol:s column_name:s value_count:i",
    lambda x: _filled(_plain_matrix(x), P.feature_group(_plain_matrix(x), "ohlcv", keep_non_features=False).columns), _filled_sql("pm", [*_MOM_FEATURES, "volume"]))
add("strategy_visible_columns", "symbol:s column_name:s value_count:i",
    lambda x: _filled(_plain_matrix(x), [c for c in P.strategy_inputs(_plain_matrix(x), "ohlcv").columns if c != "symbol"]),
    _filled_sql("pm", [*_MOM_FEATURES, "volume", "session_date", "ts_event", "seq", "open", "high", "low", "close"]))
add("ohlcv_group", f"{KEY} return_5bar:d range_ma5:d body_ratio:d", lambda x: P.feature_group(_matrix(x), "ohlcv"),
    "SELECT * FROM mom")
add("legacy_partition_check", "symbol:s session_date:D row_count:i is_legacy:i",
    lambda x: P.legacy_partitions(M.labels(M.opening_range(x.bars())), ["symbol", "session_date"]).withColumn(
        "is_legacy", F.col("is_legacy").cast("int")), """
SELECT symbol, session_date, count(*) AS row_count, CASE WHEN count(*) > 12 AND (count(fwd_return_12bar) = count(*)
  OR count(*) FILTER (minutes_since_open >= 30) > 0) THEN 1 ELSE 0 END AS is_legacy
FROM lab JOIN (SELECT symbol, ts_event, minutes_since_open FROM tod) USING (symbol, ts_event) GROUP BY ALL""")

# --- multi-timeframe
_OPS = ["mean", "std", "last", "delta", "min", "max", "slope"]
_FEATS = ["cancel_count", "buy_volume", "volume", "trade_count", "sell_volume", "add_count", "volume_ma5", "modify_count", "cvd", "order_flow_imbalance", "latency_mean", "vwap_deviation"]


def _mtf_source(x):
    return O.aggressor(O.orderflow(M.momentum(x.bars())))


def _mtf_sql(c: str) -> str:
    f, l = f"first({c} ORDER BY ts_event, seq)", f"last({c} ORDER BY ts_event, seq)"
    return (f"avg({c}) AS m1f_{c}__mean, stddev_samp({c}) AS m1f_{c}__std, {l} AS m1f_{c}__last, {l} - {f} AS m1f_{c}__delta, "
            f"min({c}) AS m1f_{c}__min, max({c}) AS m1f_{c}__max, CASE WHEN count(*) > 1 THEN ({l} - {f}) / (count(*) - 1) ELSE 0 END "
            f"AS m1f_{c}__slope")


add("multi_timeframe", "symbol:s ts_event:t " + " ".join(f"m1f_{c}__{o}:d" for c in _FEATS for o in _OPS),
    lambda x: MF.roll_up(_mtf_source(x), "4h", _FEATS, _OPS), f"""
SELECT symbol, make_timestamp(epoch_us(ts_event) // 14400000000 * 14400000000) AS ts_event, {', '.join(map(_mtf_sql, _FEATS))}
FROM (SELECT a.*, order_flow_imbalance, volume_ma5, vwap_deviation FROM agg3 a JOIN (SELECT {_CK}, order_flow_imbalance FROM flow) USING ({_CK})
  JOIN (SELECT {_CK}, volume_ma5, vwap_deviation FROM mom) USING ({_CK}))
GROUP BY symbol, epoch_us(ts_event) // 14400000000""")
_CAND = ["close", "volume", "trade_count", "vwap", "return_1bar", "cvd"]
add("variable_features", "rank:i column_name:s variance:d",
    lambda x: MF.most_variable(_mtf_source(x).select(*_CAND), _CAND, 4),
    "SELECT row_number() OVER (ORDER BY variance DESC, column_name) AS rank, * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, var_samp({c}) AS variance FROM "
        "(SELECT a.*, return_1bar FROM agg3 a JOIN (SELECT symbol, session_date, ts_event, seq, return_1bar FROM mom) "
        "USING (symbol, session_date, ts_event, seq))" for c in _CAND) + ") QUALIFY rank <= 4")
add("multi_timeframe_fallback", "symbol:s ts_event:t " + " ".join(f"m1f_{c}__{o}:d" for c in ("volume", "trade_count") for o in ("mean", "last")),
    lambda x: MF.roll_up(x.bars().select("symbol", "ts_event", "seq", "vwap", "close", "volume", "trade_count", "zero_print_ratio").withColumn("bar_duration_ns", F.col("volume") * 1000),
                         "4h", ["no_such_feature"], ["mean", "last"], 2), """
SELECT symbol, make_timestamp(epoch_us(ts_event) // 14400000000 * 14400000000) AS ts_event, avg(volume) AS m1f_volume__mean, last(volume ORDER BY ts_event, seq) AS m1f_volume__last,
  avg(trade_count) AS m1f_trade_count__mean, last(trade_count ORDER BY ts_event, seq) AS m1f_trade_count__last FROM b GROUP BY symbol, epoch_us(ts_event) // 14400000000""")
add("context_warmup", "symbol:s target_date:D context_bars:i context_days:i own_bars:i",
    lambda x: with_context(x.bars()).groupBy("symbol", "target_date").agg(
        F.count(F.lit(1)).alias("context_bars"), F.countDistinct("session_date").alias("context_days"),
        F.count_if(F.col("session_date") == F.col("target_date")).alias("own_bars")), """
SELECT symbol, target_date, count(*) AS context_bars, count(DISTINCT session_date) AS context_days,
  count(*) FILTER (session_date = target_date) AS own_bars FROM ctx GROUP BY ALL""")
