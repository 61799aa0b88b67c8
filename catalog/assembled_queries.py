"""The assembled feature matrix, every column of it: each block joins the SQL of the modules that its columns come from."""

from __future__ import annotations

import re

from barflow.plans import matrix as P

from .base import CTES, QUERIES, Query, add

_KEYS = ["symbol", "session_date", "ts_event", "seq"]

# Modules that are tested over half-hour bars or with a stand-in input have SQL of their own here, over the matrix's hourly bars.
_HALF_HOUR = ["orr", "tox", "stat1", "stat2", "stat"]


def _hourly(sql: str) -> str:
    return re.sub(r"\bFROM (" + "|".join(_HALF_HOUR) + r")\b", r"FROM \1_60", re.sub(r"\bbars_30\b", "bars_60", sql))


for _n in _HALF_HOUR:
    CTES[f"{_n}_60"] = _hourly(CTES[_n])
_OWN_SQL = {
    "opening_range": """SELECT *, (oh - ol) / ((oh + ol) / 2) AS or_width, CASE WHEN oh = ol THEN 0.5 ELSE (close - ol) / (oh - ol) END AS position_in_or,
  CASE WHEN since < 30 THEN NULL WHEN close > oh THEN 1 ELSE 0 END AS or_broken_up, CASE WHEN since < 30 THEN NULL WHEN close < ol THEN 1 ELSE 0 END AS or_broken_down FROM orr_60""",
    "session_vpin": "SELECT * FROM tox_60",
    "log_return": "SELECT * FROM stat_60", "yang_zhang_volatility": "SELECT * FROM stat_60", "volatility_vwap_zscores": "SELECT * FROM stat_60",
    "accumulation": """SELECT a.* EXCLUDE (post_recoil_stall), CASE WHEN rn >= 2 THEN rz END AS range_compression_z,
  CASE WHEN m.recoil_50pct = 1 AND volatility_compression_1bar < 0.5 THEN 1 ELSE 0 END AS post_recoil_stall
FROM acc a JOIN mic m USING (symbol, session_date, ts_event, seq) WHERE a.session_date = a.target_date""",
}

BLOCKS = {
    "price": ["time_bars", "bar_return", "rolling_returns", "vwap_deviation", "bar_range", "volume_momentum", "candle_geometry", "forward_labels", "time_of_day", "opening_range",
              "log_return", "yang_zhang_volatility", "volatility_vwap_zscores"],
    "indicators": ["fractional_difference", "obv_slope", "sma_ratios", "ema_ratios", "rsi", "atr", "bollinger", "macd", "stochastic", "adx"],
    "flow": ["bar_aggressor_split", "orderflow_ratios", "order_flow_imbalance", "cvd_price_divergence", "absorption_factor", "absorption_signal", "cumulative_delta", "cvd_divergence",
             "cvd_slope_acceleration", "cvd_price_alignment", "aggressor_ratios", "session_vpin"],
    "book": ["bar_book_snapshot", "book_state", "book_rolling", "message_features", "tape_speed", "price_velocity", "whip_recoil", "arrival_vpin", "queue_imbalance_micro_price",
             "stacked_imbalance", "stacked_streak", "zero_prints", "unfinished_business", "delta_heat", "extreme_aggression"],
    "profile": ["session_profile", "session_profile_distance", "rolling_profile", "profile_nodes", "swing_anchor", "swing_profile"],
    "context": ["regime_volatility", "regime_autocorrelation", "interaction_terms", "previous_session_levels", "previous_session_profile", "accumulation", "squeeze",
                "flow_impulse_whales", "auction_scores", "failed_auction"],
}
# Bar columns that the matrix leaves out.
_LEFT_OUT = {"bid_size", "ask_size", "bid_count", "ask_count"}


def _block(name: str, modules: list[str]) -> None:
    for m, sql in _OWN_SQL.items():
        if m in modules:
            add(f"_{m}", " ".join(f"{n}:{k}" for n, k in QUERIES[m].spec), lambda x: None, sql)
    parts = [QUERIES.pop(f"_{m}") if m in _OWN_SQL else QUERIES[m] for m in modules]
    cols = [[c for c in q.spec[len(_KEYS):] if c[0] not in _LEFT_OUT] for q in parts]
    spec = [*parts[0].spec[:len(_KEYS)], *[c for own in cols for c in own]]
    picked = [f"(SELECT {', '.join([*_KEYS, *[c for c, _ in own]])} FROM ({q.sql}) AS t)" for q, own in zip(parts, cols)]
    joined = f"{picked[0]} AS p0" + "".join(f" JOIN {p} AS p{i} USING ({', '.join(_KEYS)})" for i, p in enumerate(picked[1:], 1))
    QUERIES[f"matrix_block_{name}"] = Query(spec, lambda x: P.feature_matrix(x.stored_bars(), include_bar_columns=True), f"SELECT * FROM {joined}")


for _name, _modules in BLOCKS.items():
    _block(_name, _modules)
