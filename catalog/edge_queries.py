"""Edge surface and feature profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import book as K
from barflow.operators import edge as E
from barflow.operators import flow as O
from barflow.operators import momentum as M
from barflow.operators import profiling as P
from barflow.operators import trades as T

from .base import CTES, add
from .trade_queries import KEYS, metric_sql

CFG = {**E.CONFIG, "enabled": True, "horizons": [1, 3, 6, 30], "min_events": 60, "min_pocket_events": 3, "min_positive_day_fraction": 0.1, "max_day_concentration": 0.9, "min_avg_trade_pnl": -1e9}
_CK = "symbol, session_date, ts_event, seq"


def edge_bars(x):
    from barflow.sources.stage import stored
    df = K.book(O.orderflow(M.momentum(x.bars())))
    ofi = F.col("order_flow_imbalance")
    return stored(df.withColumn("signal", T.signal_from_conditions(ofi > 40, ofi < -40)).select(
        "symbol", "session_date", "ts_event", "seq", "open", "high", "low", "close", "signal", "bid_price", "ask_price", "spread_bps", "trade_intensity", "return_5bar",
        F.col("vwap_deviation").alias("position_in_va"), "volume", "volume_imbalance", "absorption_signal"), "edge")


CTES["eb0"] = f"""
SELECT sn.*, spread_bps, return_5bar, vwap_deviation AS position_in_va FROM sn JOIN (SELECT {_CK}, spread_bps FROM bk) USING ({_CK})
JOIN (SELECT {_CK}, return_5bar, vwap_deviation FROM mom) USING ({_CK})"""
CTES["th"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, quantile_cont({c}, 1.0/3) AS lower, quantile_cont({c}, 2.0/3) AS upper FROM eb0"
    for c in ("spread_bps", "trade_intensity", "return_5bar"))


def _bucket(fam: str) -> str:
    col, (lo, mid, hi) = E.FAMILIES[fam]
    cut = f"(SELECT {{}} FROM th WHERE column_name = '{col}')".format
    return f"CASE WHEN {col} <= {cut('lower')} THEN '{lo}' WHEN {col} < {cut('upper')} THEN '{mid}' WHEN {col} IS NOT NULL THEN '{hi}' END AS {fam}"


_M = "(epoch_us(ts_event - INTERVAL 5 HOUR) // 60000000 % 1440)"
CTES["eb"] = f"""
SELECT *, CASE WHEN {_M} < 180 THEN 'eth_overnight' WHEN {_M} < 570 THEN 'london' WHEN {_M} < 660 THEN 'rth_open' WHEN {_M} < 900 THEN 'rth_midday'
    WHEN {_M} < 960 THEN 'power_hour' ELSE 'eth_overnight' END AS session_bucket,
  CASE WHEN position_in_va < 0 THEN 'below_value' WHEN position_in_va > 1 THEN 'above_value' WHEN position_in_va IS NOT NULL THEN 'inside_value' END
    AS value_area_bucket, {_bucket('spread_bucket')}, {_bucket('activity_bucket')}, {_bucket('direction_bucket')} FROM eb0"""
FAMS = ["session_bucket", "value_area_bucket", "spread_bucket", "activity_bucket", "direction_bucket"]
add("tercile_thresholds", "column_name:s lower:d upper:d",
    lambda x: E.tercile_thresholds(edge_bars(x), ["spread_bps", "trade_intensity", "return_5bar", "absent"]), "SELECT * FROM th")
add("context_buckets", "symbol:s ts_event:t " + " ".join(f"{f}:s" for f in FAMS), lambda x: E.with_buckets(edge_bars(x)), "SELECT * FROM eb")
CTES["ht"] = """
SELECT v.*, m.bar_cost, s.ts_event AS exit_time, s.close AS exit_price, 1 AS size, h AS horizon_bars
FROM ev v JOIN ms m ON m.symbol = v.symbol AND m.ts_event = v.entry_time
CROSS JOIN (VALUES (1), (3), (6), (30)) AS hs(h) JOIN sn s ON s.symbol = v.symbol AND s.date_utc = v.date_utc AND s.i = v.i + h"""


def _sliced(src: str) -> str:
    lab = [("global", "'all'"), ("side", "CASE WHEN direction > 0 THEN 'long' ELSE 'short' END")] + [(f, f"e.{f}") for f in FAMS]
    return " UNION ALL ".join(f"SELECT t.*, '{f}' AS family, {l} AS label FROM {src} t JOIN eb e ON e.symbol = t.symbol AND e.ts_event = t.signal_time"
                              for f, l in lab)


CTES["hs0"] = "SELECT * FROM (" + _sliced("ht") + ") WHERE label IS NOT NULL"
CTES["p_hs"] = """SELECT *, size * bar_cost AS costs, (exit_price - entry_price) * direction * 20 AS gross_pnl,
  (exit_price - entry_price) * direction * 20 - bar_cost AS net_pnl,
  (epoch_us(exit_time) // 1000000 - epoch_us(entry_time) // 1000000) / 60 AS holding_time_min, CAST(exit_time AS DATE) AS xd FROM hs0"""
CTES["m_hs"] = "SELECT * FROM (" + metric_sql("p_hs", "symbol, family, label, horizon_bars") + ")"
CTES["slices"] = f"""
SELECT symbol, family, label, CAST(sum(n) AS BIGINT) AS base_event_count, max(sum(n) FILTER (family = 'global')) OVER (PARTITION BY symbol) >= {CFG['min_events']} AS enough FROM (
  SELECT symbol, family, label, count(*) AS n FROM ({_sliced("ev")}) WHERE label IS NOT NULL GROUP BY ALL
  UNION ALL SELECT DISTINCT symbol, f, l, 0 FROM b, (VALUES ('global', 'all'), ('side', 'long'), ('side', 'short')) AS v(f, l))
GROUP BY symbol, family, label QUALIFY family = 'global' OR enough"""
CTES["pop"] = f"""
SELECT *, trade_count >= CASE WHEN family = 'global' THEN {CFG['min_events']} ELSE 3 END AND avg_trade_pnl > -1e9 AND net_pnl > 0 AND
  positive_day_fraction >= 0.1 AND max_day_concentration <= 0.9 AS passed FROM (
  SELECT s.symbol, s.family, s.label, CAST(h AS INTEGER) AS horizon_bars, coalesce(trade_count, 0) AS trade_count, coalesce(avg_trade_pnl, 0) AS avg_trade_pnl,
    coalesce(net_pnl, 0) AS net_pnl, CASE WHEN trade_count IS NULL THEN 0 ELSE sharpe_ratio END AS sharpe_ratio, coalesce(positive_day_fraction, 0) AS positive_day_fraction,
    coalesce(max_day_concentration, 1) AS max_day_concentration, long_avg_trade_pnl, short_avg_trade_pnl
  FROM slices s CROSS JOIN (VALUES (1), (3), (6), (30)) AS hs(h)
  LEFT JOIN m_hs m ON m.symbol = s.symbol AND m.family = s.family AND m.label = s.label AND m.horizon_bars = h WHERE s.enough)"""


def _population(x):
    inputs = E.edge_inputs(edge_bars(x), KEYS)
    events = E.edge_events(inputs, KEYS, False, CFG)
    return E.edge_population(E.edge_slices(inputs, events, KEYS, CFG), events, KEYS, CFG)


add("edge_population", "symbol:s family:s label:s horizon_bars:i trade_count:i avg_trade_pnl:d net_pnl:d sharpe_ratio:d positive_day_fraction:d "
    "max_day_concentration:d long_avg_trade_pnl:d short_avg_trade_pnl:d passed:i",
    lambda x: _population(x).withColumn("passed", F.col("passed").cast("int")), "SELECT * FROM pop")
CTES["surf"] = """
WITH best AS (SELECT *, count(*) FILTER (passed) OVER (PARTITION BY symbol, family, label) AS positive_horizons FROM pop
  QUALIFY row_number() OVER (PARTITION BY symbol, family, label ORDER BY passed DESC, avg_trade_pnl DESC, net_pnl DESC, trade_count DESC, horizon_bars) = 1)
SELECT e.*, coalesce(positive_horizons, 0) AS positive_horizons, horizon_bars AS best_horizon_bars, trade_count AS best_event_count,
  avg_trade_pnl AS best_avg_trade_pnl, positive_day_fraction AS best_positive_day_fraction, max_day_concentration AS best_max_day_concentration,
  coalesce(positive_horizons, 0) >= 1 AS passed FROM slices e LEFT JOIN best USING (symbol, family, label)"""


def _surface(x):
    return E.edge_surface(edge_bars(x), KEYS, False, CFG)


def _wanted(x):
    """The symbols of the table, and one more of each that has no bars."""
    return x.bars().select("symbol").distinct().select(F.explode(F.array("symbol", F.concat("symbol", F.lit(".absent")))).alias("symbol"))


add("edge_surface", "symbol:s family:s label:s base_event_count:i positive_horizons:i best_horizon_bars:d best_event_count:d best_avg_trade_pnl:d "
    "best_positive_day_fraction:d best_max_day_concentration:d passed:i",
    lambda x: _surface(x).withColumn("passed", F.col("passed").cast("int")), "SELECT * FROM surf")
add("edge_best_pockets", "symbol:s rank:i family:s label:s best_avg_trade_pnl:d", lambda x: E.best_pockets(_surface(x), KEYS, CFG), """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY best_avg_trade_pnl DESC, positive_horizons DESC, best_event_count DESC, family DESC, label DESC) AS rank
FROM surf WHERE passed AND family NOT IN ('global', 'side') QUALIFY rank <= 5""")
add("edge_status", "symbol:s event_count:i status:s passed:i has_localized_edge:i",
    lambda x: E.surface_status(_surface(x), KEYS, CFG, _wanted(x)).withColumns({c: F.col(c).cast("int") for c in ("passed", "has_localized_edge")}), f"""
SELECT *, CASE WHEN status = 'global_edge' THEN 1 ELSE 0 END AS passed FROM (
SELECT w.symbol, coalesce(event_count, 0) AS event_count, CASE WHEN coalesce(l, false) THEN 1 ELSE 0 END AS has_localized_edge, CASE WHEN event_count IS NULL THEN 'no_data'
  WHEN event_count < {CFG['min_events']} THEN 'insufficient_events' WHEN g THEN 'global_edge' WHEN l THEN 'localized_edge_only' ELSE 'no_edge' END AS status
FROM (SELECT DISTINCT symbol || x AS symbol FROM b, (VALUES (''), ('.absent')) AS v(x)) w LEFT JOIN (
  SELECT symbol, max(base_event_count) FILTER (family = 'global') AS event_count, bool_or(passed) FILTER (family = 'global') AS g,
  bool_or(passed) FILTER (family NOT IN ('global', 'side')) AS l FROM surf GROUP BY symbol) USING (symbol))""")
add("edge_omitted_families", "family:s reason:s column:s",
    lambda x: E.omitted_families(edge_bars(x).drop("trade_intensity").withColumn("spread_bps", F.lit(1.0))), """
SELECT * FROM (VALUES ('vol_bucket', 'missing_column', 'regime_vol_relative'), ('activity_bucket', 'missing_column', 'trade_intensity'),
  ('spread_bucket', 'insufficient_variation', 'spread_bps')) AS v(family, reason, "column")
UNION ALL SELECT 'direction_bucket', 'insufficient_variation', 'return_5bar' FROM (SELECT count(*) AS n FROM th WHERE column_name = 'return_5bar' AND upper > lower) WHERE n = 0""")

# --- profiles
PCOLS = ["close", "volume", "volume_imbalance", "absorption_signal", "return_5bar", "dead_zero", "dead_null"]


def profiled(x):
    return edge_bars(x).withColumns({"dead_zero": F.lit(0.0), "dead_null": F.lit(None).cast("double")})


CTES["plong"] = " UNION ALL ".join(
    f"SELECT symbol, session_date, '{c}' AS column_name, CAST({e} AS DOUBLE) AS value FROM xb" for c, e in (
        ("close", "close"), ("volume", "volume"), ("volume_imbalance", "volume_imbalance"), ("absorption_signal", "absorption_signal"),
        ("return_5bar", "return_5bar"), ("dead_zero", "0"), ("dead_null", "NULL")))
CTES["prof_t"] = """
SELECT *, CASE WHEN finite_count = 0 THEN 'all_null' WHEN nonzero_count = 0 THEN 'constant_zero' WHEN oth = 0 AND nonzero_rate <= 0.005 THEN 'binary_sparse'
  WHEN nonzero_rate <= 0.005 THEN 'sparse' WHEN hi - lo <= 1e-12 THEN 'constant' WHEN oth = 0 THEN 'binary_active' ELSE 'variable' END AS kind FROM (
  SELECT symbol, column_name, count(*) AS row_count, count(*) - count(value) AS null_count, (count(*) - count(value)) / count(*) AS null_rate, count(value) AS finite_count,
    count(*) FILTER (abs(value) > 1e-12) AS nonzero_count, count(*) FILTER (value NOT IN (0, 1)) AS oth, min(value) AS lo, max(value) AS hi,
    CASE WHEN count(value) > 0 THEN count(*) FILTER (abs(value) > 1e-12) / count(value) ELSE 0 END AS nonzero_rate,
    quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM plong GROUP BY ALL)"""
add("feature_profile", "symbol:s column_name:s row_count:i null_count:i finite_count:i nonzero_rate:d kind:s p10:d p50:d p90:d",
    lambda x: P.column_profile(profiled(x), KEYS, PCOLS), "SELECT * FROM prof_t")
add("sample_quantile_spread", "symbol:s column_name:s p10_min:d p10_max:d p50_min:d p50_max:d p90_min:d p90_max:d",
    lambda x: P.sample_spread(profiled(x), KEYS, "session_date", PCOLS), """
SELECT symbol, column_name, min(p10) AS p10_min, max(p10) AS p10_max, min(p50) AS p50_min, max(p50) AS p50_max, min(p90) AS p90_min, max(p90) AS p90_max FROM (
  SELECT symbol, session_date, column_name, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90
  FROM plong WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
add("dead_sparse_features", "symbol:s column_name:s kind:s group:s", lambda x: P.dead_and_sparse(P.column_profile(profiled(x), KEYS, PCOLS)), """
SELECT *, CASE WHEN kind IN ('all_null', 'constant_zero') THEN 'dead' ELSE 'sparse' END AS "group" FROM prof_t
WHERE kind IN ('all_null', 'constant_zero', 'binary_sparse', 'sparse')""")
add("threshold_hints", "symbol:s rank:i column_name:s score:i spread:d",
    lambda x: P.threshold_hints(P.column_profile(profiled(x), KEYS, PCOLS), KEYS, 3, ["return_5bar"]), """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY column_name <> 'return_5bar', score DESC, spread DESC, column_name) AS rank FROM (
  SELECT *, p90 - p10 AS spread, CASE WHEN column_name LIKE '%imbalance%' OR column_name LIKE '%volume%' THEN 4 ELSE 0 END
    + CASE WHEN kind = 'variable' THEN 2 ELSE 0 END + CASE WHEN null_rate = 0 THEN 1 ELSE 0 END + 1 AS score
  FROM prof_t WHERE kind IN ('variable', 'binary_active') AND abs(p90 - p10) > 1e-12) QUALIFY rank <= 3""")
