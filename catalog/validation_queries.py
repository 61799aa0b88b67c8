"""Gauntlet and statistical validation."""

from __future__ import annotations

from statistics import NormalDist
import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.operators import gauntlet as G
from barflow.operators import pnl as L
from barflow.operators import stats as S
from barflow.operators import trades as T

from .base import CTES, add
from .trade_queries import KEYS, metric_sql, run_sql, signal_bars, state_ctes

PNL_SQL = """SELECT *, size * {1} AS costs, (exit_price - entry_price) * direction * 20 AS gross_pnl,
  (exit_price - entry_price) * direction * 20 - {1} AS net_pnl,
  (epoch_us(exit_time) // 1000000 - epoch_us(entry_time) // 1000000) / 60 AS holding_time_min, CAST(exit_time AS DATE) AS xd FROM {0}"""
FLAT, PAID = "14.5", "bar_cost"


def stored_signals(x):
    from barflow.sources.stage import stored
    return stored(signal_bars(x).select("symbol", "ts_event", "seq", "open", "high", "low", "close", "volume", "bid_price", "ask_price",
                                        "signal"), "signals")


def numbered(src: str, keys: str) -> str:
    d = f"(PARTITION BY {keys}, date_utc ORDER BY ts_event, seq)"
    return (f"SELECT *, row_number() OVER {d} AS i, count(*) OVER (PARTITION BY {keys}, date_utc) AS n, lag(signal) OVER {d} AS prev FROM {src}")


def scored(tag: str, src: str, keys: str, cost: str = FLAT) -> None:
    """CTE ``m_<tag>``: metrics of the run trades of a signal table, per keys, at the flat cost or at that of the entry bar."""
    CTES[f"n_{tag}"] = numbered(src, keys)
    CTES[f"t_{tag}"] = run_sql(f"n_{tag}", keys, ", s.bar_cost" if cost == PAID else "")
    CTES[f"p_{tag}"] = PNL_SQL.format(f"t_{tag}", cost)
    CTES[f"m_{tag}"] = "SELECT * FROM (" + metric_sql(f"p_{tag}", keys) + ")"


CTES["ser"] = """
SELECT symbol, ts_event, seq, open, high, low, close, volume, bid_price, ask_price, signal, date_utc, row_number() OVER (PARTITION BY symbol ORDER BY ts_event, seq) - 1 AS pos,
  count(*) OVER (PARTITION BY symbol) AS total FROM sig"""
CTES["blk"] = """
SELECT symbol, min(pos) AS start, count(*) AS length, any_value(signal) AS value FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY symbol, signal ORDER BY pos) AS g FROM ser) GROUP BY symbol, signal, g"""
state_ctes("paid", "ser", "symbol")
for _t, _src in (("shuf", "ser"), ("ashuf", "paid")):
    CTES[_t] = f"""
WITH placed AS (SELECT symbol, it AS iteration, length, value, sum(length) OVER (PARTITION BY symbol, it
    ORDER BY md5('42:' || it || ':' || start), start) - length AS at_pos FROM blk, range(1, 101) AS r(it))
SELECT p.iteration, s.* EXCLUDE (signal), p.value AS signal FROM placed p JOIN {_src} s ON s.symbol = p.symbol
  AND s.pos >= p.at_pos AND s.pos < p.at_pos + p.length"""
    CTES["p" + _t[:-4] + "ert"] = f"""
WITH live AS (SELECT symbol, pos, it, row_number() OVER (PARTITION BY symbol, it ORDER BY md5('42:' || it || ':' || epoch_us(ts_event) || ':' || seq), pos) AS rn,
    count(*) OVER (PARTITION BY symbol, it) AS cnt FROM {_src}, range(1, 21) AS r(it) WHERE signal <> 0)
SELECT s.* EXCLUDE (signal), r.it AS iteration, CASE WHEN l.rn <= greatest(1, floor(l.cnt * 0.1)) THEN -signal ELSE signal END AS signal
FROM {_src} s CROSS JOIN range(1, 21) AS r(it) LEFT JOIN live l ON l.symbol = s.symbol AND l.pos = s.pos AND l.it = r.it"""
CTES["fold"] = """
SELECT s.*, f AS fold FROM ser s JOIN range(0, 6) AS r(f) ON s.pos >= f * total // 6 AND s.pos < (f + 1) * total // 6"""
CTES["fw"] = """
SELECT symbol, fold, min(ts_event) AS a, max(ts_event) AS z, first(open ORDER BY pos) AS fo, last(close ORDER BY pos) AS fc
FROM fold WHERE fold >= 1 GROUP BY ALL"""
CTES["chunk"] = "SELECT *, least(pos // (total // 4), 3) AS chunk FROM ser"
CTES["dvol"] = """
SELECT symbol, date_utc, stddev_samp(r) AS daily_vol FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol, date_utc ORDER BY pos) - 1 AS r FROM ser)
GROUP BY ALL HAVING stddev_samp(r) IS NOT NULL"""
state_ctes("fpaid", "fold", "symbol, fold")  # rolling costs restart in each fold and chunk
state_ctes("cpaid", "chunk", "symbol, chunk")
CTES["fcost"] = "SELECT symbol, fold, ts_event AS entry_time, arg_max(bar_cost, seq) AS bar_cost FROM fpaid GROUP BY ALL"
CHECK_SQL: dict[str, str] = {}
for _a, _cost, _base, _chunk in (("", FLAT, "ser", "chunk"), ("a", PAID, "paid", "cpaid")):
    scored(f"{_a}base", _base, "symbol", _cost)
    scored(f"{_a}shuffled", f"{_a}shuf", "symbol, iteration", _cost)
    scored(f"{_a}perturbed", f"p{_a}ert", "symbol, iteration", _cost)
    scored(f"{_a}chunk", _chunk, "symbol, chunk", _cost)
    CTES[f"{_a}ftr"] = """
SELECT t.symbol, fold, greatest(entry_time, a) AS entry_time, least(exit_time, z) AS exit_time,
  CASE WHEN entry_time < a THEN fo ELSE entry_price END AS entry_price, CASE WHEN exit_time > z THEN fc ELSE exit_price END AS exit_price,
  direction, size FROM t_base t JOIN fw ON fw.symbol = t.symbol AND entry_time < z AND exit_time >= a"""
    CTES[f"p_{_a}fold"] = PNL_SQL.format("ftr" if not _a else "(SELECT aftr.*, bar_cost FROM aftr JOIN fcost USING (symbol, fold, entry_time))", _cost)
    CTES[f"m_{_a}fold"] = "SELECT * FROM (" + metric_sql(f"p_{_a}fold", "symbol, fold") + ")"
    CTES[f"{_a}wf"] = f"""SELECT symbol, fold, coalesce(trade_count, 0) AS trade_count, coalesce(net_pnl, 0) AS net_pnl, coalesce(sharpe_ratio, 0) AS sharpe_ratio
FROM fw LEFT JOIN m_{_a}fold USING (symbol, fold)"""
    CTES[f"p_{_a}reg"] = f"""
SELECT p.*, CASE WHEN v.daily_vol > md THEN 'high' ELSE 'low' END AS regime FROM p_{_a}base p
JOIN dvol v ON v.symbol = p.symbol AND v.date_utc = CAST(p.entry_time AS DATE)
JOIN (SELECT symbol, median(daily_vol) AS md FROM dvol GROUP BY symbol) q ON q.symbol = p.symbol"""
    CTES[f"m_{_a}reg"] = "SELECT * FROM (" + metric_sql(f"p_{_a}reg", "symbol, regime") + ")"

    def shuffle_sql(times: int, a: str = _a) -> str:
        return f"""
SELECT *, CASE WHEN percentile >= 95 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
  SELECT m.symbol, any_value(b.sharpe_ratio) AS real_sharpe, avg(coalesce(m.sharpe_ratio, 0)) AS shuffle_mean, stddev_samp(coalesce(m.sharpe_ratio, 0)) AS shuffle_std,
    count(*) FILTER (coalesce(m.sharpe_ratio, 0) <= b.sharpe_ratio) / count(*) * 100 AS percentile
  FROM (SELECT * FROM m_{a}shuffled WHERE iteration <= {times}) m JOIN m_{a}base b USING (symbol) GROUP BY m.symbol)"""

    CHECK_SQL |= {
        f"{_a}shuffle": shuffle_sql(100), f"{_a}shuffle_20": shuffle_sql(20), f"{_a}walk_forward": f"""
SELECT symbol, count(*) AS fold_count, count(*) FILTER (net_pnl > 0) AS profitable_folds,
  CASE WHEN count(*) FILTER (net_pnl > 0) > count(*) / 2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {_a}wf GROUP BY symbol""",
        f"{_a}regime": f"""
SELECT *, CASE WHEN high_vol_pnl > 0 AND low_vol_pnl > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT symbol,
  coalesce(max(sharpe_ratio) FILTER (regime = 'high'), 0) AS high_vol_sharpe, coalesce(max(sharpe_ratio) FILTER (regime = 'low'), 0) AS low_vol_sharpe,
  coalesce(max(net_pnl) FILTER (regime = 'high'), 0) AS high_vol_pnl, coalesce(max(net_pnl) FILTER (regime = 'low'), 0) AS low_vol_pnl
  FROM m_{_a}reg GROUP BY symbol)""",
        f"{_a}perturbation": f"""
SELECT *, (baseline_sharpe - perturbed_mean) / abs(baseline_sharpe) * 100 AS degradation_pct,
  CASE WHEN baseline_sharpe > 0 AND perturbed_mean >= 0.5 * baseline_sharpe THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
  SELECT m.symbol, any_value(b.sharpe_ratio) AS baseline_sharpe, avg(coalesce(m.sharpe_ratio, 0)) AS perturbed_mean,
    stddev_samp(coalesce(m.sharpe_ratio, 0)) AS perturbed_std FROM m_{_a}perturbed m JOIN m_{_a}base b USING (symbol) GROUP BY m.symbol)""",
        f"{_a}cost_sensitivity": f"""
SELECT symbol, net_pnl AS pnl_1x, gross_pnl - 1.5 * total_costs AS pnl_1_5x, gross_pnl - 2 * total_costs AS pnl_2x, sharpe_ratio AS sharpe_1x,
  CASE WHEN gross_pnl - 1.5 * total_costs > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m_{_a}base""",
        f"{_a}decay": f"""
SELECT *, CASE WHEN is_declining = 0 AND last_pnl > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
  SELECT symbol, count(*) AS chunk_count, regr_slope(s, chunk) AS trend_slope, regr_r2(s, chunk) AS trend_r_squared, arg_max(net_pnl, chunk) AS last_pnl,
    CASE WHEN regr_slope(s, chunk) < 0 AND regr_r2(s, chunk) >= 0.5 AND avg(s) FILTER (chunk >= 2) <= 0.9 * avg(s) FILTER (chunk < 2) THEN 1 ELSE 0 END
      AS is_declining FROM (SELECT *, coalesce(sharpe_ratio, 0) AS s FROM m_{_a}chunk) GROUP BY symbol)"""}

CTES["paid_flips"] = "SELECT symbol, ts_event, seq, iteration, signal FROM pert"
add("signal_blocks", "symbol:s start:i length:i value:i", lambda x: G.signal_blocks(signal_bars(x), KEYS), "SELECT * FROM blk")
add("perturbed_signals", "symbol:s ts_event:t seq:i iteration:i signal:i", lambda x: G.perturbed_signals(stored_signals(x), KEYS, 0.1, 20, 42), "SELECT * FROM paid_flips")
for _end, _a, _paid in (("", "", False), ("_adaptive", "a", True)):
    add(f"shuffle_test{_end}", "symbol:s real_sharpe:d shuffle_mean:d shuffle_std:d percentile:d verdict:s",
        lambda x, p=_paid: G.shuffle_test(stored_signals(x), KEYS, 100, adaptive=p), CHECK_SQL[f"{_a}shuffle"])
    add(f"walk_forward_folds{_end}", "symbol:s fold:i trade_count:i net_pnl:d sharpe_ratio:d",
        lambda x, p=_paid: G.walk_forward_folds(stored_signals(x), KEYS, 5, adaptive=p), f"SELECT * FROM {_a}wf")
    add(f"walk_forward_test{_end}", "symbol:s fold_count:i profitable_folds:i verdict:s",
        lambda x, p=_paid: G.walk_forward_test(stored_signals(x), KEYS, 5, adaptive=p), CHECK_SQL[f"{_a}walk_forward"])
    add(f"regime_test{_end}", "symbol:s high_vol_sharpe:d low_vol_sharpe:d high_vol_pnl:d low_vol_pnl:d verdict:s",
        lambda x, p=_paid: G.regime_test(stored_signals(x), KEYS, adaptive=p), CHECK_SQL[f"{_a}regime"])
    add(f"signal_perturbation_test{_end}", "symbol:s baseline_sharpe:d perturbed_mean:d perturbed_std:d degradation_pct:d verdict:s",
        lambda x, p=_paid: G.perturbation_test(stored_signals(x), KEYS, adaptive=p), CHECK_SQL[f"{_a}perturbation"])
    add(f"cost_sensitivity_test{_end}", "symbol:s pnl_1x:d pnl_1_5x:d pnl_2x:d sharpe_1x:d verdict:s",
        lambda x, p=_paid: G.cost_sensitivity_test(stored_signals(x), KEYS, adaptive=p), CHECK_SQL[f"{_a}cost_sensitivity"])
    add(f"decay_test{_end}", "symbol:s chunk_count:i trend_slope:d trend_r_squared:d is_declining:i last_pnl:d verdict:s",
        lambda x, p=_paid: G.decay_test(stored_signals(x), KEYS, 4, adaptive=p).withColumn("is_declining", F.col("is_declining").cast("int")), CHECK_SQL[f"{_a}decay"])
CHECK_SQL["trade_count"] = "SELECT symbol, trade_count, CASE WHEN trade_count >= {} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m_base"
add("trade_count_test", "symbol:s trade_count:i verdict:s", lambda x: G.trade_count_test(signal_bars(x), KEYS, 150), CHECK_SQL["trade_count"].format(150))


def check_sql_by_name(min_trades: int) -> dict[str, str]:
    """SQL of the gauntlet's checks at adaptive costs, by name."""
    return {"shuffle": CHECK_SQL["ashuffle_20"], **{c: CHECK_SQL[f"a{c}"] for c in ("walk_forward", "regime")}, "signal_perturbation": CHECK_SQL["aperturbation"],
            **{c: CHECK_SQL[f"a{c}"] for c in ("cost_sensitivity", "decay")}, "trade_count": CHECK_SQL["trade_count"].format(min_trades)}


_CHECKS = check_sql_by_name(50)
add("validation_gauntlet", "symbol:s shuffle:s walk_forward:s regime:s signal_perturbation:s cost_sensitivity:s decay:s trade_count:s "
    "pass_count:i overall_verdict:s", lambda x: G.gauntlet(stored_signals(x), KEYS, iterations=20), f"""
SELECT *, CASE WHEN pass_count = {len(_CHECKS)} THEN 'PASS' ELSE 'FAIL' END AS overall_verdict FROM (
  SELECT symbol, {", ".join(f"max(verdict) FILTER (name = '{c}') AS {c}" for c in _CHECKS)}, count(*) FILTER (verdict = 'PASS') AS pass_count
  FROM ({" UNION ALL ".join(f"SELECT symbol, '{c}' AS name, verdict FROM ({q})" for c, q in _CHECKS.items())}) GROUP BY symbol)""")

# --- statistics
N_TRIALS = 20
_Q = NormalDist().inv_cdf
_EMAX = (1 - S.EULER_GAMMA) * _Q(1 - 1 / N_TRIALS) + S.EULER_GAMMA * _Q(1 - 1 / (N_TRIALS * math.e))
_PHI = ("(0.5 + z / 2000 / 3 / sqrt(2 * pi()) * (SELECT sum(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END "
        "* exp(0 - ((z * k / 2000) ** 2) / 2)) FROM range(0, 2001) AS r(k)))")
CTES["dret"] = "SELECT symbol, xd, sum(net_pnl) AS x FROM p_base GROUP BY ALL"
CTES["dsr1"] = """
SELECT symbol, n AS sample_count, mu / sd AS sharpe, sk, ku, sqrt(greatest(1 - sk * mu / sd + (ku - 3) / 4 * (mu / sd) ** 2, 1e-9) / (n - 1)) AS se FROM (
  SELECT symbol, count(*) AS n, any_value(m) AS mu, any_value(s) AS sd, avg(((x - m) / s) ** 3) AS sk, avg(((x - m) / s) ** 4) AS ku FROM (
    SELECT *, avg(x) OVER (PARTITION BY symbol) AS m, stddev_samp(x) OVER (PARTITION BY symbol) AS s FROM dret) GROUP BY symbol)"""
CTES["dsr2"] = f"SELECT *, se * {_EMAX!r} AS emax, (sharpe - se * {_EMAX!r}) / se AS z FROM dsr1"


def _daily(x):
    return L.trade_pnl(T.run_trades(signal_bars(x), KEYS)).groupBy("symbol", F.to_date("exit_time").alias("date")).agg(F.sum("net_pnl").alias("x"))


add("deflated_sharpe", "symbol:s sample_count:i sharpe:d skew:d kurtosis:d sharpe_std_error:d expected_max_sharpe_null:d z_score:d dsr:d",
    lambda x: S.deflated_sharpe(_daily(x), KEYS, "x", N_TRIALS), f"""
SELECT *, sk AS skew, ku AS kurtosis, se AS sharpe_std_error, emax AS expected_max_sharpe_null, z AS z_score, {_PHI} AS dsr FROM dsr2""")
CTES["cs"] = """SELECT user_id % 10 AS candidate, day(ts) // 6 AS split, avg(value) AS score FROM events GROUP BY ALL"""


def _scores(x):
    return x.table("events").groupBy((F.col("user_id") % 10).alias("candidate"), F.expr("day(ts) div 6").alias("split")).agg(F.avg("value").alias("score"))


CTES["pbo1"] = """
WITH ins AS (SELECT a.candidate, a.split, a.score, avg(b.score) AS in_sample FROM cs a JOIN cs b ON b.candidate = a.candidate AND b.split <> a.split GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score, candidate) AS rk, count(*) OVER (PARTITION BY split) AS n FROM ins)
SELECT split, candidate, n AS candidate_count, least(greatest(rk / n, 1e-6), 1 - 1e-6) AS oos_percentile FROM r
QUALIFY row_number() OVER (PARTITION BY split ORDER BY in_sample DESC, candidate) = 1"""
add("overfit_splits", "split:i candidate:i candidate_count:i oos_percentile:d logit:d", lambda x: S.overfit_splits(_scores(x)),
    "SELECT *, ln(oos_percentile / (1 - oos_percentile)) AS logit FROM pbo1")
add("overfit_probability", "effective_split_count:i candidate_count:i under_median_count:i lambda_mean:d lambda_std:d pbo:d",
    lambda x: S.overfit_probability(_scores(x)), """
SELECT count(*) AS effective_split_count, max(candidate_count) AS candidate_count, count(*) FILTER (oos_percentile < 0.5) AS under_median_count,
  avg(ln(oos_percentile / (1 - oos_percentile))) AS lambda_mean, stddev_pop(ln(oos_percentile / (1 - oos_percentile))) AS lambda_std,
  count(*) FILTER (oos_percentile < 0.5) / count(*) AS pbo FROM pbo1""")
CTES["rs"] = """
WITH s AS (SELECT symbol, min(xd) AS a, max(xd) AS z FROM dret GROUP BY symbol),
w AS (SELECT symbol, k, a + CAST(k * 2 AS INT) AS lo, a + CAST(k * 2 + 10 AS INT) AS hi FROM s, range(0, 50) AS r(k) WHERE k * 2 + 10 <= date_diff('day', a, z) + 1)
SELECT w.symbol, k * 2 + 5.0 AS midpoint, CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(252) ELSE 0 END AS sharpe
FROM w JOIN dret d ON d.symbol = w.symbol AND d.xd >= w.lo AND d.xd < w.hi GROUP BY w.symbol, k HAVING count(*) >= 2"""


def _rolling(x):
    return S.rolling_sharpe(L.trade_pnl(T.run_trades(signal_bars(x), KEYS)), KEYS, 10, 2)


add("rolling_sharpe", "symbol:s midpoint:d sharpe:d", _rolling, "SELECT * FROM rs")
CTES["adecay"] = """
WITH q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY midpoint) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rs),
g AS (SELECT symbol, count(*) AS window_count, count(*) FILTER (sharpe > 0) AS np, median(sharpe) FILTER (i > n - greatest(n // 3, 1)) AS terminal_sharpe,
  avg(CASE WHEN sharpe <= 0 THEN 1 ELSE 0 END) FILTER (i > n - greatest(n // 3, 1)) AS tf,
  coalesce(regr_slope(ln(CASE WHEN sharpe > 0 THEN sharpe END), midpoint), 0) AS sl, avg(ln(CASE WHEN sharpe > 0 THEN sharpe END)) AS my,
  avg(midpoint) FILTER (sharpe > 0) AS mt, coalesce(regr_r2(ln(CASE WHEN sharpe > 0 THEN sharpe END), midpoint), 0) AS r2 FROM q GROUP BY symbol),
h AS (SELECT *, window_count >= 2 AND (np = 0 OR np >= 2) AS ok, CASE WHEN np > 0 AND sl < 0 THEN ln(2) / -sl END AS hl FROM g)
SELECT symbol, window_count, terminal_sharpe, tf AS tail_nonpositive_fraction, CASE WHEN ok AND np > 0 THEN -sl END AS decay_rate,
  CASE WHEN ok THEN CASE WHEN np = 0 THEN 0 ELSE exp(my - sl * mt) END END AS initial_sharpe, CASE WHEN ok THEN r2 END AS r_squared,
  CASE WHEN ok THEN CASE WHEN np = 0 THEN 0 ELSE hl END END AS half_life_days,
  CASE WHEN NOT ok THEN 'INSUFFICIENT_DATA' WHEN np = 0 OR tf = 1 THEN 'DEAD' WHEN terminal_sharpe <= 0 OR tf >= 0.5 THEN 'DECAYING'
    WHEN hl IS NULL OR hl > 120 THEN 'STABLE' WHEN r2 > 0.3 THEN 'DECAYING' ELSE 'NOISY' END AS decay_verdict FROM h"""
add("alpha_decay", "symbol:s window_count:i terminal_sharpe:d tail_nonpositive_fraction:d decay_rate:d initial_sharpe:d r_squared:d "
    "half_life_days:d verdict:s", lambda x: S.alpha_decay(_rolling(x), KEYS, 2), "SELECT *, decay_verdict AS verdict FROM adecay")
CTES["fret"] = """
SELECT *, lag(market_return) OVER (PARTITION BY symbol ORDER BY date) AS momentum FROM (
  SELECT symbol, date, c / lag(c) OVER k - 1 AS market_return, daily_vol - lag(daily_vol) OVER k AS volatility_change FROM (
    SELECT symbol, date_utc AS date, last(close ORDER BY pos) AS c FROM ser GROUP BY ALL) d LEFT JOIN dvol v ON v.symbol = d.symbol AND v.date_utc = d.date
  WINDOW k AS (PARTITION BY d.symbol ORDER BY date))""".replace("SELECT symbol, date, c", "SELECT d.symbol, date, c")
add("factor_returns", "symbol:s date:D market_return:d volatility_change:d momentum:d", lambda x: S.factor_returns(signal_bars(x), KEYS), "SELECT * FROM fret")
CTES["fat"] = """
WITH j AS (SELECT d.symbol, x AS y, market_return AS f1, volatility_change AS f2, momentum AS f3 FROM dret d JOIN fret f ON f.symbol = d.symbol AND f.date = d.xd
  WHERE market_return IS NOT NULL AND volatility_change IS NOT NULL AND momentum IS NOT NULL),
s AS (SELECT symbol, count(*) AS n, avg(y) AS my, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3, var_pop(f1) AS a, covar_pop(f1, f2) AS b, covar_pop(f1, f3) AS c,
  var_pop(f2) AS d, covar_pop(f2, f3) AS e, var_pop(f3) AS f, covar_pop(f1, y) AS p, covar_pop(f2, y) AS q, covar_pop(f3, y) AS r, var_pop(y) AS vy FROM j GROUP BY symbol),
t AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s)
SELECT symbol, n AS n_days, vy, a, b, c, d, e, f, det, p, q, r, my, m1, m2, m3, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS b1,
  (a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - c * q)) / det AS b2, (a * (d * r - e * q) - b * (b * r - c * q) + p * (b * e - c * d)) / det AS b3 FROM t"""
_TAIL = _PHI.replace("z ", "az ").replace("((z *", "((az *").replace("+ z /", "+ az /")
_ONE = ["alpha", *S._FACTORS]
_LEVEL = math.erfc(2.0 / math.sqrt(2.0))
CTES["fat2"] = """
SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, (b1 * p + b2 * q + b3 * r) / vy AS r_squared,
  n_days * (vy - b1 * p - b2 * q - b3 * r) / (n_days - 4) / n_days AS s2, (d * f - e * e) / det AS i11, (a * f - c * c) / det AS i22, (a * d - b * b) / det AS i33,
  (c * e - b * f) / det AS i12, (b * e - c * d) / det AS i13, (b * c - a * e) / det AS i23 FROM fat"""
CTES["fat3"] = """
SELECT symbol, unnest([0, 1, 2, 3]) AS i, unnest([b0 / sqrt(s2 * (1 + m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33 + 2 * m1 * m2 * i12 + 2 * m1 * m3 * i13 + 2 * m2 * m3 * i23)),
  b1 / sqrt(s2 * i11), b2 / sqrt(s2 * i22), b3 / sqrt(s2 * i33)]) AS t FROM fat2"""
CTES["fat4"] = f"""
SELECT *, least(1, max(pv * (5 - k)) OVER (PARTITION BY symbol ORDER BY k)) AS adj FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pv, i) AS k FROM (SELECT symbol, i, t, 2 * (1 - {_TAIL}) AS pv FROM (SELECT *, abs(t) AS az FROM fat3)))"""
CTES["fat5"] = "SELECT symbol, " + ", ".join(f"max({c}) FILTER (i = {i}) AS {n}{i}" for c, n in (("t", "t"), ("pv", "p"), ("adj", "j")) for i in range(4)) + " FROM fat4 GROUP BY symbol"
CTES["fver"] = f"""
SELECT f.*, g.* EXCLUDE (symbol), CASE WHEN r_squared < 0.3 AND j0 <= {_LEVEL!r} THEN 'PURE_ALPHA' WHEN r_squared >= 0.3 AND j0 <= {_LEVEL!r} AND least(j1, j2, j3) <= {_LEVEL!r} THEN 'ALPHA_WITH_BETA_EXPOSURE'
  WHEN r_squared >= 0.3 AND least(j1, j2, j3) <= {_LEVEL!r} THEN 'FACTOR_EXPOSED' ELSE 'INCONCLUSIVE' END AS verdict FROM fat2 f JOIN fat5 g USING (symbol)"""


def attribution(x, min_days=None):
    return S.factor_attribution(L.trade_pnl(T.run_trades(signal_bars(x), KEYS)), x.stored_bars(), KEYS, min_days)


add("factor_attribution", "symbol:s n_days:i available:i alpha_daily:d alpha_annualized:d alpha_t_stat:d alpha_pvalue:d alpha_pvalue_adjusted:d "
    + " ".join(f"{n}_{f}:d" for n in ("beta", "t", "p", "p_adj") for f in S._FACTORS) + " r_squared:d residual_sharpe:d active_factors:s design_rank:i regression_stable:i verdict:s",
    lambda x: attribution(x).withColumns({c: F.col(c).cast("int") for c in ("available", "regression_stable")}), f"""
SELECT *, 1 AS available, b0 AS alpha_daily, 252 * b0 AS alpha_annualized, t0 AS alpha_t_stat, p0 AS alpha_pvalue, j0 AS alpha_pvalue_adjusted,
  {", ".join(f"{c}{i + 1} AS {n}_{f}" for c, n in (("b", "beta"), ("t", "t"), ("p", "p"), ("j", "p_adj")) for i, f in enumerate(S._FACTORS))},
  0 AS residual_sharpe, 'market_return,volatility_change,momentum' AS active_factors, 4 AS design_rank, 1 AS regression_stable FROM fver""")
add("factor_attribution_short", "symbol:s n_days:i available:i alpha_daily:d verdict:s",
    lambda x: attribution(x, 1000).withColumn("available", F.col("available").cast("int")),
    "SELECT symbol, n_days, 0 AS available, NULL AS alpha_daily, 'INSUFFICIENT_DATA' AS verdict FROM fat")
_DF = ["close", "volume", "trade_count", "latency_mean", "spread"]


def _sides(x):
    df = x.bars().withColumn("spread", F.expr("ask_price - bid_price"))
    return df.filter(F.col("session_date") < "2024-01-16"), df.filter(F.col("session_date") >= "2024-01-16")


_MOM = "avg({0}) FILTER (session_date < DATE '2024-01-16') AS a, avg({0}) FILTER (session_date >= DATE '2024-01-16') AS z, var_pop({0}) FILTER (session_date < DATE '2024-01-16') AS va, var_pop({0}) FILTER (session_date >= DATE '2024-01-16') AS vz"
CTES["drf"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_MOM.format(c)} FROM (SELECT *, ask_price - bid_price AS spread FROM b)" for c in _DF)
CTES["drf2"] = "SELECT *, a AS train_mean, z AS holdout_mean, (z - a) / sqrt(greatest((va + vz) / 2, 1e-9)) AS std_mean_diff FROM drf"
add("feature_drift", "feature:s train_mean:d holdout_mean:d std_mean_diff:d", lambda x: S.drift(*_sides(x), _DF), "SELECT * FROM drf2")
_GAP = "(z - a) / sqrt(greatest((va + vz) / 2, 1e-9))"


def _importance(x):
    """Weights of the columns by their spread between symbols, so the ranking has importances that the SQL can make too."""
    d = x.bars().withColumn("spread", F.expr("ask_price - bid_price")).groupBy("symbol").agg(*[F.avg(c).alias(c) for c in _DF])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.round((F.max(c) - F.min(c)) / F.greatest(F.avg(F.abs(c)), F.lit(1e-9)), 6).alias("importance")) for c in _DF])
    return d.agg(cells.alias("r")).select(F.explode("r").alias("r")).select("r.*")


CTES["wgt"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, round((max(v) - min(v)) / greatest(avg(abs(v)), 1e-9), 6) AS importance FROM (SELECT symbol, avg({c}) AS v FROM "
                                 "(SELECT *, ask_price - bid_price AS spread FROM b) GROUP BY symbol)" for c in _DF)
add("drift_ranking", "feature:s std_mean_diff:d importance:d combined_rank_score:d train_mean:d holdout_mean:d",
    lambda x: S.drift_ranking(S.drift(*_sides(x), _DF), _importance(x), 3), """
SELECT *, CAST(row_number() OVER (ORDER BY importance, feature) + row_number() OVER (ORDER BY abs(std_mean_diff), feature) AS DOUBLE) AS combined_rank_score
FROM drf2 JOIN wgt USING (feature) ORDER BY combined_rank_score DESC, feature LIMIT 3""")
CTES["side"] = "SELECT CASE WHEN session_date < DATE '2024-01-16' THEN 0 ELSE 1 END AS label, count(*) AS n FROM b GROUP BY 1"


def _forest(x):
    return S.adversarial_validation(*_sides(x), _DF, trees=30)


def _split_rows(x):
    a, z = _sides(x)
    return S.class_split(a.withColumn("label", F.lit(0)).unionByName(z.withColumn("label", F.lit(1))), "label", ["symbol", *_DF])


add("adversarial_split", "label:i rows:i fit_rows:i", lambda x: _split_rows(x).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if("fit").alias("fit_rows")),
    "SELECT label, n AS rows, greatest(1, floor(n * 0.7)) AS fit_rows FROM side")
add("adversarial_report", "used:i reason:s feature_count:i train_rows:i holdout_rows:i validation_rows:i", lambda x: _forest(x)[0].withColumn("used", F.col("used").cast("int")), f"""
SELECT 1 AS used, NULL AS reason, {len(_DF)} AS feature_count, max(n) FILTER (label = 0) AS train_rows, max(n) FILTER (label = 1) AS holdout_rows,
  sum(n - greatest(1, floor(n * 0.7))) AS validation_rows FROM side""")
add("adversarial_validation", "feature:s importance:d combined_rank_score:d auc:d", lambda x: (lambda r: r[1].join(r[0].select("auc"), F.lit(True)))(_forest(x)))
add("adversarial_too_small", "used:i reason:s feature_count:i auc:d", lambda x: S.adversarial_validation(*_sides(x), _DF[:2])[0].unionByName(
    S.adversarial_validation(_sides(x)[0].filter("symbol = 'S0' and seq < 0"), _sides(x)[1], _DF)[0]).withColumn("used", F.col("used").cast("int")), f"""
SELECT 0 AS used, 'insufficient_common_features' AS reason, 2 AS feature_count, 0.5 AS auc UNION ALL SELECT 0, 'insufficient_rows', {len(_DF)}, 0.5""")
add("exact_auc", "source:s positives:i negatives:i auc:d", lambda x: S.exact_auc(x.table("events").select(
    F.concat(F.lit("u"), F.col("user_id") % 5).alias("source"), F.round("value", 1).alias("score"), (F.col("event_type") == "error").cast("int").alias("label")), "score", "label", ["source"]), """
SELECT source, any_value(p) AS positives, any_value(n) AS negatives, sum(CASE WHEN label = 1 THEN rk END) / any_value(p) / any_value(n) - (any_value(p) + 1) / 2 / any_value(n) AS auc FROM (
  SELECT *, avg(r) OVER (PARTITION BY source, score) AS rk, count(*) FILTER (label = 1) OVER (PARTITION BY source) AS p, count(*) FILTER (label = 0) OVER (PARTITION BY source) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY score) AS r FROM (
      SELECT 'u' || (user_id % 5) AS source, round(value, 1) AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)))
GROUP BY source""")


def _gate_rows(x):
    """Results of the symbols, and of one more of each whose two returns are too few for a deflated Sharpe."""
    daily = _daily(x)
    few = daily.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy("date"))).filter("r <= 2").select(F.concat("symbol", F.lit(".new")).alias("symbol"), "date", "x")
    dsr = S.deflated_sharpe(daily.unionByName(few), KEYS, "x", N_TRIALS).select("symbol", "dsr", F.col("available").alias("dsr_available"))
    decay = S.alpha_decay(_rolling(x), KEYS, 2).select("symbol", F.col("verdict").alias("decay_verdict"))
    factor = attribution(x).select("symbol", F.col("verdict").alias("factor_verdict"))
    return dsr.join(decay, "symbol", "left").join(factor, "symbol", "left")


add("advanced_gates", "symbol:s dsr:d dsr_available:i decay_verdict:s factor_verdict:s dsr_passed:i decay_passed:i factor_passed:i enabled:i passed:i",
    lambda x: S.advanced_gates(_gate_rows(x), 0.0, ["STABLE", "NOISY", "DEAD"], ["INCONCLUSIVE", "PURE_ALPHA"]).withColumns(
        {c: F.col(c).cast("int") for c in ("dsr_available", "dsr_passed", "decay_passed", "factor_passed", "enabled", "passed")}), f"""
SELECT *, 1 AS enabled, CASE WHEN dsr_passed + decay_passed + factor_passed = 3 THEN 1 ELSE 0 END AS passed FROM (
SELECT w.symbol, coalesce(dsr, 0) AS dsr, CASE WHEN dsr IS NULL THEN 0 ELSE 1 END AS dsr_available, decay_verdict, verdict AS factor_verdict, CASE WHEN dsr >= 0 THEN 1 ELSE 0 END AS dsr_passed,
  CASE WHEN decay_verdict IN ('STABLE', 'NOISY', 'DEAD') THEN 1 ELSE 0 END AS decay_passed, CASE WHEN verdict IN ('INCONCLUSIVE', 'PURE_ALPHA') THEN 1 ELSE 0 END AS factor_passed
FROM (SELECT symbol || x AS symbol FROM dsr2, (VALUES (''), ('.new')) AS v(x)) w LEFT JOIN (SELECT symbol, {_PHI} AS dsr FROM dsr2) d USING (symbol)
LEFT JOIN adecay USING (symbol) LEFT JOIN fver USING (symbol))""")


def clone(roots: dict[str, str], suffix: str) -> None:
    """The CTEs of signals, trades, checks and attribution once more, under names with ``suffix``, over other root tables."""
    names = [n for n in CTES if n in _CLONED or n.startswith(("n_", "t_", "p_", "m_"))]
    clone.names, clone.suffix, clone.roots = names, suffix, roots
    for n in names:
        CTES[n + suffix] = clone.sql(CTES[n])


def _cloned(sql: str) -> str:
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, [*clone.names, *clone.roots])) + r")\b")
    return pattern.sub(lambda m: clone.roots.get(m.group(1), m.group(1) + clone.suffix), sql)


clone.sql = _cloned
_CLONED = {"sn", "ev", "ser", "blk", "paid", "paid1", "paid2", "shuf", "ashuf", "pert", "paert", "fold", "fw", "chunk", "dvol", "fpaid", "fpaid1", "fpaid2", "cpaid", "cpaid1", "cpaid2",
           "fcost", "ftr", "aftr", "wf", "awf", "fret", "fat", "fat2", "fat3", "fat4", "fat5", "fver", "dret"}
