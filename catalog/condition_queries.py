"""Condition tables: rules, feasibility, conflicts and thresholds, for several briefs at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import conditions as C
from barflow.operators import profiling as P

from .base import CTES, add
from .edge_queries import edge_bars
from .feature_queries import fr

SAMPLE = ["symbol", "session_date"]
# brief, pos, feature, op, role, parameters of the comparison or of both bounds
BRIEFS = [
    ("calm", 0, "volume_imbalance", ">", "primary", ("vi",)), ("calm", 1, "return_5bar", "between", "primary", ("sl_ticks_lo", "hi")),
    ("calm", 2, "absorption_signal", "bool_true", "confirmation", ()),
    ("fall", 0, "return_5bar", "<", "primary", ("r",)), ("fall", 1, "return_5bar", "<", "confirmation", ("r",)),
    ("busy", 0, "volume", ">=", "primary", ("v",)), ("busy", 1, "return_5bar", "between", "primary", ("lo", "hi")),
    ("rare", 0, "volume_imbalance", ">=", "primary", ("vi",)), ("rare", 1, "return_5bar", "between", "confirmation", ("lo", "hi")),
    ("absent", 0, "volume_imbalance", ">", "primary", ("vi",)), ("absent", 1, "no_such_column", "<=", "primary", ("r",)),
    ("yesterday", 0, "prev_day_none", ">", "primary", ("vi",)), ("yesterday", 1, "volume", ">=", "primary", ("v",)),
    ("dead", 0, "dead_null", "bool_false", "confirmation", ()), ("dead", 1, "absorption_signal", "bool_false", "primary", ()),
]
PARAMS = [("calm", "vi", 0.6), ("calm", "sl_ticks_lo", -0.02), ("calm", "hi", 0.02), ("fall", "r", 0.0), ("busy", "v", 100.0), ("busy", "lo", -0.5), ("busy", "hi", 0.5),
          ("rare", "vi", 0.9), ("rare", "lo", 0.9), ("rare", "hi", 0.95), ("absent", "vi", 0.6), ("absent", "r", 1.0), ("yesterday", "vi", 0.0), ("yesterday", "v", 0.0)]


def condition_bars(x):
    return edge_bars(x).withColumns({c: F.lit(None).cast("double") for c in ("prev_day_none", "dead_null")})


def briefs(x):
    rows = [(b, i, f, o, r, *(p if len(p) == 1 else ("",)), *(p if len(p) == 2 else ("", ""))) for b, i, f, o, r, p in BRIEFS]
    conditions = x.spark.createDataFrame(rows, "brief string, pos int, feature string, op string, role string, param_key string, param_key_low string, param_key_high string")
    return C.condition_table(conditions, x.spark.createDataFrame(PARAMS, "brief string, param_key string, value double"))


def _value(brief: str, key: str) -> str:
    return next((repr(v) for b, k, v in PARAMS if (b, k) == (brief, key)), "NULL")


def _sql_row(b, i, f, o, r, p) -> str:
    one, two = (p if len(p) == 1 else ("",)), (p if len(p) == 2 else ("", ""))
    texts = ", ".join(f"'{t}'" for t in (b, f, o, r, *one, *two))
    return f"({texts}, {i}, CAST({_value(b, one[0])} AS DOUBLE), CAST({_value(b, two[0])} AS DOUBLE), CAST({_value(b, two[1])} AS DOUBLE))"


CTES["cond"] = ("SELECT * FROM (VALUES " + ", ".join(_sql_row(*r) for r in BRIEFS)
                + ") AS v(brief, feature, op, role, param_key, param_key_low, param_key_high, pos, value, low, high)")
CTES["crow"] = "SELECT symbol, session_date, volume_imbalance, return_5bar, absorption_signal, volume, row_number() OVER (ORDER BY symbol, session_date, ts_event, seq) AS rid FROM xb"
_COLS = ("volume_imbalance", "return_5bar", "absorption_signal", "volume")
CTES["cval"] = " UNION ALL ".join(f"SELECT symbol, session_date, rid, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM crow WHERE {c} IS NOT NULL" for c in _COLS)
CTES["cmet"] = """
SELECT r.symbol, r.session_date, r.rid, c.*, v.x IS NOT NULL AS fin, coalesce(CASE op WHEN '>' THEN x > c.value WHEN '>=' THEN x >= c.value WHEN '<' THEN x < c.value
  WHEN '<=' THEN x <= c.value WHEN 'between' THEN x BETWEEN c.low AND c.high WHEN 'bool_true' THEN x > 0.5 ELSE x <= 0.5 END, false) AS ok
FROM crow r CROSS JOIN cond c LEFT JOIN cval v ON v.rid = r.rid AND v.feature = c.feature"""


def _through(keys: str) -> str:
    own = f"{keys}, brief, feature, op, role, param_key, param_key_low, param_key_high, pos, value, low, high"
    k = f"{keys}, brief"
    return f"""
SELECT *, CASE WHEN finite_count = 0 THEN CASE WHEN feature LIKE 'prev_day_%' THEN 'context_unavailable' ELSE 'dead_feature' END WHEN pass_count = 0 THEN 'blocks_all'
  WHEN pass_rate_pct < 1 THEN 'restrictive' ELSE 'normal' END AS severity FROM (
  SELECT {own}, count(*) FILTER (ok) AS pass_count, count(*) FILTER (fin) AS finite_count, count(*) AS total_count, any_value(combined_count) AS combined_count,
    100 * count(*) FILTER (ok) / count(*) AS pass_rate_pct
  FROM cmet JOIN (SELECT {k}, count(*) FILTER (b) AS combined_count FROM (SELECT {k}, rid, bool_and(ok) AS b FROM cmet GROUP BY ALL) GROUP BY {k}) USING ({k}) GROUP BY {own})"""


CTES["fz"] = f"""
SELECT t.*, q.* EXCLUDE (symbol, session_date, feature, is_binary_like), coalesce(q.is_binary_like, -1) AS is_binary_like, CASE WHEN bool_or(severity = 'context_unavailable') OVER w THEN 'context_unavailable'
  WHEN bool_or(severity = 'dead_feature' AND role = 'primary') OVER w THEN 'dead_feature_primary' WHEN combined_count = 0 THEN 'zero_signal'
  WHEN 100 * combined_count / total_count > 2 THEN 'over_signal' ELSE 'ok' END AS status
FROM ({_through("symbol, session_date")}) t LEFT JOIN (SELECT symbol, session_date, feature, quantile_cont(x, 0.02) AS p02, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.5) AS p50,
    quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.98) AS p98, CASE WHEN bool_and(x IN (0, 1)) THEN 1 ELSE 0 END AS is_binary_like FROM cval GROUP BY ALL) q
  ON q.symbol = t.symbol AND q.session_date = t.session_date AND q.feature = t.feature
WINDOW w AS (PARTITION BY t.symbol, t.session_date, brief)"""
IDENTITY = "brief:s feature:s op:s role:s param_key:s param_key_low:s param_key_high:s"


def feasible(x, requested=None):
    return C.feasibility(condition_bars(x), briefs(x), SAMPLE, requested).withColumn("is_binary_like", F.coalesce(F.col("is_binary_like").cast("int"), F.lit(-1)))




def _changed(name: str, old: str, new: str) -> str:
    if old not in CTES[name]:
        raise ValueError(f"{name} does not hold {old}")
    return CTES[name].replace(old, new)


def _places(*columns: str) -> str:
    """Columns at six places, half away from zero by their decimal text, as Spark rounds: ``round`` of DuckDB goes by the double, which may lie below a half."""
    return "REPLACE (" + ", ".join(f"CAST(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 6)) AS DOUBLE) AS {c}" for c in columns) + ")"


# Returns as the query documents them: (close - before) / before, of which 102 after 100 is 0.02, while 102 / 100 - 1 lies above that bound; their sums from the
# oldest bar on; and days of New York, which is five hours behind in winter only.
_DAY = "CAST(timezone('America/New_York', {0} AT TIME ZONE 'UTC') AS DATE)"
_START = "make_timestamp(bar_id * 3600000000)"
_EXACT = {
    "ticks": _changed("ticks", "CAST(ts - INTERVAL 5 HOUR AS DATE)", _DAY.format("ts")),
    "bars_60": _changed("bars_60", f"CAST({_START} - INTERVAL 5 HOUR AS DATE)", _DAY.format(_START)),
    "mom1": _changed("mom1", "close / lag(close) OVER s - 1", "(close - lag(close) OVER s) / lag(close) OVER s"),
    "mom": _changed("mom", f"sum(return_1bar) OVER {fr(5)} AS return_5bar", f"CASE WHEN count(return_1bar) OVER {fr(5)} > 0 THEN "
                    + " + ".join(f"coalesce(lag(return_1bar, {n}) OVER s, 0)" for n in (4, 3, 2, 1, 0)) + " END AS return_5bar")}
add("condition_pass_through", f"symbol:s {IDENTITY} pos:i pass_count:i finite_count:i total_count:i combined_count:i pass_rate_pct:d severity:s",
    lambda x: C.pass_through(condition_bars(x), briefs(x), ["symbol"]), f"SELECT * {_places('pass_rate_pct')} FROM ({_through('symbol')})", _EXACT)
add("condition_feasibility", f"symbol:s session_date:D {IDENTITY} pos:i pass_count:i finite_count:i combined_count:i total_count:i severity:s status:s p02:d p10:d p50:d p90:d p98:d "
    "is_binary_like:i", feasible, f"SELECT * {_places('p02', 'p10', 'p50', 'p90', 'p98')} FROM fz", _EXACT)


def _sets(d, names):
    texts = {n: F.array_join(F.transform(n, lambda s: F.concat_ws("/", s["symbol"], s["session_date"].cast("string"))), ",") for n in names}
    return d.withColumns(texts)


add("condition_conflicts", f"{IDENTITY} zero_samples:s dense_samples:s conflict:i",
    lambda x: _sets(C.repair_conflicts(feasible(x), ["brief"], SAMPLE), ["zero_samples", "dense_samples"]).withColumn("conflict", F.col("conflict").cast("int")), """
SELECT brief, feature, op, role, param_key, param_key_low, param_key_high, coalesce(string_agg(s, ',' ORDER BY s) FILTER (z), '') AS zero_samples,
  coalesce(string_agg(s, ',' ORDER BY s) FILTER (NOT z), '') AS dense_samples, CASE WHEN bool_or(z) AND bool_or(NOT z) THEN 1 ELSE 0 END AS conflict
FROM (SELECT *, symbol || '/' || CAST(session_date AS DATE) AS s, status = 'zero_signal' AS z FROM fz
  WHERE status = 'over_signal' AND pass_rate_pct > 2 OR status = 'zero_signal' AND (severity IN ('blocks_all', 'restrictive') OR pass_rate_pct <= 1))
GROUP BY ALL""")
add("condition_sample_ranges", f"{IDENTITY} sample_count:i p10_min:d p10_max:d p90_min:d p90_max:d blocked_samples:s dense_samples:s",
    lambda x: _sets(C.sample_conflicts(feasible(x), ["brief"], SAMPLE), ["blocked_samples", "dense_samples"]), """
SELECT brief, feature, op, role, param_key, param_key_low, param_key_high, count(*) AS sample_count, min(p10) AS p10_min, max(p10) AS p10_max, min(p90) AS p90_min, max(p90) AS p90_max,
  coalesce(string_agg(s, ',' ORDER BY s) FILTER (op IN ('>', '>=') AND p90 < value - 1e-12 OR op IN ('<', '<=') AND p10 > value + 1e-12), '') AS blocked_samples,
  coalesce(string_agg(s, ',' ORDER BY s) FILTER (pass_rate_pct > 2), '') AS dense_samples
FROM (SELECT *, symbol || '/' || CAST(session_date AS DATE) AS s FROM fz WHERE status <> 'context_unavailable')
GROUP BY ALL HAVING count(*) >= 2 AND min(p10) IS NOT NULL""")


def _requested(x):
    got = x.bars().select(*SAMPLE).distinct()
    return got.unionByName(got.select("symbol", F.lit("2031-01-01").cast("date").alias("session_date")).distinct())


add("condition_feasibility_requested", "symbol:s session_date:D brief:s pos:i total_count:i status:s", lambda x: feasible(x, _requested(x)), """
SELECT symbol, session_date, brief, pos, total_count, status FROM fz
UNION ALL SELECT symbol, DATE '2031-01-01', brief, pos, 0, 'empty_sample' FROM (SELECT DISTINCT symbol FROM fz), cond""")
_LO, _HI = "greatest(low, (p10 + p50) / 2)", "least(high, (p50 + p90) / 2)"
add("threshold_suggestions", f"symbol:s session_date:D {IDENTITY} status:s new_value:d new_low:d new_high:d", lambda x: C.suggest_thresholds(feasible(x)), f"""
SELECT *, CASE WHEN abs(one - value) > 1e-12 THEN one END AS new_value, CASE WHEN moved THEN lo END AS new_low, CASE WHEN moved THEN hi END AS new_high FROM (
SELECT *, lo < hi AND (abs(lo - low) > 1e-12 OR abs(hi - high) > 1e-12) AS moved FROM (
SELECT *, round(CASE WHEN status = 'zero_signal' AND op IN ('>', '>=') THEN CASE WHEN p90 < value THEN p90 WHEN p50 < value THEN p50 WHEN p10 < value THEN p10 END
    WHEN status = 'zero_signal' AND op IN ('<', '<=') THEN CASE WHEN p10 > value THEN p10 WHEN p50 > value THEN p50 WHEN p90 > value THEN p90 END
    WHEN status = 'over_signal' AND op IN ('>', '>=') THEN CASE WHEN p98 <= value THEN value + greatest((p98 - p90) * 0.25, abs(p98) * 0.02, 1e-6) ELSE p98 END
    WHEN status = 'over_signal' AND op IN ('<', '<=') THEN CASE WHEN p02 >= value THEN value - greatest((p10 - p02) * 0.25, abs(p02) * 0.02, 1e-6) ELSE p02 END END, 6) AS one,
  CASE WHEN op = 'between' AND param_key_low NOT LIKE 'sl_ticks%' THEN round(CASE WHEN status = 'zero_signal' THEN least(low, p10) WHEN status = 'over_signal' THEN
    CASE WHEN {_LO} >= {_HI} THEN p50 - greatest((p90 - p10) / 8, 1e-6) ELSE {_LO} END END, 6) END AS lo,
  CASE WHEN op = 'between' AND param_key_low NOT LIKE 'sl_ticks%' THEN round(CASE WHEN status = 'zero_signal' THEN greatest(high, p90) WHEN status = 'over_signal' THEN
    CASE WHEN {_LO} >= {_HI} THEN p50 + greatest((p90 - p10) / 8, 1e-6) ELSE {_HI} END END, 6) END AS hi FROM fz))""")
add("bar_config_choice", "symbol:s rank:i with_data:i dead:i failing:i zero:i over:i distance:d best_distance:d",
    lambda x: P.choose_bar_config(feasible(x, _requested(x)).where("brief = 'calm'"), "symbol", "session_date", requested=["S2", "S0"]), """
SELECT *, row_number() OVER (ORDER BY dead, failing, zero, "over", distance NULLS LAST, best_distance NULLS LAST, CASE symbol WHEN 'S2' THEN 1 WHEN 'S0' THEN 2 ELSE 3 END, symbol) AS rank FROM (
  SELECT symbol, count(*) AS with_data, count(*) FILTER (status = 'dead_feature_primary') AS dead, count(*) FILTER (status <> 'ok') AS failing,
    count(*) FILTER (status = 'zero_signal') AS zero, count(*) FILTER (status = 'over_signal') AS "over",
    avg(abs(combined_count / total_count - 0.00175)) FILTER (status = 'ok') AS distance, min(abs(combined_count / total_count - 0.00175)) FILTER (status = 'ok') AS best_distance
  FROM fz WHERE brief = 'calm' AND pos = 0 GROUP BY symbol)""")

# --- rules, over briefs made from the event table
_ROLE = "CASE WHEN event_type = 'error' THEN 'confirmation' WHEN event_id % 11 = 0 THEN ' Primary ' WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'timing_note' ELSE 'primary' END"


def _event_conditions(x):
    op = F.element_at(F.array(*[F.lit(o) for o in (*C.OPS, "~")]), (F.col("event_id") % 8 + 1).cast("int"))
    key = F.concat(F.lit("k"), F.col("user_id") % 4)
    return x.table("events").select(
        (F.col("event_id") % 5000).alias("brief"), F.col("event_id").cast("int").alias("pos"), F.expr("if(event_id % 19 = 0, ' ', concat('f', user_id % 3))").alias("feature"), op.alias("op"),
        F.expr(_ROLE).alias("role"), F.when(F.col("event_id") % 23 != 0, key).alias("param_key"), key.alias("param_key_low"), F.lit("top").alias("param_key_high"),
        F.expr("if(event_id % 29 = 0, null, round(value))").alias("value"), F.round(F.col("value") % 7, 2).alias("low"), F.lit(3.0).alias("high"))


CTES["econd"] = f"""
SELECT event_id % 5000 AS brief, event_id AS pos, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'f' || (user_id % 3) END AS feature,
  CASE event_id % 8 WHEN 0 THEN '>' WHEN 1 THEN '>=' WHEN 2 THEN '<' WHEN 3 THEN '<=' WHEN 4 THEN 'between' WHEN 5 THEN 'bool_true' WHEN 6 THEN 'bool_false' ELSE '~' END AS op,
  coalesce(lower(trim({_ROLE})), 'primary') AS role, CASE WHEN event_id % 8 <= 3 AND event_id % 23 <> 0 THEN 'k' || (user_id % 4) ELSE '' END AS param_key,
  CASE WHEN event_id % 8 = 4 THEN 'k' || (user_id % 4) ELSE '' END AS param_key_low, CASE WHEN event_id % 8 = 4 THEN 'top' ELSE '' END AS param_key_high,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE round(value) END AS value, round(value % 7, 2) AS low, 3.0 AS high FROM events"""
add("condition_table_rules", "brief:i condition_count:i primary_count:i confirmation_count:i unknown_count:i unnamed_count:i missing_value_count:i bad_bounds:i duplicate_count:i valid:i",
    lambda x: C.check_conditions(_event_conditions(x), ["brief"]).withColumn("valid", F.col("valid").cast("int")), """
SELECT *, CASE WHEN condition_count <= 3 AND primary_count <= 2 AND confirmation_count <= 1 AND unknown_count + unnamed_count + missing_value_count + bad_bounds + duplicate_count = 0
  THEN 1 ELSE 0 END AS valid FROM (
SELECT brief, count(*) AS condition_count, count(*) FILTER (role = 'primary') AS primary_count, count(*) FILTER (role = 'confirmation') AS confirmation_count,
  count(*) FILTER (op = '~' OR role NOT IN ('primary', 'confirmation')) AS unknown_count, count(*) FILTER (feature = '') AS unnamed_count,
  count(*) FILTER (op IN ('>', '>=', '<', '<=') AND (param_key = '' OR value IS NULL) OR op = 'between' AND low IS NULL) AS missing_value_count,
  count(*) FILTER (op = 'between' AND low > high) AS bad_bounds,
  count(*) - count(DISTINCT (feature, op, role, param_key, param_key_low, param_key_high)) AS duplicate_count FROM econd GROUP BY brief)""")
add("condition_table_coerced", "brief:i pos:i feature:s op:s role:s param_key:s", lambda x: C.coerce_conditions(_event_conditions(x)), """
SELECT * FROM (SELECT * FROM (SELECT * REPLACE (CASE WHEN role = 'timing_note' THEN 'confirmation' ELSE role END AS role) FROM econd)
  QUALIFY row_number() OVER (PARTITION BY brief, feature, op, role, param_key, param_key_low, param_key_high ORDER BY pos) = 1)
QUALIFY row_number() OVER (PARTITION BY brief, role ORDER BY pos) <= CASE role WHEN 'confirmation' THEN 1 ELSE 2 END""")
