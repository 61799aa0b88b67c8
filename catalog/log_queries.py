"""Stores, promotion, experiment-log analytics, user strategies and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.operators import logstats as G
from barflow.operators import trades as T
from barflow.plans import matrix as P
from barflow.plans import promotion as R
from barflow.plans import strategy as U
from barflow.sources import explog as X
from barflow.sources import stage
from barflow.sources import store as D
from barflow.sources import ticks as K
from barflow.streaming import jobs as S

from .base import CTES, add
from .trade_queries import KEYS, metric_sql, signal_bars
from .validation_queries import _EMAX, _PHI, check_sql_by_name, clone

# --- stores and samples
SIG = D.signature("v1", {"tick_size": 0.25})


def _stored_store(x, name: str) -> str:
    import uuid
    return f"{stage.stage_root(x.spark)}/{name}-{uuid.uuid4().hex}"


def _bar_store(x):
    path = _stored_store(x, "barstore")
    D.write_bars(x.bars(), path, "all", "time_60m", SIG)
    return D.read_partitions(x.spark, path, "all", "time_60m", SIG)


add("bar_store", "symbol:s date:D bar_count:i volume:i", lambda x: _bar_store(x).groupBy("symbol", "date").agg(
    F.count(F.lit(1)).alias("bar_count"), F.sum("volume").alias("volume")),
    "SELECT symbol, session_date AS date, count(*) AS bar_count, sum(volume) AS volume FROM b GROUP BY ALL")


# --- tick store: partitioned write and pruned read
def _tick_store(x):
    path = _stored_store(x, "ticks")
    K.write_ticks(x.ticks, path)
    back = K.read_ticks(x.spark, path).filter(F.dayofmonth("date") % 2 == 0)
    return back.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("tick_count"), F.sum("size").alias("total_size"), F.min("ts_event").alias("first_ts"), F.max("seq").alias("last_seq"))


CTES["tkd"] = "SELECT *, CAST(ts_event - INTERVAL 5 HOUR AS DATE) AS date, epoch_us(ts_event - INTERVAL 5 HOUR) // 60000000 % 1440 AS minute FROM ticks"
add("tick_store", "symbol:s date:D tick_count:i total_size:i first_ts:t last_seq:i", _tick_store, """
SELECT symbol, date, count(*) AS tick_count, sum(size) AS total_size, min(ts_event) AS first_ts, max(seq) AS last_seq FROM tkd WHERE day(date) % 2 = 0 GROUP BY ALL""")


def _days(x):
    return K.with_trading_day(x.ticks).select("date").distinct()


def _wanted(x, configs=("time_60m",)):
    sessions, labels = (F.array(*[F.lit(v) for v in vs]) for vs in (("rth", "eth"), configs))
    return _days(x).select(F.explode(sessions).alias("session"), F.lit(SIG).alias("sig"), "date").withColumn("bar_config", F.explode(labels))


def _bars_of(x):
    def build(days, session, config):
        near = x.ticks.filter(F.to_date("ts_event").between(min(days), F.date_add(F.lit(max(days)), 1)))
        return B.build_bars(K.filter_session(near, session), config)
    return build


def _half_store(x):
    """A store in which the RTH bars of odd days are missing."""
    path = _stored_store(x, "half")
    D.load_or_build(x.spark, path, _wanted(x).filter((F.col("session") == "eth") | (F.dayofmonth("date") % 2 == 0)), _bars_of(x), SIG)
    return path


CTES["ses"] = "SELECT DISTINCT v.s AS session, date FROM tkd, (VALUES ('rth', 570), ('eth', 180)) AS v(s, m) WHERE action = 'T' AND minute >= m AND minute < 960"
CTES["want"] = "SELECT DISTINCT s AS session, date FROM tkd, (VALUES ('rth'), ('eth')) AS v(s)"
add("missing_partitions", "session:s date:D", lambda x: D.missing_partitions(_wanted(x), D.stored_partitions(x.spark, _half_store(x))),
    "SELECT * FROM want WHERE session = 'rth' AND day(date) % 2 = 1")


def _rebuild(x):
    """Only what is missing is built the second time, and nothing the third, days without bars included."""
    path = _half_store(x)
    second, third = (D.load_or_build(x.spark, path, _wanted(x), _bars_of(x), SIG) for _ in range(2))
    rows = x.spark.read.parquet(path).groupBy("session").agg(F.countDistinct("date").alias("days"), F.sum("volume").alias("volume"))
    out = rows.join(second.select("session", F.col("total").alias("built_second")), "session", "left").na.fill(0, ["built_second"])
    return out.join(third.select("session", F.col("total").alias("built_third")), "session", "left").na.fill(0, ["built_third"])


add("store_reuse", "session:s days:i volume:i built_second:i built_third:i", _rebuild, """
SELECT session, count(DISTINCT date) AS days, sum(size) AS volume, (SELECT count(*) FROM want w WHERE w.session = v.session AND session = 'rth' AND day(date) % 2 = 1) AS built_second,
  0 AS built_third FROM tkd, (VALUES ('rth', 570), ('eth', 180)) AS v(session, m) WHERE action = 'T' AND minute >= m AND minute < 960 GROUP BY session""")


def _bulk(x):
    path, configs = _stored_store(x, "bulk"), ("time_60m", "tick_40")
    return D.load_or_build(x.spark, path, _wanted(x, configs), _bars_of(x), SIG)


add("bulk_build_report", "session:s bar_config:s total:i completed:i errors:i empty:i", _bulk, """
SELECT session, c AS bar_config, count(*) AS total, count(*) AS completed, 0 AS errors, count(*) FILTER (NOT ok) AS empty FROM (
  SELECT w.session, c, EXISTS (SELECT 1 FROM ses s WHERE s.session = w.session AND s.date = w.date) AS ok FROM want w, (VALUES ('time_60m'), ('tick_40')) AS v(c)) GROUP BY ALL""")


def _matrix_store(x):
    """The second half of the days is added to a stored matrix of the first half; rows are those of the bars."""
    path, build = _stored_store(x, "matrix"), P.matrix_builder(x.ticks)
    wanted = _days(x).select(F.lit("all").alias("session"), F.lit("time_60m").alias("bar_config"), "date")
    for part in (wanted.filter(F.dayofmonth("date") <= 15), wanted):
        D.load_or_build(x.spark, path, part, build, SIG)
    m = x.spark.read.parquet(path)
    return m.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("bar_count"), F.sum("return_1bar").alias("return_sum"))


def _manifest(x):
    """The notes of the bulk store: every day of both configurations once, with its rows."""
    path = _stored_store(x, "noted")
    D.load_or_build(x.spark, path, _wanted(x), _bars_of(x), SIG, B.BAR_COLUMNS)
    return D.manifest(x.spark, path).withColumn("complete", F.expr(f"size(split(columns, ',')) >= {len(B.BAR_COLUMNS)}").cast("int"))


add("store_manifest", "session:s bar_config:s date:D row_count:i complete:i", _manifest, """
SELECT w.session, 'time_60m' AS bar_config, w.date, count(DISTINCT symbol || '/' || (epoch_us(ts_event) // 3600000000)) AS row_count, 1 AS complete FROM want w LEFT JOIN (
  SELECT v.session, t.* FROM tkd t, (VALUES ('rth', 570), ('eth', 180)) AS v(session, m) WHERE action = 'T' AND minute >= m AND minute < 960) t ON t.session = w.session AND t.date = w.date
GROUP BY ALL""")
add("matrix_store", "symbol:s date:D bar_count:i return_sum:d", _matrix_store, """
SELECT b.symbol, b.session_date AS date, count(*) AS bar_count, sum(return_1bar) AS return_sum FROM b LEFT JOIN mom USING (symbol, session_date, ts_event, seq) GROUP BY ALL""")
add("representative_day_sample", "symbol:s session_date:D ts_event:t seq:i", lambda x: D.sample_days(x.bars(), 5, 8), """
WITH d AS (SELECT symbol, session_date, r - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM days)
SELECT b.symbol, b.session_date, ts_event, seq FROM b JOIN d USING (symbol, session_date)
WHERE i IN (SELECT CAST(floor(k * (d.n - 1) / 4) AS BIGINT) FROM range(0, 5) AS t(k))
QUALIFY row_number() OVER (PARTITION BY b.symbol, b.session_date ORDER BY ts_event, seq) <= 8""")
add("lockbox_split", "date:D part:s", lambda x: D.lockbox_split(x.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct(), 6), """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CASE WHEN r <= 6 THEN 'lockbox' ELSE 'research' END AS part
FROM orders JOIN (SELECT m, dense_rank() OVER (ORDER BY m DESC) AS r FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)) ON m = date_trunc('month', o_orderdate)""")


def _result_sink(x):
    path = _stored_store(x, "results")
    bars = signal_bars(x)
    trades = T.run_trades(bars, KEYS)
    D.write_results(bars.select("symbol", "ts_event", "signal"), trades, trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("trade_count")), path)
    s = x.spark.read.parquet(f"{path}/signals").groupBy("symbol").agg(F.count_if(F.col("signal") != 0).alias("live_bars"))
    return s.join(x.spark.read.parquet(f"{path}/trades").groupBy("symbol").agg(F.count(F.lit(1)).alias("stored_trades")), "symbol").join(
        x.spark.read.schema("symbol string, trade_count bigint").json(f"{path}/summary"), "symbol")


add("result_sinks", "symbol:s live_bars:i stored_trades:i trade_count:i", _result_sink, """
SELECT symbol, live_bars, n AS stored_trades, n AS trade_count FROM (SELECT symbol, count(*) FILTER (signal <> 0) AS live_bars FROM sig GROUP BY symbol)
JOIN (SELECT symbol, count(*) AS n FROM tr GROUP BY symbol) USING (symbol)""")

# --- log source
CTES["lg"] = """
SELECT *, event_id AS seq, sha256('run:' || event_id) AS eid, 'strat_' || (user_id % 20) AS strategy_name, CASE WHEN user_id % 3 = 0 THEN 'id' || (user_id % 40) END AS strategy_id,
  value / 50 - 0.5 AS sharpe, value * 10 - 300 AS net, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k, 'theme_' || (user_id % 7) || '_big_move' AS theme,
  'setup' || (user_id % 9) AS setup_key, CAST(user_id % 50 AS VARCHAR) AS request_id, value / 50 - 0.5 > 0.5 AS sp, value / 50 - 0.5 > 0.5 AND event_id % 2 = 0 AS lp FROM events"""
CTES["lge"] = """
SELECT *, CASE k % 10 WHEN 0 THEN 'task_error' WHEN 1 THEN 'validation_handoff_completed' WHEN 2 THEN '' ELSE 'task_result' END AS ev,
  CASE WHEN sp THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 11 = 0 THEN ['no_edge', 'no_trades'] ELSE ['no_edge'] END ELSE list_sort(list_filter([CASE WHEN event_id % 3 = 0 THEN 'shuffle' END, CASE WHEN event_id % 2 = 0 THEN 'regime' END,
    CASE WHEN event_id % 5 = 0 THEN 'decay' END, CASE WHEN event_id % 7 = 0 THEN 'deflated_sharpe' END, CASE WHEN event_id % 11 = 0 THEN 'no_trades' END],
    lambda c: c IS NOT NULL)) END AS codes FROM lg"""


CTES["lgr"] = "SELECT * FROM lge WHERE ev = 'task_result'"


def log(x):
    return X.log_from_events(x.table("events"))


def _json_lines(x):
    lines = log(x).select(F.when(F.col("seq") % 13 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event", "strategy_name", F.col("seq").alias("n")))).alias("line"))
    return X.parse_lines(lines, "line", "event string, strategy_name string, n bigint", ["task_result", "task_error"])


add("log_json_source", "event:s strategy_name:s n:i", _json_lines,
    "SELECT ev AS event, strategy_name, event_id AS n FROM lge WHERE event_id % 13 <> 0 AND ev IN ('task_result', 'task_error')")


def _append(x):
    """A quarter of the log is there; all of it, a third twice, is appended in two calls: each id ends up logged once."""
    path, rows = _stored_store(x, "explog"), log(x).select("event_id", "seq", "timestamp")
    schema = rows.schema
    rows.filter(F.col("seq") % 4 == 0).write.json(path)
    for batch in (rows.unionByName(rows.filter(F.col("seq") % 3 == 0)), rows.filter(F.col("seq") % 2 == 0)):
        X.append_log(batch, path, x.spark.read.schema(schema).json(path))
    return x.spark.read.schema(schema).json(path)


add("log_idempotent_append", "event_id:s seq:i", _append, "SELECT eid AS event_id, event_id AS seq FROM lg")

# --- log analytics
CTES["tri"] = "SELECT * FROM lge WHERE ev IN ('task_result', 'task_error') OR ev = ''"
TRIALS_SQL = """
SELECT count(*) AS raw_trials, count(DISTINCT coalesce(strategy_id, strategy_name || ':' || props)) AS unique_strategies, count(DISTINCT strategy_name) AS family_count,
  (SELECT greatest(1, least(round(sum(sqrt(n))), sum(n))) FROM (SELECT count(*) AS n FROM tri GROUP BY strategy_name)) AS effective_trials FROM tri"""
add("trial_counts", "raw_trials:i unique_strategies:i family_count:i effective_trials:i", lambda x: G.trial_counts(log(x)), TRIALS_SQL)
SC = "attempts:i edge_passes:i search_passes:i selection_attempts:i selection_passes:i edge_rate:d search_rate:d selection_rate:d"


def _sc_sql(k: str) -> str:
    return f"""SELECT {k}, count(*) AS attempts, count(*) FILTER (event_id % 4 <> 0) AS edge_passes, count(*) FILTER (sp) AS search_passes, count(*) FILTER (sp) AS selection_attempts,
count(*) FILTER (lp) AS selection_passes, (count(*) FILTER (event_id % 4 <> 0) + 1) / (count(*) + 2) AS edge_rate, (count(*) FILTER (sp) + 1) / (count(*) + 2) AS search_rate,
(count(*) FILTER (lp) + 1) / (count(*) FILTER (sp) + 2) AS selection_rate FROM lgr GROUP BY ALL"""


def outcomes(x):
    return G.with_outcome(log(x))


add("theme_scorecard", "theme:s attempts:i search_passes:i selection_attempts:i selection_passes:i search_rate:d selection_rate:d", lambda x: G.theme_scorecard(log(x)), """
SELECT *, (search_passes + 1) / (attempts + 2) AS search_rate, (selection_passes + 1) / (selection_attempts + 2) AS selection_rate FROM (
  SELECT theme, count(*) AS attempts, count(*) FILTER (event_id % 3 > 0) AS search_passes, count(*) FILTER (event_id % 2 = 0) AS selection_attempts,
    count(*) FILTER (event_id % 4 = 0) AS selection_passes FROM lge WHERE ev = 'validation_handoff_completed' GROUP BY theme)""")
add("bar_affinity_scorecard", f"theme:s bar_config:s {SC}", lambda x: G.scorecard(outcomes(x), ["theme", "bar_config"]), _sc_sql("theme, event_type AS bar_config"))
add("setup_scorecard", f"setup_key:s {SC}", lambda x: G.scorecard(outcomes(x), ["setup_key"]), _sc_sql("setup_key"))
add("failure_counts", "theme:s code:s fail_count:i", lambda x: G.failure_counts(outcomes(x), ["theme"]),
    "SELECT theme, code, count(*) AS fail_count FROM (SELECT theme, unnest(codes) AS code FROM lgr) GROUP BY ALL")
add("failure_codes", "event_id:s codes:s", lambda x: outcomes(x).withColumn("codes", F.array_join("codes", ",")),
    "SELECT eid AS event_id, array_to_string(codes, ',') AS codes FROM lgr")
add("near_misses", "strategy_name:s bar_config:s split:s sharpe:d theme:s failed_checks:s", lambda x: G.near_misses(log(x)), """
SELECT * FROM (
  SELECT strategy_name, event_type AS bar_config, 'search' AS split, sharpe AS sharpe, theme, array_to_string(codes, ',') AS failed_checks, ts, eid FROM lgr WHERE NOT sp AND len(codes) > 0
  UNION ALL SELECT strategy_name, event_type, 'selection', sharpe - 0.2, theme, array_to_string(codes, ','), ts, eid FROM lgr WHERE sp AND NOT lp AND len(codes) > 0) WHERE sharpe > 0
QUALIFY row_number() OVER (PARTITION BY strategy_name, bar_config, split ORDER BY sharpe DESC, ts DESC, eid DESC) = 1 ORDER BY sharpe DESC, strategy_name, bar_config, split LIMIT 10""")
add("low_sample_themes", "theme:s attempts:i", lambda x: G.low_sample_themes(outcomes(x).withColumn("theme", F.concat("theme", F.lit("_"), F.col("seq") % 4000)), 3), """
SELECT theme || '_' || (event_id % 4000) AS theme, count(*) AS attempts FROM lgr GROUP BY 1 HAVING count(*) < 3""")
add("recent_outcomes", "setup_key:s recency:i strategy_name:s verdict:s", lambda x: G.recent_outcomes(outcomes(x), ["setup_key"]), """
SELECT *, row_number() OVER (PARTITION BY setup_key ORDER BY ts DESC, eid DESC) AS recency FROM lgr QUALIFY recency <= 5""")


def _described(x):
    """Log rows with entry conditions, exits and entry text of many shapes."""
    d = log(x).drop("setup_key", "setup_label")
    text = F.lit(None).cast("string")
    first = F.struct(F.col("strategy_name").alias("feature"), F.lit("c").alias("column"), F.expr("element_at(array('>', 'between', 'bool_true'), cast(seq % 3 + 1 as int))").alias("op"),
                     text.alias("operator"), F.expr("if(seq % 4 = 0, null, ' Primary ')").alias("role"))
    second = F.struct(F.lit("").alias("feature"), F.col("bar_config").alias("column"), text.alias("op"), F.lit("<=").alias("operator"), F.lit("confirmation").alias("role"))
    third = F.struct(F.expr("if(seq % 5 = 0, 'q\"\\\\é', '')").alias("feature"), F.expr("if(seq % 10 = 1, 'tab\\tend', '')").alias("column"), F.lit(">").alias("op"),
                     text.alias("operator"), F.lit("").alias("role"))
    return d.withColumns({
        "entry_conditions": F.when(F.col("seq") % 7 != 0, F.array(first, second, third)), "bar_config": F.concat(F.lit(" "), "bar_config"),
        "params": F.expr("""case seq % 3 when 0 then '{"x": 1, "pt_ticks": 4, "sl_ticks": {"a": 2}}' when 1 then 'nothing' else params end"""),
        "entry_logic": F.expr("case seq % 4 when 0 then null when 1 then ' ?! ' when 2 then concat('Buy  THE dip-', strategy_name) else 'buy the DIP' end")})


CTES["scond"] = r"""
SELECT *, event_id AS q, list_sort(list_filter([
    {'feature': strategy_name, 'operator': ['>', 'between', 'bool_true'][event_id % 3 + 1], 'role': CASE WHEN event_id % 4 = 0 THEN 'confirmation' ELSE 'primary' END,
      'kind': ['compare', 'between', 'boolean'][event_id % 3 + 1]},
    {'feature': event_type, 'operator': '<=', 'role': 'confirmation', 'kind': 'compare'},
    {'feature': CASE WHEN event_id % 5 = 0 THEN 'q"\é' WHEN event_id % 10 = 1 THEN 'tab' || chr(9) || 'end' ELSE '' END, 'operator': '>', 'role': 'confirmation', 'kind': 'compare'}],
  lambda c: event_id % 7 <> 0 AND c.feature <> '')) AS conds,
  CASE WHEN event_id % 3 = 0 THEN ['sl_ticks', 'pt_ticks'] ELSE [] END AS exits,
  CASE event_id % 4 WHEN 2 THEN substr(sha256('buy the dip ' || replace(strategy_name, '_', ' ')), 1, 12) WHEN 3 THEN substr(sha256('buy the dip'), 1, 12) ELSE '' END AS logic FROM lg"""
_QUOTED = r"""'"' || replace(replace(replace(replace(c.feature, '\', '\\'), '"', '\"'), 'é', '\u00e9'), chr(9), '\t') || '"' """
CTES["setups"] = f"""
SELECT q AS seq, 'setup_' || substr(sha256('{{"bar_config":"' || event_type || '","condition_count":' || len(conds) || ',"conditions":[' || array_to_string(list_transform(conds, lambda c:
    '{{"feature":' || {_QUOTED} || ',"kind":"' || c.kind || '","operator":"' || c.operator || '","role":"' || c.role || '"}}'), ',')
  || '],"direction_logic_hash":"' || logic || '","exit_profile":[' || array_to_string(list_transform(exits, lambda e: '"' || e || '"'), ',')
  || '],"theme_tag":"theme_' || (user_id % 7) || '_big_move_of_the_day"}}'), 1, 16) AS setup_key,
  event_type || ' | ' || CASE WHEN len(conds) = 0 THEN 'no_conditions' ELSE array_to_string(list_transform(conds, lambda c: c.feature || ' ' || c.operator || ' (' || c.role || ')'), ', ') END
    || ' | exit=' || CASE WHEN len(exits) = 0 THEN 'basic_exit' ELSE 'sl_ticks,pt_ticks' END AS setup_label FROM scond"""
add("setup_identity", "seq:i setup_key:s setup_label:s", lambda x: G.setup_identity(_described(x)), "SELECT * FROM setups")
add("setup_identity_scorecard", f"setup_key:s {SC}", lambda x: G.scorecard(G.with_outcome(G.setup_identity(_described(x))), ["setup_key"]),
    _sc_sql("setup_key").replace("FROM lgr", "FROM (SELECT lgr.* EXCLUDE (setup_key), setups.setup_key FROM lgr JOIN setups ON setups.seq = lgr.event_id)"))


def _tasks(x):
    source = F.struct(F.expr("if(seq % 4 = 1, concat(' src', seq % 6), null)").alias("setup_key"), F.expr("if(seq % 8 = 1, 'From source', '')").alias("setup_label"))
    return log(x).withColumns({"source": source, "setup_key": F.expr("case seq % 4 when 0 then concat(setup_key, ' ') when 2 then '' end"), "setup_label": F.lit(None).cast("string"),
                               "params": F.expr("""if(seq % 3 = 0, '{"b": 1, "a": [1]}', params)"""), "strategy_name": F.expr("if(seq % 10 = 7, null, strategy_name)")})


add("task_setup_identity", "seq:i setup_key:s setup_label:s", lambda x: G.task_setup(_tasks(x)), """
SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN setup_key WHEN 1 THEN 'src' || (event_id % 6) ELSE 'setup_' || substr(sha256('{"bar_config":"' || event_type || '","param_keys":['
    || CASE WHEN event_id % 3 = 0 THEN '"a","b"' ELSE '"k"' END || '],"strategy_name":"' || CASE WHEN event_id % 10 = 7 THEN '' ELSE strategy_name END || '"}'), 1, 16) END AS setup_key,
  CASE event_id % 4 WHEN 0 THEN setup_key WHEN 1 THEN CASE WHEN event_id % 8 = 1 THEN 'From source' ELSE 'src' || (event_id % 6) END
    ELSE event_type || ' | ' || CASE WHEN event_id % 10 = 7 THEN 'unknown_strategy' ELSE strategy_name END END AS setup_label FROM lg""")
add("event_identity", "seq:i eid:s", lambda x: log(x).withColumn("eid", G.event_id(F.col("run_id"), F.col("task_id"), F.col("strategy_name"), F.lit("search"), F.lit("1"))),
    "SELECT event_id AS seq, sha256('run:' || event_id || ':' || strategy_name || ':search:1') AS eid FROM lg")
add("request_summary", "request_id:s task_count:i pass_count:i fail_count:i error_count:i pass_fraction:d avg_sharpe:d avg_net_pnl:d avg_trade_count:d passing_configs:s "
    "failing_configs:s best_bar_config:s best_sharpe:d overall:s", lambda x: G.request_summary(log(x)), """
SELECT *, pass_count / task_count AS pass_fraction, CASE WHEN error_count > 0 THEN 'ERROR' WHEN pass_count = task_count THEN 'PASS' WHEN pass_count > 0 THEN 'MIXED' ELSE 'FAIL' END AS overall FROM (
  SELECT request_id, count(*) AS task_count, count(*) FILTER (ev = 'task_result' AND sp) AS pass_count, count(*) FILTER (ev = 'task_result' AND NOT sp) AS fail_count,
    count(*) FILTER (ev = 'task_error') AS error_count, avg(sharpe) FILTER (ev = 'task_result') AS avg_sharpe, avg(net) FILTER (ev = 'task_result') AS avg_net_pnl,
    avg(event_id % 90) FILTER (ev = 'task_result') AS avg_trade_count, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (ev = 'task_result' AND sp), '') AS passing_configs,
    coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (ev = 'task_result' AND NOT sp), '') AS failing_configs, max(sharpe) FILTER (ev = 'task_result') AS best_sharpe,
    first(event_type ORDER BY sharpe DESC, event_type DESC) FILTER (ev = 'task_result') AS best_bar_config FROM lge WHERE ev IN ('task_result', 'task_error') GROUP BY request_id)""")
CTES["lgl"] = "SELECT * FROM lgr ORDER BY ts DESC, eid DESC LIMIT 10"
add("status_board", "results:i errors:i tested:i pass_rate_pct:d avg_net_pnl:d avg_sharpe:d best_strategy:s best_pnl:d worst_strategy:s worst_pnl:d", lambda x: G.status_board(log(x)), """
SELECT (SELECT count(*) FROM lgr) AS results, (SELECT count(*) FROM lge WHERE ev = 'task_error') AS errors, count(*) AS tested, 100.0 * count(*) FILTER (sp) / count(*) AS pass_rate_pct,
  avg(net) AS avg_net_pnl, avg(sharpe) AS avg_sharpe, first(strategy_name ORDER BY net DESC, strategy_name DESC) AS best_strategy, max(net) AS best_pnl,
  first(strategy_name ORDER BY net, strategy_name) AS worst_strategy, min(net) AS worst_pnl FROM lgl""")


def _queue(x):
    state = F.element_at(F.array(*[F.lit(v) for v in ("pending", "in_progress", "completed", "failed", "paused")]), (F.col("seq") % 5 + 1).cast("int"))
    return log(x).select(state.alias("state"), F.when(F.col("seq") % 3 > 0, F.col("setup_key")).alias("hypothesis_id"))


add("queue_states", "pending:i in_progress:i completed:i failed:i", lambda x: G.queue_states(_queue(x)), """
SELECT count(*) FILTER (event_id % 5 = 0) AS pending, count(*) FILTER (event_id % 5 = 1) AS in_progress, count(*) FILTER (event_id % 5 = 2) AS completed, count(*) FILTER (event_id % 5 = 3) AS failed FROM lg""")
add("active_hypotheses", "hypothesis_id:s tasks:i", lambda x: G.active_hypotheses(_queue(x)), """
SELECT setup_key AS hypothesis_id, count(*) AS tasks FROM lg WHERE event_id % 5 < 2 AND event_id % 3 > 0 GROUP BY 1 ORDER BY tasks DESC, hypothesis_id LIMIT 4""")
for _n, _latest in (("strategy_first_result", False), ("strategy_latest_result", True)):
    add(_n, "strategy_name:s event_id:s bar_config:s verdict:s net_pnl:d", lambda x, l=_latest: G.strategy_results(log(x), latest=l), f"""
SELECT strategy_name, eid AS event_id, event_type AS bar_config, verdict, net AS net_pnl FROM lgr
QUALIFY row_number() OVER (PARTITION BY strategy_name ORDER BY ts {'DESC' if _latest else ''}, eid {'DESC' if _latest else ''}) = 1""")


def _audit(x):
    mode = F.element_at(F.array(F.lit("plain"), F.lit(" Research"), F.lit("deep_research"), F.lit("other")), (F.col("seq") % 4 + 1).cast("int"))
    return log(x).select("run_id", "timestamp", "seq", (F.col("seq") % 2).alias("iteration"), F.col("bar_config").alias("stage"), F.when(F.col("seq") % 7 > 0, F.lit("a")).otherwise("b").alias("lane_id"),
                         mode.alias("mode"), F.when(F.col("seq") % 3 > 0, "success").otherwise("failed").alias("status"), (F.col("seq") % 5 == 0).alias("fallback_to_plain"),
                         F.when(F.col("seq") % 11 > 0, F.col("seq") % 6).alias("discovered_sources"), (F.col("seq") % 2).alias("imported_sources"), F.col("strategy_name").alias("question_preview"))


CTES["aud"] = """SELECT *, event_id % 2 AS iteration, event_type AS stage, CASE WHEN event_id % 7 > 0 THEN 'a' ELSE 'b' END AS lane_id, ['plain', 'research', 'deep_research', 'other'][event_id % 4 + 1] AS mode,
  event_id % 3 > 0 AS good, event_id % 5 = 0 AS fb FROM lg"""
add("query_audit", "iteration:i stage:s lane_id:s query_count:i success_count:i error_count:i fallback_count:i plain_count:i research_count:i deep_research_count:i plain_kept:i research_kept:i "
    "deep_research_kept:i discovered_sources:i imported_sources:i previews:s", lambda x: G.query_audit(_audit(x)), """
WITH f AS (SELECT iteration, stage, lane_id, strategy_name, min(ts) AS t, arg_min(event_id, ts) AS e FROM aud GROUP BY ALL),
p AS (SELECT iteration, stage, lane_id, string_agg(strategy_name, '|' ORDER BY t, e) AS previews FROM (
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY iteration, stage, lane_id ORDER BY t, e) <= 3) GROUP BY ALL)
SELECT iteration, stage, lane_id, count(*) AS query_count, count(*) FILTER (good) AS success_count, count(*) FILTER (NOT good) AS error_count, count(*) FILTER (fb) AS fallback_count,
  count(*) FILTER (mode = 'plain') AS plain_count, count(*) FILTER (mode = 'research') AS research_count, count(*) FILTER (mode = 'deep_research') AS deep_research_count,
  count(*) FILTER (mode = 'plain' AND good AND NOT fb) AS plain_kept, count(*) FILTER (mode = 'research' AND good AND NOT fb) AS research_kept,
  count(*) FILTER (mode = 'deep_research' AND good AND NOT fb) AS deep_research_kept, sum(CASE WHEN event_id % 11 > 0 THEN event_id % 6 ELSE 0 END) AS discovered_sources,
  sum(event_id % 2) AS imported_sources, any_value(previews) AS previews FROM aud JOIN p USING (iteration, stage, lane_id) GROUP BY ALL""")
_FEATS = ["prev_day_va_position", "dist_prev_poc", "va_rejection_score", "rsi_14", "position_in_va", "prev_day_vah"]


def _attempts(x):
    pick = F.element_at(F.array(*[F.lit(f) for f in _FEATS]), (F.col("seq") % 6 + 1).cast("int"))
    return log(x).select(pick.alias("feature"), F.when(F.col("seq") % 2 == 0, "primary").when(F.col("seq") % 4 == 1, "confirmation").alias("role"), F.col("seq").alias("attempt"),
                         (F.col("seq") % 8 == 0).alias("has_conflicts"), F.when(F.col("seq") % 3 == 0, "zero_signal").otherwise("over_signal").alias("failure_type"),
                         F.when(F.col("seq") % 5 == 0, "blocks_all").otherwise("tight").alias("severity"), (F.col("seq") % 4).cast("double").alias("pass_rate_pct"))


add("feature_cooldowns", "family:s feature:s score:i", lambda x: G.cooldowns(_attempts(x)), """
WITH a AS (SELECT event_id AS e, ['prev_day_va_position', 'dist_prev_poc', 'va_rejection_score', 'rsi_14', 'position_in_va', 'prev_day_vah'][event_id % 6 + 1] AS feature,
  ['value_area_position', 'previous_session_value_reference', 'auction_state_anchor', 'rsi_14', 'value_area_position', 'previous_session_value_reference'][event_id % 6 + 1] AS family,
  CASE WHEN event_id % 8 = 0 THEN 2 WHEN event_id % 3 = 0 AND (event_id % 5 = 0 OR event_id % 4 = 0) THEN 1 ELSE 0 END AS score FROM lg WHERE event_id % 4 <> 1)
SELECT family, arg_min(feature, e) AS feature, sum(score) AS score FROM a WHERE score > 0 GROUP BY family HAVING sum(score) >= 2 ORDER BY score DESC, feature LIMIT 4""")
add("feedback_feed", "source:i position:i event_id:s event:s", lambda x: G.feedback_feed([log(x).filter("bar_config = 'click'"), log(x).filter("bar_config <> 'click'")], 15), """
SELECT source, row_number() OVER (PARTITION BY source ORDER BY ts DESC, eid DESC) AS position, eid AS event_id, ev AS event
FROM (SELECT *, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS source FROM lge WHERE ev IN ('task_result', 'task_error')) QUALIFY position <= 15""")

# --- promotion
CTES["od"] = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, date_trunc('month', o_orderdate) AS m FROM orders"
CTES["om"] = "SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT m FROM od)"
CTES["mf"] = """
WITH f AS (SELECT k, 13 + k * 2 AS s FROM range(0, 200) AS r(k), (SELECT any_value(n) AS n FROM om) WHERE 13 + k * 2 < n),
t AS (SELECT k, date FROM f JOIN om ON i >= s AND i < s + 2 JOIN od USING (m)), g AS (SELECT k, min(date) AS fd FROM t GROUP BY k)
SELECT k + 1 AS fold, 'test' AS role, date FROM t
UNION ALL SELECT f.k + 1, 'train', date FROM f JOIN g ON g.k = f.k JOIN om ON i >= s - 13 AND i < s - 1 JOIN od USING (m) WHERE date < fd - 40"""


def _order_days(x):
    return x.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct()


add("month_folds", "fold:i role:s date:D", lambda x: R.month_folds(_order_days(x), 12, 2, 2, 1, 40), "SELECT * FROM mf")


def _week_folds(x):
    """Three folds by day of the month, and a fourth whose only day has no trades."""
    d = x.bars().select(F.to_date("ts_event").alias("date")).distinct()
    d = d.select((F.dayofmonth("date") % 3 + 1).alias("fold"), F.lit("test").alias("role"), "date")
    return d.unionByName(d.agg(F.lit(4).alias("fold"), F.lit("test").alias("role"), F.date_add(F.max("date"), 400).alias("date")))


CTES["p_wk"] = "SELECT *, day(xd) % 3 + 1 AS fold FROM pnl"
CTES["m_wk"] = "SELECT * FROM (" + metric_sql("p_wk", "symbol, fold") + ")"
CTES["wd"] = "SELECT symbol, fold, xd, sum(net_pnl) AS x, sum(net_pnl - costs) AS x2, count(*) AS n FROM p_wk GROUP BY ALL"
CTES["wcal"] = """
SELECT symbol, fold, xd, sum(x) AS x, sum(x2) AS x2, sum(n) AS n FROM (SELECT * FROM wd UNION ALL SELECT symbol, fold, xd, 0, 0, 0 FROM (
  SELECT symbol, fold, CAST(unnest(generate_series(min(xd), max(xd), INTERVAL 1 DAY)) AS DATE) AS xd FROM wd GROUP BY symbol, fold) WHERE isodow(xd) <= 5) GROUP BY ALL"""
CTES["wdsr"] = f"""
SELECT symbol, mu / sd AS sharpe, sqrt(greatest(1 - sk * mu / sd + (ku - 3) / 4 * (mu / sd) ** 2, 1e-9) / (n - 1)) * {_EMAX!r} AS emax,
  mu / sd / sqrt(greatest(1 - sk * mu / sd + (ku - 3) / 4 * (mu / sd) ** 2, 1e-9) / (n - 1)) - {_EMAX!r} AS z, s2, atd, mtd FROM (
  SELECT symbol, count(*) AS n, any_value(m) AS mu, any_value(s) AS sd, avg(((x - m) / s) ** 3) AS sk, avg(((x - m) / s) ** 4) AS ku, avg(x2) / stddev_samp(x2) * sqrt(252) AS s2, avg(k) AS atd, max(k) AS mtd FROM (
    SELECT symbol, x, x2, n AS k, avg(x) OVER (PARTITION BY symbol) AS m, stddev_samp(x) OVER (PARTITION BY symbol) AS s FROM wcal) GROUP BY symbol)"""
CTES["wres"] = f"""
SELECT w.symbol, {_PHI} AS dsr_probability, fold_count, pct_positive, w.trade_count, w.net_pnl, sharpe * sqrt(252) AS aggregate_sharpe, sharpe - emax AS deflated_sharpe, s2 AS sharpe_2x_cost,
  atd AS avg_trades_per_day, mtd AS max_trades_per_day FROM (
  SELECT symbol, 4 AS fold_count, count(*) FILTER (coalesce(sharpe_ratio, 0) > 0) / 4 AS pct_positive, sum(trade_count) AS trade_count, sum(net_pnl) AS net_pnl
  FROM m_wk GROUP BY symbol) w JOIN wdsr USING (symbol)"""


def _wres(x):
    return R.walk_forward_result(T.run_trades(signal_bars(x), KEYS), _week_folds(x), KEYS, 50, 20)


add("walk_forward_promotion", "symbol:s dsr_probability:d fold_count:i pct_positive:d trade_count:i net_pnl:d aggregate_sharpe:d deflated_sharpe:d sharpe_2x_cost:d avg_trades_per_day:d max_trades_per_day:i", _wres, "SELECT * FROM wres")
_GATES = [("fold_count", "min", 3.0), ("pct_positive", "min", 0.3), ("net_pnl", "min", -4500.0), ("trade_count", "max", 150.0), ("sharpe_2x_cost", "min", -6.0), ("max_trades_per_day", "max", 12.0), ("lockbox_sharpe", "min", 0.0)]


def _lockbox_days(x):
    """The last third of the month is kept for the lockbox."""
    d = x.bars().select(F.to_date("ts_event").alias("date")).distinct()
    return d.filter(F.dayofmonth("date") > 20).select(F.lit(0).alias("fold"), F.lit("lockbox").alias("role"), "date")


def _lockbox(x):
    return R.lockbox_result(T.run_trades(signal_bars(x), KEYS).filter("symbol <> 'S1' or day(exit_time) <= 20"), _lockbox_days(x), KEYS)


CTES["lbd"] = "SELECT symbol, xd, sum(net_pnl) AS x, sum(net_pnl - costs) AS x2, count(*) AS n FROM pnl WHERE day(xd) > 20 AND symbol <> 'S1' GROUP BY ALL"
CTES["lbc"] = """
SELECT symbol, xd, sum(x) AS x, sum(x2) AS x2, sum(n) AS n FROM (SELECT * FROM lbd UNION ALL SELECT symbol, xd, 0, 0, 0 FROM (
  SELECT symbol, CAST(unnest(generate_series(min(xd), max(xd), INTERVAL 1 DAY)) AS DATE) AS xd FROM lbd GROUP BY symbol) WHERE isodow(xd) <= 5) GROUP BY ALL"""
CTES["lbx"] = """
SELECT s.symbol, coalesce(avg(x) / stddev_samp(x) * sqrt(252), 0) AS lockbox_sharpe, coalesce(sum(x), 0) AS lockbox_net_pnl, coalesce(sum(n), 0) AS lockbox_trade_count,
  coalesce(avg(x2) / stddev_samp(x2) * sqrt(252), 0) AS lockbox_sharpe_2x_cost, coalesce(avg(n), 0) AS lockbox_avg_trades_per_day, coalesce(max(n), 0) AS lockbox_max_trades_per_day
FROM (SELECT DISTINCT symbol FROM pnl) s LEFT JOIN lbc USING (symbol) GROUP BY s.symbol"""
add("lockbox_result", "symbol:s lockbox_sharpe:d lockbox_net_pnl:d lockbox_trade_count:i lockbox_sharpe_2x_cost:d lockbox_avg_trades_per_day:d lockbox_max_trades_per_day:i",
    _lockbox, "SELECT * FROM lbx")
_LOCKED = [("lockbox_sharpe", "min", 0.0), ("lockbox_net_pnl", "min", -2000.0), ("lockbox_trade_count", "min", 20.0), ("dsr_probability", "min", 0.05), ("never_computed", "min", 0.0)]


def _gate_rows(x):
    t = x.spark.createDataFrame(_GATES[:-1] + _LOCKED, "gate string, sense string, bound double")
    return R.gates(_wres(x).join(_lockbox(x), KEYS), t, KEYS, [g[0] for g in _GATES[:-1] + _LOCKED[:-1]])  # a gate without its metric fails


CTES["wboth"] = "SELECT * FROM wres JOIN lbx USING (symbol)"
CTES["gts"] = " UNION ALL ".join(
    f"SELECT symbol, '{g}' AS gate, CAST({g} AS DOUBLE) AS value, {b} AS bound, {g} {'>=' if s == 'min' else '<='} {b} AS ok FROM wboth" for g, s, b in _GATES[:-1] + _LOCKED[:-1])
CTES["gts"] += " UNION ALL SELECT symbol, 'never_computed', NULL, 0.0, false FROM wres"
add("promotion_gates", "symbol:s gate:s value:d bound:d passed:i", lambda x: _gate_rows(x).withColumn("passed", F.col("passed").cast("int")),
    "SELECT *, CAST(ok AS INT) AS passed FROM gts")
add("promotion_verdict", "symbol:s gate_count:i passed_count:i promoted:i",
    lambda x: R.promotion_verdict(_gate_rows(x), KEYS).withColumn("promoted", F.col("promoted").cast("int")),
    "SELECT symbol, count(*) AS gate_count, count(*) FILTER (ok) AS passed_count, CAST(bool_and(ok) AS INT) AS promoted FROM gts GROUP BY symbol")
add("two_stage_verdict", "seq:i search_verdict:s selection_verdict:s final_verdict:s candidate_status:s",
    lambda x: R.two_stage_verdict(log(x).select("seq", "verdict"), log(x).filter("selection_result is not null and seq % 5 <> 0").select(
        "seq", F.col("selection_result.verdict").alias("verdict")), ["seq"]), """
SELECT event_id AS seq, verdict AS search_verdict, sv AS selection_verdict, CASE WHEN sp AND sv = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS final_verdict,
  CASE WHEN NOT sp THEN 'rejected_search' WHEN sv IS NULL THEN 'awaiting_selection' WHEN sv = 'PASS' THEN 'candidate' ELSE 'rejected_selection' END AS candidate_status
FROM (SELECT *, CASE WHEN sp AND event_id % 5 <> 0 THEN CASE WHEN lp THEN 'PASS' ELSE 'FAIL' END END AS sv FROM lge)""")


# --- staged evaluation: one symbol breaks the contract, one looks ahead, one has no edge, one goes through
def _rule(df, params):
    """By symbol: signals out of range (S0), looking ahead (S1), following the bar (S2), fading the distance from the session's last eight closes (S3)."""
    near = F.avg("close").over(Window.partitionBy("symbol", "session_date").orderBy("ts_event", "seq").rowsBetween(-7, 0))
    ahead = F.lead("close").over(Window.partitionBy("symbol").orderBy("ts_event", "seq"))
    move = F.signum(F.col("close") - F.col("open"))
    return df.withColumn("signal", F.when(F.col("symbol") == "S1", F.signum(F.coalesce(ahead, F.col("close")) - F.col("close"))).when(F.col("symbol") == "S2", move)
                         .when((F.col("symbol") == "S0") & (F.dayofmonth("ts_event") == 9), -2 * move).when(F.col("symbol") == "S3", F.signum(near - F.col("close"))).otherwise(-move))


_EDGE = {"enabled": True, "horizons": [1, 3], "min_events": 20, "min_pocket_events": 5, "min_positive_day_fraction": 0.2, "max_day_concentration": 0.9}


def _evaluation(x):
    raw = stage.stored(x.bars().select("symbol", "session_date", "ts_event", "seq", "open", "high", "low", "close", "volume", "bid_price", "ask_price"), "raw")
    return U.evaluate(_rule(raw, {}), KEYS, 30, 20, raw, U.causality_check(raw, _rule, strict=True), _EDGE, target_sharpe=0.5, effective_trials=20,
                      gate_config={"min_dsr": 0.0, "decay_verdicts": ["STABLE", "INSUFFICIENT_DATA"], "factor_verdicts": ["ALPHA_WITH_BETA_EXPOSURE", "PURE_ALPHA"]})


CTES["esig"] = """
SELECT *, CAST(ts_event AS DATE) AS date_utc, CASE symbol WHEN 'S1' THEN sign(coalesce(lead(close) OVER (PARTITION BY symbol ORDER BY ts_event, seq), close) - close) WHEN 'S2' THEN sign(close - open)
  WHEN 'S0' THEN sign(open - close) * CASE WHEN day(ts_event) = 9 THEN 2 ELSE 1 END
  ELSE sign(avg(close) OVER (PARTITION BY symbol, session_date ORDER BY ts_event, seq ROWS 7 PRECEDING) - close) END AS signal FROM b"""
clone({"sig": "esig"}, "_e")
CTES["ehz"] = """
SELECT v.*, m.bar_cost, s.ts_event AS exit_time, s.close AS exit_price, 1 AS size, h AS horizon_bars, CASE WHEN mi < 180 THEN 'eth_overnight' WHEN mi < 570 THEN 'london' WHEN mi < 660 THEN 'rth_open'
  WHEN mi < 900 THEN 'rth_midday' WHEN mi < 960 THEN 'power_hour' ELSE 'eth_overnight' END AS bucket
FROM (SELECT *, epoch_us(signal_time - INTERVAL 5 HOUR) // 60000000 % 1440 AS mi FROM ev_e) v JOIN ms m ON m.symbol = v.symbol AND m.ts_event = v.entry_time
CROSS JOIN (VALUES (1), (3)) AS hs(h) JOIN sn_e s ON s.symbol = v.symbol AND s.date_utc = v.date_utc AND s.i = v.i + h"""
CTES["ehp"] = """SELECT *, bar_cost AS costs, (exit_price - entry_price) * direction * 20 AS gross_pnl, (exit_price - entry_price) * direction * 20 - bar_cost AS net_pnl,
  (epoch_us(exit_time) // 1000000 - epoch_us(entry_time) // 1000000) / 60 AS holding_time_min, CAST(exit_time AS DATE) AS xd FROM (
  SELECT *, 'all' AS label FROM ehz UNION ALL SELECT *, bucket FROM ehz)"""
CTES["ehm"] = "SELECT * FROM (" + metric_sql("ehp", "symbol, label, horizon_bars") + ")"
CTES["est"] = """
SELECT symbol, CASE WHEN coalesce(n, 0) < 20 THEN 'insufficient_events' WHEN g THEN 'global_edge' WHEN l THEN 'localized_edge_only' ELSE 'no_edge' END AS edge_status
FROM (SELECT DISTINCT symbol FROM b) LEFT JOIN (SELECT symbol, count(*) AS n FROM ev_e GROUP BY symbol) USING (symbol) LEFT JOIN (
  SELECT symbol, bool_or(ok) FILTER (label = 'all') AS g, bool_or(ok) FILTER (label <> 'all') AS l FROM (SELECT *, trade_count >= CASE WHEN label = 'all' THEN 20 ELSE 5 END AND avg_trade_pnl > 0
    AND net_pnl > 0 AND positive_day_fraction >= 0.2 AND max_day_concentration <= 0.9 AS ok FROM ehm) GROUP BY symbol) USING (symbol)"""
CTES["eday"] = """
SELECT symbol, xd, sum(x) AS x FROM (SELECT symbol, xd, net_pnl AS x FROM p_abase_e UNION ALL SELECT symbol, xd, 0 FROM (
  SELECT symbol, CAST(unnest(generate_series(min(xd), max(xd), INTERVAL 1 DAY)) AS DATE) AS xd FROM p_abase_e GROUP BY symbol) WHERE isodow(xd) <= 5) GROUP BY ALL"""
CTES["edsr"] = f"""
SELECT symbol, {_PHI} AS dsr FROM (SELECT symbol, greatest(-10, least(10, (mu / sd - se * {_EMAX!r}) / se)) AS z FROM (
  SELECT symbol, mu, sd, sqrt(greatest(1 - sk * mu / sd + (ku - 3) / 4 * (mu / sd) ** 2, 1e-9) / (n - 1)) AS se FROM (
    SELECT symbol, count(*) AS n, any_value(m) AS mu, any_value(s) AS sd, avg(((x - m) / s) ** 3) AS sk, avg(((x - m) / s) ** 4) AS ku FROM (
      SELECT *, avg(x) OVER (PARTITION BY symbol) AS m, stddev_samp(x) OVER (PARTITION BY symbol) AS s FROM eday) GROUP BY symbol)))"""
_ECHECKS = {c: clone.sql(q) for c, q in check_sql_by_name(30).items()}
CTES["egau"] = ("SELECT symbol, " + ", ".join(f"max(verdict) FILTER (name = '{c}') AS check_{c}" for c in _ECHECKS) + ", count(*) FILTER (verdict = 'PASS') AS pass_count FROM ("
                + " UNION ALL ".join(f"SELECT symbol, '{c}' AS name, verdict FROM ({q})" for c, q in _ECHECKS.items()) + ") GROUP BY symbol")
add("strategy_evaluation", "symbol:s row_count:i contract_ok:i causality_ok:d edge_status:s trade_count:d net_pnl:d sharpe_ratio:d dsr:d decay_verdict:s factor_verdict:s pass_count:d "
    + " ".join(f"check_{c}:s" for c in _ECHECKS) + " gauntlet_verdict:s gates_passed:d meets_thresholds:d failed_stage:s failure_code:s verdict:s",
    lambda x: _evaluation(x).withColumns({c: F.col(c).cast("int") for c in ("contract_ok", "causality_ok", "gates_passed", "meets_thresholds")}), f"""
SELECT *, CASE failed_stage WHEN 'signal_contract' THEN failed_stage WHEN 'signal_causality' THEN failed_stage WHEN 'edge_surface' THEN edge_status END AS failure_code,
  CASE WHEN failed_stage IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
SELECT *, CASE WHEN contract_ok = 0 THEN 'signal_contract' WHEN causality_ok = 0 THEN 'signal_causality' WHEN NOT go THEN 'edge_surface' WHEN meets_thresholds = 0 THEN 'metrics'
  WHEN gauntlet_verdict <> 'PASS' THEN 'gauntlet' WHEN gates_passed = 0 THEN 'advanced_gates' END AS failed_stage FROM (
SELECT s.symbol, s.row_count, CASE WHEN s.symbol = 'S0' THEN 0 ELSE 1 END AS contract_ok, CASE WHEN s.symbol <> 'S0' THEN CASE WHEN s.symbol = 'S1' THEN 0 ELSE 1 END END AS causality_ok,
  CASE WHEN alive THEN edge_status END AS edge_status, go, CASE WHEN go THEN m.trade_count END AS trade_count, CASE WHEN go THEN m.net_pnl END AS net_pnl, CASE WHEN go THEN m.sharpe_ratio END AS sharpe_ratio,
  CASE WHEN go THEN d.dsr ELSE 0 END AS dsr, CASE WHEN go THEN 'INSUFFICIENT_DATA' END AS decay_verdict, CASE WHEN go THEN f.verdict END AS factor_verdict,
  {", ".join(f"CASE WHEN go THEN g.check_{c} END AS check_{c}" for c in _ECHECKS)}, CASE WHEN go THEN g.pass_count END AS pass_count,
  CASE WHEN go THEN CASE WHEN g.pass_count = {len(_ECHECKS)} THEN 'PASS' ELSE 'FAIL' END END AS gauntlet_verdict,
  CASE WHEN go THEN CASE WHEN d.dsr >= 0 AND f.verdict IN ('ALPHA_WITH_BETA_EXPOSURE', 'PURE_ALPHA') THEN 1 ELSE 0 END END AS gates_passed,
  CASE WHEN go THEN CASE WHEN m.sharpe_ratio >= 0.5 AND m.trade_count >= 30 THEN 1 ELSE 0 END END AS meets_thresholds
FROM (SELECT symbol, count(*) AS row_count, symbol NOT IN ('S0', 'S1') AS alive, symbol NOT IN ('S0', 'S1') AND any_value(edge_status) = 'global_edge' AS go, any_value(edge_status) AS edge_status
  FROM b JOIN est USING (symbol) GROUP BY symbol) s LEFT JOIN m_abase_e m USING (symbol) LEFT JOIN edsr d USING (symbol) LEFT JOIN fver_e f USING (symbol) LEFT JOIN egau g USING (symbol)))""")

# --- user strategies
def _momentum_rule(df, params):
    return df.withColumn("signal", F.col("close") - F.col("open"))


def _day_rule(pdf, params):
    return np.where(pdf["volume"] > params["min_volume"], pdf["close"] - pdf["open"], np.nan)


add("column_strategy", "symbol:s ts_event:t signal:i", lambda x: U.column_strategy(x.bars(), _momentum_rule), "SELECT *, sign(close - open) AS signal FROM b")
add("python_strategy", "symbol:s ts_event:t signal:i",
    lambda x: U.python_strategy(x.bars().select("symbol", "session_date", "ts_event", "seq", "open", "close", "volume"), _day_rule, {"min_volume": 150}),
    "SELECT *, CASE WHEN volume > 150 THEN sign(close - open) ELSE 0 END AS signal FROM b")
CTES["eti"] = """SELECT symbol, session_date, session_date AS target_date, ts_event, seq, close, row_number() OVER (PARTITION BY symbol, session_date ORDER BY ts_event, seq) AS rn,
  1 AS first_close FROM b"""
CTES["etm"] = """
SELECT y.symbol, y.session_date, y.ts_event, y.seq, y.rn, y.close - sum(x.close * pow(1 - 2.0 / 9, y.rn - x.rn) * CASE WHEN x.rn = 1 THEN 1 ELSE 2.0 / 9 END) AS gap
FROM eti y JOIN eti x ON x.symbol = y.symbol AND x.session_date = y.session_date AND x.rn <= y.rn GROUP BY ALL, y.close""".replace("GROUP BY ALL, y.close", "GROUP BY y.symbol, y.session_date, y.ts_event, y.seq, y.rn, y.close")
add("ema_turn_signal", "symbol:s ts_event:t signal:i", lambda x: U.ema_turn(x.bars()), """
SELECT *, CASE WHEN pg <= 1e-12 AND g > 1e-12 THEN 1 WHEN pg >= -1e-12 AND g < -1e-12 THEN -1 ELSE 0 END AS signal FROM (
  SELECT *, CASE WHEN rn = 1 THEN 0 ELSE gap END AS g, coalesce(lag(CASE WHEN rn = 1 THEN 0 ELSE gap END) OVER (PARTITION BY symbol, session_date ORDER BY rn), 0) AS pg FROM etm)""")
add("causality_check", "symbol:s share:d prefix_rows:i mismatches:i first_mismatch:d status:s", lambda x: U.causality_check(
    x.stored_bars(), lambda d, p: U.ema_turn(d, p)), """
SELECT symbol, s AS share, k AS prefix_rows, 0 AS mismatches, NULL AS first_mismatch, 'ok' AS status
FROM (SELECT symbol, s, n, CASE WHEN s = 1 THEN n - 1 ELSE round_even(n * s, 0) END AS k FROM (SELECT symbol, count(*) AS n FROM b GROUP BY symbol), (VALUES (0.5), (0.75), (0.9), (1.0)) AS v(s)) WHERE k >= 32
UNION ALL SELECT symbol, NULL, count(*), 0, NULL, 'short' FROM b GROUP BY symbol HAVING count(*) < 33""")


def _fitted(x):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from barflow.operators import momentum as M
    df = stage.stored(M.labels(M.momentum(x.bars())).select("symbol", "session_date", "ts_event", "seq", "return_1bar", "close_position", "volume_ratio",
                                                             F.col("label_1bar").cast("double").alias("label")).dropna(), "labels")
    days = df.select(F.col("session_date").alias("date")).distinct()
    folds = days.select(F.lit(1).alias("fold"), F.when(F.col("date") < "2024-01-16", "train").otherwise("test").alias("role"), "date")
    est = Pipeline(stages=[VectorAssembler(inputCols=["return_1bar", "close_position", "volume_ratio"], outputCol="features"), LogisticRegression(maxIter=20)])
    return U.fitted_strategy(df, folds, 1, est, threshold=0.5)


def _fitted_prior(x):
    """A fit with a closed form: naive Bayes on whether the bar rose, so the SQL can count the same probabilities."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler
    bars = x.bars().select("symbol", "session_date", "ts_event", "seq", "open", "close")
    ahead = F.lead("close").over(Window.partitionBy("symbol", "session_date").orderBy("ts_event", "seq"))
    df = stage.stored(bars.withColumns({"label": (ahead > F.col("close")).cast("double"), "rose": (F.col("close") > F.col("open")).cast("double")}).dropna(), "labels")
    folds = df.select(F.lit(1).alias("fold"), F.when(F.col("session_date") < "2024-01-16", "train").otherwise("test").alias("role"), F.col("session_date").alias("date")).distinct()
    est = Pipeline(stages=[VectorAssembler(inputCols=["rose"], outputCol="features"), NaiveBayes(modelType="bernoulli", smoothing=1.0)])
    return U.fitted_strategy(df, folds, 1, est, threshold=0.55)


add("fitted_strategy", "symbol:s ts_event:t fold:i signal:i", _fitted)
CTES["nbr"] = """
SELECT * FROM (SELECT symbol, session_date, ts_event, seq, CASE WHEN close > open THEN 1 ELSE 0 END AS rose,
  CASE WHEN lead(close) OVER (PARTITION BY symbol, session_date ORDER BY ts_event, seq) > close THEN 1 WHEN lead(close) OVER (PARTITION BY symbol, session_date ORDER BY ts_event, seq) <= close THEN 0 END AS label
  FROM b) WHERE label IS NOT NULL"""
CTES["nbc"] = "SELECT label, count(*) AS n, sum(rose) AS r FROM nbr WHERE session_date < DATE '2024-01-16' GROUP BY label"
add("fitted_strategy_closed_form", "symbol:s ts_event:t fold:i signal:i", _fitted_prior, """
SELECT symbol, ts_event, 1 AS fold, CASE WHEN p > 0.55 THEN 1 WHEN p < 0.45 THEN -1 ELSE 0 END AS signal FROM (
  SELECT t.*, j1 / (j0 + j1) AS p FROM nbr t JOIN (
    SELECT rose, max(j) FILTER (label = 1) AS j1, max(j) FILTER (label = 0) AS j0 FROM (
      SELECT label, v AS rose, (n + 1) * (CASE WHEN v = 1 THEN r + 1 ELSE n - r + 1 END) / (n + 2) AS j FROM nbc, (VALUES (0), (1)) AS x(v)) GROUP BY rose) USING (rose)
  WHERE session_date >= DATE '2024-01-16')""")


# --- strategies with a model state that is fitted once a fold
def _day_record(pdf, params):
    return {"n": len(pdf), "sum": float(pdf["close"].sum()), "high": float(pdf["high"].max())}


def _fold_state(records, params):
    return {"mean": sum(r["sum"] for r in records) / sum(r["n"] for r in records), "high": max(r["high"] for r in records), "days": len(records)}


def _stateful_rule(pdf, params, state):
    if state is None or state["days"] < params["min_days"]:
        return np.zeros(len(pdf))
    return np.where(pdf["high"] >= state["high"], 0.0, state["mean"] - pdf["close"])


def _day_folds(x):
    """Three folds: days of each third of the month are tested after all earlier days; the first third has no training days."""
    d = x.bars().select(F.col("session_date").alias("date")).distinct().withColumn("third", F.expr("least((dayofmonth(date) - 1) div 10, 2)"))
    tests = d.select(F.col("third").alias("fold"), F.lit("test").alias("role"), "date")
    return tests.unionByName(d.select(F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda k: k > F.col("third"))).alias("fold"), F.lit("train").alias("role"), "date"))


def _stateful(x):
    bars, folds = x.stored_bars().select("symbol", "session_date", "ts_event", "seq", "high", "close"), _day_folds(x)
    states = U.fit_states(bars, folds, _day_record, _fold_state)
    return U.python_strategy(U.fold_rows(bars, folds, "test"), _stateful_rule, {"min_days": 4}, states=states, on=("symbol", "fold"))


CTES["thr"] = "SELECT *, least((day(session_date) - 1) // 10, 2) AS third FROM b"
CTES["mst"] = """SELECT symbol, k AS fold, avg(close) AS m, max(high) AS h, count(DISTINCT session_date) AS d FROM thr, (VALUES (1), (2)) AS v(k) WHERE third < k GROUP BY symbol, k"""
add("stateful_strategy", "symbol:s ts_event:t fold:i signal:i", _stateful, """
SELECT t.symbol, ts_event, third AS fold, CASE WHEN d >= 4 AND high < h THEN sign(round(m - close, 9)) ELSE 0 END AS signal
FROM thr t LEFT JOIN mst s ON s.symbol = t.symbol AND s.fold = t.third""")
add("fitted_states", "symbol:s fold:i mean:d high:d days:i", lambda x: U.fit_states(x.stored_bars().select("symbol", "session_date", "ts_event", "seq", "high", "close"), _day_folds(x), _day_record, _fold_state)
    .select("symbol", "fold", F.from_json("state", "mean double, high double, days int").alias("s")).select("symbol", "fold", "s.*"), "SELECT symbol, fold, m AS mean, h AS high, d AS days FROM mst")


# --- streams, driven to completion over the tick table
def _stream_bars(x):
    """Ticks arrive in three slices of time; a fourth slice repeats old ticks, which come too late and change nothing."""
    src, out, ck = (_stored_store(x, n) for n in ("ticksrc", "streambars", "streamck"))
    day = F.dayofmonth("ts_event")
    for part in (x.ticks.filter(day <= 10), x.ticks.filter((day > 10) & (day <= 20)), x.ticks.filter(day > 20), x.ticks.filter(day <= 3)):
        part.write.mode("append").parquet(src)
        S.run_bar_stream(x.spark.readStream.schema(x.ticks.schema).parquet(src), "60m", out, ck).awaitTermination()
    # The last windows stay open until the watermark passes them.
    return x.spark.read.parquet(out)


CTES["wm"] = "SELECT max(ts_event) - INTERVAL 10 MINUTE AS w FROM ticks WHERE action = 'T'"
_FULL = ("ts_close:t bar_duration_ns:i open:d high:d low:d close:d volume:i vwap:d trade_count:i buy_volume:i sell_volume:i large_trade_count:i large_buy_volume:i large_sell_volume:i "
         "whale_trade_count_30:i whale_buy_volume_30:i whale_sell_volume_30:i bid_price:d ask_price:d bid_size:i ask_size:i bid_count:i ask_count:i msg_count:i add_count:i cancel_count:i "
         "modify_count:i latency_mean:d stacked_imbalance_count:i stacked_imbalance_direction:i zero_print_count:i zero_print_ratio:d unfinished_high:i unfinished_low:i max_level_volume:i "
         "volume_at_high:i volume_at_low:i buy_vol_at_high:i sell_vol_at_high:i buy_vol_at_low:i sell_vol_at_low:i vap_prices:s vap_volumes:s")


def _texts(df):
    return df.withColumns({c: F.array_join(F.transform(c, lambda v: v.cast("decimal(18,2)").cast("string")), ",") for c in ("vap_prices", "vap_volumes")})


_VAPS = ", ".join(f"array_to_string(list_transform({c}, lambda v: CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR)), ',') AS {c}" for c in ("vap_prices", "vap_volumes"))
add("streaming_bars", f"symbol:s session_date:D ts_event:t {_FULL}", lambda x: _texts(_stream_bars(x)),
    f"SELECT * EXCLUDE (vap_prices, vap_volumes), {_VAPS} FROM b WHERE ts_event + INTERVAL 60 MINUTE <= (SELECT w FROM wm)")
add("windowed_bars", f"symbol:s session_date:D ts_event:t {_FULL}", lambda x: _texts(B.windowed_bars(x.ticks, "60m")), f"SELECT * EXCLUDE (vap_prices, vap_volumes), {_VAPS} FROM b")


def _stream_numbered(x, config: str):
    """Like ``_stream_bars``, for bars of so many units or trades; a bar may take its trades from two slices."""
    src, out, ck = (_stored_store(x, n) for n in ("tradesrc", "numberedbars", "numberedck"))
    at = F.dayofmonth("ts_event") * 24 + F.hour("ts_event")
    for part in (x.ticks.filter(at <= 254), x.ticks.filter((at > 254) & (at <= 495)), x.ticks.filter(at > 495), x.ticks.filter(at <= 72)):
        part.write.mode("append").parquet(src)
        S.run_numbered_bar_stream(x.spark.readStream.schema(x.ticks.schema).parquet(src), config, out, ck).awaitTermination()
    return x.spark.read.parquet(out)


# A bar has closed where a trade of the next bar, or the end of its day (midnight in New York, five hours behind), is not after the watermark.
for _n, _cfg, _tag in (("streaming_volume_bars", "vol_500", "v"), ("streaming_tick_bars", "tick_10", "t")):
    add(_n, f"symbol:s session_date:D ts_event:t seq:i {_FULL}", lambda x, c=_cfg: _texts(_stream_numbered(x, c)), f"""
SELECT * EXCLUDE (vap_prices, vap_volumes), {_VAPS} FROM (
  SELECT *, coalesce(lead(ts_event) OVER (PARTITION BY symbol, session_date ORDER BY ts_event, seq), CAST(session_date + 1 AS TIMESTAMP) + INTERVAL 5 HOUR) AS closed_at FROM bars_{_tag})
WHERE closed_at <= date_trunc('millisecond', (SELECT w FROM wm))""")


#: Rows of the log that arrive before the stream runs again; a day's rows are never parted.
ARRIVING = 8_000_000
_TRIAL_COLUMNS = ["event", "strategy_id", "strategy_name", "params"]
_OUTCOME_COLUMNS = ["event", "setup_key", "theme_tag", "bar_config", "search_result", "selection_result"]


def _slices(rows):
    """Filters that cut ``rows`` into slices of whole days in order, as many days at once as hold ``ARRIVING`` rows, one at least."""
    day = F.to_date("timestamp")
    starts, held = [], 0
    for r in rows.groupBy(day.alias("day")).count().orderBy("day").collect():  # one row a day
        if held and held + r["count"] > ARRIVING:
            starts.append(r.day)
            held = 0
        held += r["count"]
    late = [F.coalesce(day >= F.lit(d), F.lit(False)) for d in starts]
    return [lower & ~upper for lower, upper in zip([F.lit(True), *late], [*late, F.lit(False)])]


def _streamed(x, columns, counted: bool = False):
    """(log table, trial counts by batch) that a stream of the log's ``columns``, a third of it sent twice, has written; every batch came twice, as after a lost commit.

    The log arrives in slices of days, so the stream's state holds the ids of a slice and of the day before it, not those of the whole log.
    """
    src, out, parts, ck = (_stored_store(x, n) for n in ("logsrc", "streamlog", "streamparts", "logck"))
    rows = log(x).select("event_id", "timestamp", "seq", *columns)
    sent = rows.withColumn("sent", F.explode(F.expr("if(seq % 3 = 0, array(1, 2), array(1))"))).drop("sent")
    sink = S.batch_sink(out, parts if counted else None)
    for part in _slices(sent):
        sent.where(part).write.mode("append").parquet(src)
        S.run_log_stream(x.spark.readStream.schema(rows.schema).parquet(src), ck, lambda df, batch: [sink(df, batch) for _ in range(2)]).awaitTermination()
    return x.spark.read.parquet(out), x.spark.read.parquet(parts) if counted else None


def _streamed_log(x, columns):
    return _streamed(x, columns)[0].drop("batch")


def _stream_log(x):
    return _streamed_log(x, ["event"]).groupBy("event").agg(F.count(F.lit(1)).alias("rows_kept"), F.countDistinct("event_id").alias("distinct_ids"))


add("streaming_trial_counts", "raw_trials:i unique_strategies:i family_count:i effective_trials:i", lambda x: S.counted_trials(_streamed(x, _TRIAL_COLUMNS, True)[1]), TRIALS_SQL)
add("streaming_setup_scorecard", f"setup_key:s {SC}", lambda x: G.scorecard(G.with_outcome(_streamed_log(x, _OUTCOME_COLUMNS)), ["setup_key"]), _sc_sql("setup_key"))
add("streaming_log_dedup", "event:s rows_kept:i distinct_ids:i", _stream_log, "SELECT ev AS event, count(*) AS rows_kept, count(*) AS distinct_ids FROM lge GROUP BY ev")
