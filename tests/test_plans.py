import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import cross as X
from barflow.plans import matrix as P
from barflow.plans import promotion as R
from barflow.plans import strategy as U
from barflow.sources import store as D
from barflow.sources.stage import stored
from catalog.base import QUERIES, Inputs, run
from compare import difference, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["tick_scan", "time_bars", "volume_bars", "bar_footprint", "rsi", "macd", "rolling_profile", "squeeze", "run_trades", "next_open_trades",
          "strategy_metrics", "adaptive_round_trip_cost", "walk_forward_folds", "edge_surface", "trial_counts", "month_folds", "streaming_bars"]


@pytest.fixture(scope="module")
def bars(spark):
    return stored(Inputs(spark, SF).bars(), "bars")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    assert difference(run(name, spark, SF).toPandas(), duck(SF).execute(QUERIES[name].sql).df()) is None


def test_matrix_width_rows_and_sides(spark, bars):
    m = P.feature_matrix(bars, include_bar_columns=True)
    assert len(m.columns) == len(set(m.columns)) and len(m.columns) >= 215
    assert not set(P.LABELS) & set(P.strategy_inputs(m, "all").columns)
    assert set(P.feature_group(m, "ohlcv", keep_non_features=False).columns) == P.OHLCV_FEATURES
    with pytest.raises(ValueError):
        P.feature_group(m, "nope")
    got = m.select("symbol", "ts_event").agg(F.count("*"), F.countDistinct("symbol", "ts_event")).first()
    assert tuple(got) == (bars.count(), bars.count())


def test_matrix_plan_reads_ticks_never_and_has_no_cross_join(bars):
    plan = P.feature_matrix(bars)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan


def test_session_features_are_causal(spark, bars):
    def rule(df, params):
        return P.session_features(df).withColumn("signal", F.signum(F.coalesce("cvd_price_alignment", F.lit(0.0)) + F.coalesce("return_5bar", F.lit(0.0))))
    out = U.causality_check(bars, rule).agg(F.sum("mismatches")).first()[0]
    assert out == 0


def test_python_strategy_contract(spark, bars):
    narrow = bars.select("symbol", "session_date", "ts_event", "seq", "close")
    got = U.python_strategy(narrow, lambda d, p: np.where(d["close"] > 105, np.inf, d["close"] - 103))
    assert {r.signal for r in got.select("signal").distinct().collect()} <= {-1, 0, 1} and got.count() == narrow.count()
    with pytest.raises(Exception, match="signal has shape"):
        U.python_strategy(narrow, lambda d, p: np.zeros(len(d) + 1)).count()


def test_partition_store_reuse(spark, bars, tmp_path):
    sig = D.signature("v1", {"a": 1})
    assert sig != D.signature("v1", {"a": 2})
    path = str(tmp_path / "store")
    D.write_bars(bars, path, "all", "time_60m", sig)
    D.write_bars(bars.filter(F.col("session_date") == "2024-01-05"), path, "all", "time_60m", sig)
    assert D.read_partitions(spark, path, "all", "time_60m", sig).count() == bars.count()
    with pytest.raises(ValueError):
        D.write_bars(bars.drop("vwap"), path, "all", "time_60m", sig)


def test_month_folds_rules(spark):
    days = spark.sql("select explode(sequence(date'2022-01-01', date'2023-12-31')) as date")
    with pytest.raises(ValueError):
        R.month_folds(days, 12, 2, 1)
    f = R.month_folds(days, 12, 5, 5, allow_partial_last=False)
    assert f.agg(F.max("fold")).first()[0] == 2 and R.month_folds(days, 12, 5, 5).agg(F.max("fold")).first()[0] == 3
    last = R.month_folds(days, 12, 2, 2, purge_days=10).filter("fold = 1").groupBy("role").agg(F.min("date").alias("a"), F.max("date").alias("z")).collect()
    b = {r.role: r for r in last}
    assert (b["test"].a - b["train"].z).days == 11


def test_context_inputs_are_narrow():
    assert len(X.CONTEXT_INPUTS) < 30


def test_stored_matrix_is_warmed_up_over_long_gaps(spark):
    ticks = stored(Inputs(spark, SF).ticks, "ticks")
    days = [r.d for r in ticks.select(F.to_date("ts_event").alias("d")).distinct().orderBy("d").collect()]
    days = [*days[:7], days[-1]]
    assert (days[-1] - days[-2]).days > 11
    few, params = ticks.filter(F.to_date("ts_event").isin(days)), {"context_days": 6}
    last = P.build_matrix(few, "time_60m", params=params).agg(F.max("session_date")).first()[0]
    keys = ["symbol", "session_date", "ts_event", "seq"]
    names = [*keys, "prev_day_high", "prev_day_close", "gap_open", "ema_ratio_50", "adx_14", "regime_vol_relative", "fracdiff_close", "sma_ratio_200"]
    rows = [m.filter(F.col("session_date") == last).select(*names).orderBy(*keys).collect()
            for m in (P.matrix_builder(few, params)([last], "all", "time_60m"), P.build_matrix(few, "time_60m", params=params))]
    assert [r[:4] for r in rows[0]] == [r[:4] for r in rows[1]] and any(r.prev_day_high is not None for r in rows[0])
    for name in names[4:]:
        got, want = ([r[name] for r in m] for m in rows)
        assert got == pytest.approx(want), name


def test_matrix_blocks_name_every_column_once(bars):
    matrix = P.feature_matrix(bars, include_bar_columns=True).columns
    named = [c for n, q in QUERIES.items() if n.startswith("matrix_block_") for c, _ in q.spec[4:]]
    assert sorted(named) == sorted(set(matrix) - {"symbol", "session_date", "ts_event", "seq"}) and len(named) > 200
    assert not [n for n in QUERIES if n.startswith("_")]


def test_ema_turn_takes_rounding_noise_for_no_gap(spark):
    """Closes that stand still, at any price, and closes that meet their EMA exactly: no gap, so no signal before the next real move."""
    flat = [("flat", p, i) for i, p in enumerate([51234.7] * 40 + [51234.8])]
    # From 100 up by 9 ticks the gap is 7 ticks; down by 7 ticks the close is its EMA; then it falls, and rises through it.
    met = [("met", p, i) for i, p in enumerate([100.0, 102.25, 100.5, 100.25, 104.0])]
    even = [("even", 100.0 + 0.25 * k, 100 * k + i) for k in range(40) for i in range(24)]
    df = spark.createDataFrame(flat + met + even, "symbol string, close double, seq int").withColumns(
        {"session_date": F.expr("case when symbol = 'even' then seq div 100 else 0 end"), "ts_event": F.timestamp_seconds("seq")})
    got = {k: [r.signal for r in U.ema_turn(df).where(F.col("symbol") == k).orderBy("seq").collect()] for k in ("flat", "met", "even")}
    assert got == {"flat": [0] * 40 + [1], "met": [0, 1, 0, -1, 1], "even": [0] * 960}


@pytest.mark.parametrize("name", ["condition_pass_through", "condition_feasibility"])
def test_conditions_at_their_bounds_equal_the_sql(spark, tmp_path, name):
    """Closes two per cent apart and returns that cancel out, sessions in summer, and quantiles at a half of the last place."""
    paths = [(400, 408), (400, 408, 408), (406, 420, 435, 420, 405), (420, 400, 420, 440, 418)]
    rows = [(symbol, f"2024-0{month}-{day + 2:02d} {1 + hour:02d}:30:00", level / 4 - 100, 10)
            for month in (1, 7) for day, path in enumerate(paths) for symbol in range(4) for hour, level in enumerate(path)]
    rows += [(0, f"2024-01-20 {hour:02d}:00:0{i}", 1.0, size) for hour in (10, 11, 12) for i, size in enumerate((340, 299))]  # 41 / 640 = 0.0640625
    events = spark.createDataFrame([(2 * i + 1000 if i < len(rows) - 6 else i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, at string, value double, size int")
    assert len(rows) % 2 == 0
    events = events.select("event_id", F.to_timestamp("at").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("purchase").alias("event_type"), "value",
                           F.format_string('{"k": %d}', F.col("size") - 1).alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = run(name, spark, str(tmp_path)).toPandas()
    con = duck(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(got) and difference(got, con.execute(QUERIES[name].sql).df()) is None


def test_a_log_stream_holds_the_ids_of_few_days(spark, monkeypatch):
    from catalog import log_queries as Q
    held, start = [], Q.S.run_log_stream

    def watched(*args):
        held.append(start(*args))
        return held[-1]
    monkeypatch.setattr(Q, "ARRIVING", 300, raising=False)
    monkeypatch.setattr(Q.S, "run_log_stream", watched)
    con = duck(SF)
    for name in ("streaming_trial_counts", "streaming_setup_scorecard", "streaming_log_dedup"):
        held.clear()
        assert difference(run(name, spark, SF).toPandas(), con.execute(QUERIES[name].sql).df()) is None
        peak = max(o.numRowsTotal for q in held for p in q.recentProgress for o in p.stateOperators)
        assert sum(p.numInputRows for q in held for p in q.recentProgress) > 1300 and peak < 700, peak
