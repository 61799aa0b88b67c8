import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions.quantiles import exact_quantiles
from barflow.functions.windows import with_ewm
from barflow.operators import gauntlet as G
from barflow.operators import momentum as M
from barflow.operators import pnl as L
from barflow.operators import stats as S
from barflow.operators import trades as T
from barflow.operators.volume_profile import volume_profile

SCHEMA = "symbol string, session_date date, ts_event timestamp, seq bigint, open double, high double, low double, close double, volume bigint, signal int"


def series(spark, signals_by_day, seed=1):
    rng, rows, px = random.Random(seed), [], 100.0
    for d, signals in enumerate(signals_by_day):
        day = datetime(2024, 1, 2) + timedelta(days=d)
        for i, s in enumerate(signals):
            o, px = px, px + rng.choice([-0.5, -0.25, 0.25, 0.5])
            rows.append(("X", day.date(), day + timedelta(hours=15, minutes=i), 0, o, max(o, px) + 0.25, min(o, px) - 0.25, px, 100 + i % 7, s))
    return rows, spark.createDataFrame(rows, SCHEMA)


def replay(rows, next_open):
    """Bar-by-bar account of the same rules: no stops, flat at each day's end."""
    out, pos, entry, pending = [], 0, None, 0
    for k, r in enumerate(rows):
        last = k + 1 == len(rows) or rows[k + 1][1] != r[1]
        due, pending = pending, 0
        if due and not pos:
            pos, entry = due, (r[2], r[4])
        if last and pos:
            out.append((*entry, r[2], r[7], pos))
            pos = 0
            continue
        if r[9] != pos:
            if pos:
                out.append((*entry, r[2], r[7], pos))
                pos = 0
            if r[9]:
                if next_open:
                    pending = r[9] if k + 1 < len(rows) else 0
                elif not last:
                    pos, entry = r[9], (r[2], r[7])
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 8])
def test_trades_equal_replay(spark, seed):
    rng = random.Random(seed)
    days = [[rng.choice([0, 0, 1, -1]) if rng.random() < 0.6 else 1 for _ in range(rng.randint(2, 9))] for _ in range(60)]
    rows, df = series(spark, days, seed)
    for next_open, fn in ((False, T.run_trades), (True, T.next_open_trades)):
        got = sorted((t.entry_time, t.entry_price, t.exit_time, t.exit_price, t.direction) for t in fn(df, ["symbol"]).collect())
        assert got == replay(rows, next_open)


def test_first_touch_gap_and_priority(spark):
    rows = [("X", datetime(2024, 1, 2).date(), datetime(2024, 1, 2, 15, i), 0, o, h, l, c, 100, 0) for i, (o, h, l, c) in enumerate(
        [(100, 101, 99, 100), (97, 98, 96, 97), (100, 106, 94, 101)])]
    bars = spark.createDataFrame([tuple(float(v) if isinstance(v, int) and k in (4, 5, 6, 7) else v for k, v in enumerate(r)) for r in rows], SCHEMA)
    e = spark.createDataFrame([("X", datetime(2024, 1, 2, 15, 0), 100.0, 1), ("X", datetime(2024, 1, 2, 15, 1), 98.0, -1)],
                              "symbol string, entry_time timestamp, entry_price double, direction int")
    got = {r.direction: (r.exit_price, r.exit_reason) for r in T.first_touch(bars, e, ["symbol"], 3.0, 2.0).collect()}
    assert got == {1: (97.0, "stop"), -1: (100.0, "stop")}


def test_ewm_over_blocks_equals_recurrence(spark):
    rng = random.Random(5)
    xs = [None, None] + [rng.uniform(-5, 5) for _ in range(70)]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "g string, i int, x double")
    got = {r.i: r.e for r in with_ewm(df, {"e": ("x", 0.2, 3)}, ["g"], ["i"], block=8).collect()}
    s, seen = None, 0
    for i, x in enumerate(xs):
        if x is not None:
            s, seen = (x if s is None else 0.8 * s + 0.2 * x), seen + 1
        assert (got[i] is None) if seen < 3 else math.isclose(got[i], s, rel_tol=1e-12)


def test_exact_quantiles_with_one_hot_group(spark):
    rng = np.random.default_rng(0)
    data = [("hot", float(v)) for v in rng.lognormal(size=3000)] + [("cold", float(v)) for v in rng.integers(0, 4, 50)] + [("one", 2.0)]
    q = exact_quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 1 / 3}, buckets=16)
    for r in q.collect():
        vals = [v for k, v in data if k == r.k]
        assert np.allclose([r.a, r.b, r.c], np.quantile(vals, [0.1, 0.5, 1 / 3]))


def test_labels_known_answer(spark):
    closes = [100, 102, 101, 103, 105, 104, 106, 108, 107, 109, 111, 110, 113]
    rows = [("X", datetime(2024, 1, 2).date(), datetime(2024, 1, 2, 15, i), 0, 1.0, 1.0, 1.0, float(c), 1, 0) for i, c in enumerate(closes)]
    out = M.labels(spark.createDataFrame(rows, SCHEMA)).orderBy("ts_event").collect()
    assert [round(out[0][f"fwd_return_{n}bar"], 6) for n in (1, 3, 6, 12)] == [0.02, 0.03, 0.06, 0.13]
    assert out[1].fwd_return_12bar is None and out[-1].label_1bar is None


def test_opening_range_waits_for_half_hour(spark):
    rows = [("X", datetime(2024, 1, 2).date(), datetime(2024, 1, 2, 14, 30) + timedelta(minutes=5 * i), 0, 100.0, 101.0 + i, 99.0, 100.0 + i, 1, 0) for i in range(8)]
    out = M.opening_range(spark.createDataFrame(rows, SCHEMA)).orderBy("ts_event").collect()
    assert [r.or_width is None for r in out] == [True] * 6 + [False] * 2
    assert [r.or_broken_up for r in out[6:]] == [0.0, 1.0]


def test_profile_value_area_and_ties(spark):
    df = spark.createDataFrame([("X", datetime(2024, 1, 2).date(), datetime(2024, 1, 2, 15, 0), 0, 100.0, 101.0, 99.0, 100.0, 100,
                                 [99.5, 100.0, 100.5, 101.0], [10, 40, 40, 10])],
                               "symbol string, session_date date, ts_event timestamp, seq bigint, open double, high double, low double, close double, volume bigint, "
                               "vap_prices array<double>, vap_volumes array<bigint>")
    r = volume_profile(df).first()
    assert (r.poc_price, r.va_low, r.va_high) == (100.0, 100.0, 100.5)


@pytest.mark.parametrize("state, cost", [((1.0, 0.0, 0.0, 0.5), 14.5), ((2.0, 1.5, 0.5, 0.5), 31.5), ((1.0, 0.0, 10.0, 0.5), 9.5)])
def test_cost_model(spark, state, cost):
    df = spark.createDataFrame([state], "spread_ticks double, volatility_z double, volume_z double, rth_progress double")
    assert math.isclose(df.select(L.cost_rt()).first()[0], cost)


def test_metrics_drawdown_and_sharpe(spark):
    pnl = [100.0, -250.0, 40.0, -10.0, 300.0]
    rows = [("X", datetime(2024, 1, 1 + i, 15), datetime(2024, 1, 1 + i, 16), 100.0, 100.0 + (v + 14.5) / 20, 1, 1) for i, v in enumerate(pnl)]
    m = L.metrics(spark.createDataFrame(rows, "symbol string, entry_time timestamp, exit_time timestamp, entry_price double, exit_price double, direction int, size int"),
                  ["symbol"]).first()
    assert math.isclose(m.sharpe_ratio, np.mean(pnl) / np.std(pnl, ddof=1) * math.sqrt(252), rel_tol=1e-9)
    assert math.isclose(m.max_drawdown, 250.0) and math.isclose(m.net_pnl, sum(pnl)) and (m.win_count, m.loss_count) == (3, 2)


def test_deflated_sharpe_against_numpy(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 80)
    r = S.deflated_sharpe(spark.createDataFrame([("a", float(v)) for v in x], "k string, v double"), ["k"], "v", 20).first()
    z = (x - x.mean()) / x.std(ddof=1)
    sr = x.mean() / x.std(ddof=1)
    se = math.sqrt((1 - (z**3).mean() * sr + ((z**4).mean() - 3) / 4 * sr**2) / 79)
    assert math.isclose(r.sharpe, sr, rel_tol=1e-9) and math.isclose(r.sharpe_std_error, se, rel_tol=1e-9)
    assert 0 < r.dsr < 1 and r.expected_max_sharpe_null > 0


def test_factor_attribution_recovers_beta(spark):
    rng = np.random.default_rng(2)
    rows, trades, px, prev = [], [], 100.0, 100.0
    for d in range(45):
        day = datetime(2024, 1, 1) + timedelta(days=d)
        for i in range(6):
            px *= 1 + rng.normal(0, 0.01)
            rows.append(("X", day + timedelta(hours=i), i, px))
        trades.append(("X", day + timedelta(hours=1), day + timedelta(hours=2), 5000.0 * (px / prev - 1) + 7.0))
        prev = px
    bars = spark.createDataFrame(rows, "symbol string, ts_event timestamp, seq int, close double")
    pnl = spark.createDataFrame(trades, "symbol string, entry_time timestamp, exit_time timestamp, net_pnl double")
    r = S.factor_attribution(pnl, bars, ["symbol"]).first()
    assert math.isclose(r.beta_market_return, 5000, rel_tol=1e-6) and math.isclose(r.alpha_daily, 7, rel_tol=1e-4) and r.r_squared > 0.999


def test_shuffles_keep_blocks_and_rows(spark):
    rng = random.Random(4)
    rows, df = series(spark, [[rng.choice([0, 1, -1]) for _ in range(12)] for _ in range(6)])
    out = G.shuffled_signals(df, ["symbol"], 5, 42).groupBy("iteration").agg(
        F.count("*").alias("n"), F.sum("signal").alias("s"), F.sum(F.abs("signal")).alias("a"), F.countDistinct("ts_event").alias("t")).collect()
    want = (len(rows), sum(r[9] for r in rows), sum(abs(r[9]) for r in rows), len(rows))
    assert len(out) == 5 and all((r.n, r.s, r.a, r.t) == want for r in out)


def test_adaptive_gauntlet_runs(spark):
    rng = random.Random(6)
    _, df = series(spark, [[rng.choice([0, 1, 1, -1]) for _ in range(10)] for _ in range(10)])
    r = G.walk_forward_folds(df, ["symbol"], 3, adaptive=True).orderBy("fold").collect()
    assert [x.fold for x in r] == [1, 2, 3] and sum(x.trade_count for x in r) > 0
    assert G.decay_test(df, ["symbol"], 4, adaptive=True).first().chunk_count == 4


def test_class_split_takes_the_share_as_written(spark):
    rows = spark.range(1460 + 55 + 1).select(F.expr("case when id < 1460 then 0 when id < 1515 then 1 else 2 end").alias("label"), F.col("id").alias("x"))
    got = {r.label: r.n for r in S.class_split(rows, "label", ["x"]).groupBy("label").agg(F.count_if("fit").alias("n")).collect()}
    assert got == {0: 1022, 1: 38, 2: 1}
    assert S.class_split(rows.where("x < 50"), "label", ["x"], 0.58).agg(F.count_if("fit")).first()[0] == 29


def test_adversarial_report_validates_on_three_tenths_of_each_side(spark):
    rows = spark.range(360).select(*[F.rand(k).alias(f"f{k}") for k in range(3)])
    report = S.adversarial_validation(rows, rows, ["f0", "f1", "f2"], trees=2)[0].first()
    assert (report.used, report.train_rows, report.holdout_rows, report.validation_rows) == (True, 360, 360, 216)
