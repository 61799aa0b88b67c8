"""Stores, streams, orders by hash, statistics and the edge surface against plain Python."""

import hashlib
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from barflow.functions import ranks as R
from barflow.functions import windows as W
from barflow.operators import bars as B
from barflow.operators import edge as E
from barflow.operators import logstats as G
from barflow.operators import stats as T
from barflow.sources import explog as X
from barflow.sources import store as D
from barflow.sources import ticks as K
from barflow.streaming import jobs as S


def test_store_builds_empty_days_once_and_repairs_what_is_not_whole(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []
    days = [date(2024, 1, d) for d in (2, 3, 4)]
    wanted = spark.createDataFrame([("all", "time_60m", d) for d in days], "session string, bar_config string, date date")

    def build(columns):
        def rows(need, session, config):
            calls.append(sorted(need))
            one = [("S", d, 1.0) for d in need if d != days[1]]
            df = spark.createDataFrame(one, "symbol string, session_date date, x double")
            return df if columns == 1 else df.withColumn("y", F.lit(2.0))
        return rows
    first = D.load_or_build(spark, path, wanted, build(1), "v").first()
    assert (first.total, first.completed, first.errors, first.empty) == (3, 3, 0, 1)
    assert D.load_or_build(spark, path, wanted, build(1), "v").count() == 0 and calls == [days]
    # a column that is wanted now makes every day that lacks it incomplete
    D.load_or_build(spark, path, wanted, build(2), "v", required=["x", "y"])
    assert calls[1:] == [days] and D.read_partitions(spark, path, "all", "time_60m", "v").filter("y = 2").count() == 2
    # rows without a note, as a writer leaves them that is cut off, are no stored day; lost rows are found by count
    late = date(2024, 1, 5)
    cut = spark.createDataFrame([("S", late, 9.0, 9.0, "all", "time_60m", "v", late)], "symbol string, session_date date, x double, y double, session string, bar_config string, sig string, date date")
    cut.write.mode("append").partitionBy(*D.PARTITIONS).parquet(path)
    more = wanted.unionByName(wanted.limit(1).withColumn("date", F.lit(late)))
    D.load_or_build(spark, path, more, build(2), "v", required=["x", "y"])
    assert calls[2:] == [[late]] and D.read_partitions(spark, path, "all", "time_60m", "v").filter(F.col("date") == late).first().x == 1.0
    cut.filter("x < 0").write.mode("append").partitionBy(*D.PARTITIONS).parquet(path)
    cut.write.mode("append").partitionBy(*D.PARTITIONS).parquet(path)
    D.load_or_build(spark, path, more, build(2), "v", check_rows=True)
    assert calls[3:] == [[late]] and D.read_partitions(spark, path, "all", "time_60m", "v").filter(F.col("date") == late).count() == 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The first batch is written, then its commit is lost: the stream starts again with the same batch id."""
    rows = X.log_from_events(spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 7, "click", float(i % 50), '{"k": 5}') for i in range(60)],
                                                   "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"))
    src, out, parts = (str(tmp_path / n) for n in ("src", "out", "parts"))
    rows.unionByName(rows.filter("seq % 3 = 0")).write.parquet(src)
    stream, sink, cut = spark.readStream.schema(rows.schema).parquet(src), S.batch_sink(out, parts), []

    def update(df, i):
        sink(df, i)
        if not cut:
            cut.append(i)
            raise RuntimeError("lost before the commit")
    with pytest.raises(StreamingQueryException):
        S.run_log_stream(stream, str(tmp_path / "ck"), update).awaitTermination()
    S.run_log_stream(stream, str(tmp_path / "ck"), update).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 60 == got.select("event_id").distinct().count()
    assert S.counted_trials(spark.read.parquet(parts)).first() == G.trial_counts(rows).first()


def _same_bars(a, b):
    cols = [c for c in B.BAR_COLUMNS if c in a.columns]
    return sorted(map(str, a.select("symbol", *cols).collect())) == sorted(map(str, b.select("symbol", *cols).collect())) and len(cols) > 40


@pytest.mark.parametrize("config", ["vol_20", "tick_3"])
def test_streamed_volume_and_tick_bars_close_in_order(spark, tmp_path, config):
    """Trades out of order within the lateness, null quotes, other messages, a summer day that ends at 04:00 UTC, and trades that come too late."""
    rng, start = random.Random(8), datetime(2024, 7, 15, 13)
    rows = []
    for i in range(240):
        t = start + timedelta(minutes=4 * i, microseconds=i % 7)
        quote = (None,) * 6 if i % 5 == 0 else (99.75, 100.25, 10 + i, 8, 3, 2)
        rows.append((f"S{i % 2}", t, t + timedelta(microseconds=5), i, "A" if i % 11 == 0 else "T", rng.choice("AB"), rng.randint(1, 9), 100 + rng.randint(0, 8) / 4, *quote))
    end = start + timedelta(days=3)
    last = ("S9", end, end, 999, "T", "A", 1, 100.0, *(None,) * 6)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def feed(part):
        spark.createDataFrame(part, K.TICKS).coalesce(1).write.mode("append").parquet(src)
        S.run_numbered_bar_stream(spark.readStream.schema(spark.createDataFrame([], K.TICKS).schema).parquet(src), config, out, ck, "30 minutes").awaitTermination()
        return spark.read.parquet(out)
    slices = [rows[:100], rows[100:160], rows[160:]]
    slices[0][97:], slices[1][:3] = slices[1][:3], slices[0][97:]  # twelve minutes of trades swap their files
    whole, seen = B.build_bars(spark.createDataFrame(rows, K.TICKS), config), 0
    for part in slices:
        rng.shuffle(part)
        n = feed(part).count()
        assert seen < n < whole.count()
        seen = n
    assert _same_bars(feed([last]), whole)
    assert _same_bars(feed(rows[:50]), whole)
    with pytest.raises(ValueError):
        S.closed_bar_trades(spark.createDataFrame(rows, K.TICKS), "time_5m")


def test_unavailable_deflated_sharpe_is_zero_and_fails_its_gate(spark):
    rows = [("two", 1.0), ("two", 2.0), *[("flat", 3.0)] * 4, ("none", None), ("none", float("nan")), *[("good", float(v)) for v in (1, 2, 3, 2, 4)]]
    d = T.deflated_sharpe(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", 5)
    got = {r.k: r for r in d.collect()}
    assert set(got) == {"two", "flat", "none", "good"} and all(got[k].dsr == 0.0 and not got[k].available and got[k].sharpe == 0.0 for k in ("two", "flat", "none"))
    assert got["good"].available and got["good"].dsr > 0.5
    gates = T.advanced_gates(d.withColumnRenamed("available", "dsr_available"), min_dsr=0.0)
    assert {r.k for r in gates.collect() if r.passed} == {"good"}
    assert [r.enabled for r in T.advanced_gates(d.limit(1)).collect()] == [False]


def test_attribution_of_dependent_factors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 60))
    for x, rank, verdict in ((np.stack([a, 2 * a, b]), 3, "INCONCLUSIVE"), (np.stack([a, b, 0 * a]), 3, "ALPHA_WITH_BETA_EXPOSURE")):
        y = 5 + 3 * x[0] + 0.1 * rng.normal(size=60)
        m = np.cov(np.vstack([y, x]), bias=True)
        out = T._least_squares(60, np.r_[y.mean(), x.mean(axis=1)], m, 0.3, 0.0455)
        design = np.column_stack([np.ones(60), *[f for f in x if f.std() > 1e-12]])
        want = np.linalg.lstsq(design, y, rcond=None)
        assert out[-3] == rank == want[2] and out[-1] == verdict
        assert np.allclose([out[0], *[v for v, f in zip(out[4:7], x) if f.std() > 1e-12]], want[0], atol=1e-6)


@pytest.mark.parametrize("alpha", [0.95, 0.999, 0.999999, 1 - 1e-12])
def test_ewm_of_large_alpha(spark, alpha):
    x = [float((i * 37) % 11) - 5 for i in range(700)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double").withColumn("k", F.lit(1))
    got = [r.m for r in W.with_ewm(df, {"m": ("x", alpha, 1)}, ["k"], ["i"]).orderBy("i").collect()]
    want = [x[0]]
    for v in x[1:]:
        want.append((1 - alpha) * want[-1] + alpha * v)
    assert np.allclose(got, want, atol=1e-9)


def test_exact_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(6)), int(rng.random() < 0.4)) for _ in range(300)] + [(None, 1), (float("nan"), 0)]
    ok = [(s, y) for s, y in rows if s is not None and s == s]
    p, n = [s for s, y in ok if y], [s for s, y in ok if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n)
    df = spark.createDataFrame(rows, "s double, y int")
    assert abs(T.exact_auc(df, "s", "y", buckets=3).first().auc - want) < 1e-12
    assert T.exact_auc(df.filter("y = 1"), "s", "y").first().auc is None


@pytest.mark.parametrize("digits", [1, 3])
def test_smallest_hashes_and_offsets_without_a_window_over_the_group(spark, digits):
    rows = [(k, i, i % 5 + 1) for k, n in (("a", 300), ("b", 1), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, n int").withColumn("h", R.keyed_hash(1, F.col("i")))
    last = {r.k: r["last"].h for r in R.nth_smallest(df, ["k"], "h", ["i"], F.ceil(F.col("size") * 0.3), digits).collect()}
    off = {(r.k, r.i): r.at for r in R.running_offset(df, ["k"], "h", ["i"], "n", "at", digits).collect()}
    for k in "abc":
        own = sorted((hashlib.md5(f"1:{i}".encode()).hexdigest(), i, n) for j, i, n in rows if j == k)
        assert last[k] == own[-(-len(own) * 3 // 10) - 1][0]
        at = 0
        for _, i, n in own:
            assert off[k, i] == at
            at += n


def test_edge_surface_of_one_pocket(spark):
    """Entries pay off on volatile bars only: a localised edge, found in the volatility family at the bars' own costs."""
    rows, t = [], datetime(2024, 1, 2, 15)
    for day in range(6):
        for i in range(12):
            at = t + timedelta(days=day, minutes=i)
            hot = i == 4
            close = 100.0 + (5.0 if i == 5 else -3.0 if i == 9 else 0.0)
            rows.append(("X", at, i, 100.0, close, 1 if i in (4, 8) else 0, 0.9 if hot else 0.1 + i / 100, 100.0, 99.875, 100.125))
    bars = spark.createDataFrame(rows, "symbol string, ts_event timestamp, seq int, open double, close double, signal int, regime_vol_relative double, volume double, bid_price double, ask_price double")
    config = {"enabled": True, "horizons": [1, 90], "min_events": 6, "min_pocket_events": 6, "min_positive_day_fraction": 0.5}
    surface = E.edge_surface(bars, ["symbol"], False, config).cache()
    got = {(r.family, r.label): r for r in surface.collect()}
    assert got["global", "all"].base_event_count == 12 and got["side", "short"].base_event_count == 0 and not got["side", "short"].passed
    best = E.best_pockets(surface, ["symbol"], config).first()
    assert (best.family, best.label, best.best_event_count, best.best_horizon_bars) == ("vol_bucket", "high", 6, 1) and best.best_avg_trade_pnl < 5 * 20 - 4.5
    wanted = spark.createDataFrame([("X",), ("Y",)], "symbol string")
    assert {r.symbol: r.status for r in E.surface_status(surface, ["symbol"], config, wanted).collect()} == {"X": "global_edge" if got["global", "all"].passed else "localized_edge_only", "Y": "no_data"}
    few = {**config, "min_events": 100}
    small = E.edge_surface(bars, ["symbol"], False, few)
    assert [(r.family, r.positive_horizons, r.best_horizon_bars) for r in small.collect()] == [("global", 0, None)]
    assert E.surface_status(small, ["symbol"], few).first().status == "insufficient_events"
    assert {(r.family, r.reason) for r in E.omitted_families(bars.withColumn("spread_bps", F.lit(1.0))).collect()} == {
        ("spread_bucket", "insufficient_variation"), ("activity_bucket", "missing_column"), ("direction_bucket", "missing_column"), ("value_area_bucket", "missing_column")}
    assert E.normalize_config({"enabled": 1, "horizons": [40, 5, 1, 5, None], "min_events": 12}) | {} == {**E.normalize_config({}), "enabled": True, "horizons": [1, 5, 40], "min_events": 12, "min_pocket_events": 12}
