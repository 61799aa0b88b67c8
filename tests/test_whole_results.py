"""Nothing is dropped by default, and per-bar lookups stay linear."""

import random
import time

from pyspark.sql import functions as F

from barflow.functions.quantiles import bucketed, exact_quantiles
from barflow.functions.windows import with_ewm
from barflow.operators import logstats as G
from barflow.operators import stats as S
from barflow.operators import trades as T
from barflow.plans import promotion as R
from barflow.plans import strategy as U
from barflow.sources import explog as X
from barflow.sources import store as D

LOG = "event_id string, event string, strategy_name string, bar_config string, verdict string, search_result struct<metrics:struct<net_pnl:double>>, timestamp timestamp"


def _log(spark, n):
    d = spark.range(n).select(F.col("id").cast("string").alias("event_id"), F.lit("task_result").alias("event"),
                              F.when(F.col("id") == 0, "old").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("strategy_name"), F.lit("t1").alias("bar_config"), F.lit("PASS").alias("verdict"),
                              F.struct(F.struct(F.col("id").cast("double").alias("net_pnl")).alias("metrics")).alias("search_result"), F.timestamp_seconds("id").alias("timestamp"))
    return d


def test_old_strategies_keep_their_result(spark):
    assert "old" in {r.strategy_name for r in G.strategy_results(_log(spark, 500), latest=True).collect()}
    assert "old" not in {r.strategy_name for r in G.strategy_results(_log(spark, 500), recent=100).collect()}


def test_old_ids_are_not_appended_again(spark, tmp_path):
    rows = _log(spark, 3000).select("event_id", "timestamp")
    rows.coalesce(1).write.json(str(tmp_path / "log"))
    read = lambda: spark.read.schema(rows.schema).json(str(tmp_path / "log"))
    X.append_log(rows.limit(5).unionByName(spark.createDataFrame([("new",)], "event_id string").withColumn("timestamp", F.current_timestamp())), str(tmp_path / "log"), read())
    assert read().count() == 3001


def test_missing_metric_fails_its_gate(spark):
    results = spark.createDataFrame([("a", 2.0)], "symbol string, sharpe double")
    bounds = spark.createDataFrame([("sharpe", "min", 1.0), ("lockbox_sharpe", "min", 0.0)], "gate string, sense string, bound double")
    rows = R.gates(results, bounds, ["symbol"], ["sharpe"])
    assert {r.gate: r.passed for r in rows.collect()} == {"sharpe": True, "lockbox_sharpe": False}
    assert not R.promotion_verdict(rows, ["symbol"]).first().promoted


def test_short_series_have_a_causality_row(spark):
    bars = spark.range(60).select(F.when(F.col("id") < 10, "short").otherwise("long").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts_event"), F.col("id").alias("seq"), F.rand(1).alias("close"))
    rows = U.causality_check(bars, lambda d, p: d.withColumn("signal", F.lit(1))).collect()
    assert [(r.status, r.prefix_rows) for r in rows if r.symbol == "short"] == [("short", 10)]
    assert sorted((r.prefix_rows, r.status) for r in rows if r.symbol == "long") == [(38, "ok"), (45, "ok"), (49, "ok")]
    late = U.causality_check(bars, lambda d, p: d.withColumn("signal", F.when(F.col("_rn") == F.max("_rn").over(T.Window.partitionBy("symbol")), 1).otherwise(0)))
    assert {r.status for r in late.collect() if r.symbol == "long"} == {"mismatch"}
    lost = U.causality_check(bars, lambda d, p: d.withColumn("signal", F.lit(0)).filter("_rn <> 3"))
    assert {r.status for r in lost.collect() if r.symbol == "long"} == {"length"}


def test_small_keys_keep_an_overfit_row(spark):
    rows = [("few", "a", s, 0.1) for s in range(4)] + [("many", c, s, float((s * 7 + ord(c)) % 5)) for c in "abc" for s in range(4)]
    got = {r.k: (r.available, r.pbo) for r in S.overfit_probability(spark.createDataFrame(rows, "k string, candidate string, split int, score double"), ["k"]).collect()}
    assert got["few"] == (False, 1.0) and got["many"][0]


def test_ewm_of_alpha_one_is_the_input(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, i int, x double")
    assert [r.m for r in with_ewm(d, {"m": ("x", 1.0, 2)}, ["k"], ["i"]).orderBy("i").collect()] == [None, 1.0, 2.0, 3.0, 4.0]


def test_sample_days_truncate_their_places(spark):
    d = spark.range(8).select(F.lit("a").alias("symbol"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("session_date"), F.timestamp_seconds("id").alias("ts_event"), F.lit(0).alias("seq"))
    assert [r.session_date.day - 1 for r in D.sample_days(d, 5, 1).orderBy("session_date").collect()] == [0, 1, 3, 5, 7]


def test_run_trades_of_one_long_day_are_linear(spark):
    def seconds(n):
        bars = spark.range(0, n, 1, 1).select(F.lit("a").alias("symbol"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts_event"), F.col("id").alias("seq"),
                                            F.col("id").cast("double").alias("close"), F.when(F.col("id") % 500 < 250, 1).otherwise(0).alias("signal"))
        t0 = time.time()
        assert T.run_trades(bars, ["symbol"]).count() == n // 500
        return time.time() - t0
    seconds(2000)
    assert seconds(80_000) < 10


def test_one_outlier_does_not_fill_a_bucket(spark):
    rows = [("a", i / 2000.0) for i in range(2000)] + [("a", 1e9), ("b", 5.0), ("b", 5.0), ("c", None)]
    d = spark.createDataFrame(rows, "k string, x double")
    sizes = bucketed(d, ["k"], "x").filter("k = 'a'").groupBy("_b").agg(F.sum("_n").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] < 0.05 * 2001
    got = {r.k: (r.lo, r.mid) for r in exact_quantiles(d, ["k"], "x", {"lo": 0.1, "mid": 0.5}).collect()}
    assert got == {"a": (200 / 2000.0, 1000 / 2000.0), "b": (5.0, 5.0)}


def test_quantiles_of_many_columns_equal_plain_ones(spark):
    """Ties, nulls, infinities, a constant, a lone value and extremes; tiny accuracies force brackets that must open, tiny widths several blocks."""
    import numpy as np
    from barflow.functions.quantiles import column_quantiles
    rng = random.Random(5)
    rows = []
    for k, n in (("a", 3000), (None, 700), ("c", 1)):
        for i in range(n):
            rows.append((k, rng.gauss(0, 1), float(rng.choice([0, 0, 0, 1])), None if i % 3 else float(i), rng.choice([float("nan"), float("inf"), 2.5]), 7.0,
                         None, rng.choice([-1e308, 1e308, 0.0, -0.0, 1e-300]), int(rng.paretovariate(0.3)) % 10 ** 9))
    names = ["u", "v", "w", "x", "y", "z", "t", "i"]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names[:-1]) + ", i long").repartition(5)
    probs = {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p97": 0.97, "hi": 1.0}
    for accuracy, width, buckets in ((10000, 32, 1024), (7, 3, 2)):
        got = {(r.k, r.column_name): r for r in column_quantiles(df, ["k"], names, probs, lambda v, x: {"n": F.count(x)}, accuracy, buckets, width).collect()}
        assert len(got) == 3 * len(names)
        for k in ("a", None, "c"):
            for c, name in enumerate(names):
                own = np.array([r[c + 1] for r in rows if r[0] == k and r[c + 1] is not None], dtype=float)
                own = np.sort(own[np.isfinite(own)])
                r = got[k, name]
                assert r.n == len(own)
                for p, q in probs.items():
                    h = q * (len(own) - 1)
                    want = None if not len(own) else own[int(np.floor(h))] + (own[int(np.ceil(h))] - own[int(np.floor(h))]) * (h - np.floor(h))
                    assert r[p] == want or abs(r[p] - want) <= 1e-12 * abs(want), (accuracy, k, name, p)
    assert column_quantiles(df.limit(0), [], ["u", "i"], probs).collect() == []
    assert {r.column_name: r.p50 for r in column_quantiles(df.where("k = 'c'"), [], ["u", "z"], probs).collect()} == {"u": rows[-1][1], "z": None}
