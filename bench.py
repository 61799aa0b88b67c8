"""Headline timings: prints one JSON line.  Scale and cores come from BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")


def main() -> None:
    from pyspark.sql import SparkSession

    from barflow.operators import gauntlet as G
    from barflow.plans.matrix import feature_matrix
    from catalog import run
    from catalog.base import Inputs
    from catalog.validation_queries import stored_signals

    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, build):
        t0 = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    x = Inputs(spark, SF_DIR)
    timed("warm_up", lambda: x.table("events"))
    del times["warm_up"]
    for name in ("tick_scan", "time_bars", "volume_bars", "tick_bars", "macd", "rolling_profile", "run_trades", "strategy_metrics",
                 "adaptive_round_trip_cost", "walk_forward_folds", "edge_surface", "feature_profile", "trial_counts", "theme_scorecard"):
        timed(name, lambda n=name: run(n, spark, SF_DIR))
    timed("tick_to_matrix", lambda: feature_matrix(x.stored_bars(), include_bar_columns=True))
    timed("shuffle_gauntlet_100", lambda: G.shuffle_test(stored_signals(x), ["symbol"], 100))
    ticks = x.ticks.count()
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR,
                      "ticks": ticks, "tick_to_matrix_rows_per_sec": round(ticks / times["tick_to_matrix"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
