"""Walk-forward promotion: month folds, fold aggregation, gates, and strategy evaluation verdicts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pnl import daily_pnl, daily_trade_counts, metrics, trade_pnl
from ..operators.stats import deflated_sharpe


def month_folds(days: DataFrame, train: int = 12, test: int = 2, step: int = 2, embargo: int = 0, purge_days: int = 0,
                allow_partial_last: bool = True) -> DataFrame:
    """(fold, role, date) rows of rolling month folds; months are the distinct months that have days."""
    if train < 1 or test < 1 or embargo < 0 or purge_days < 0:
        raise ValueError("months must be positive, embargo and purge not negative")
    if step != test:
        raise ValueError("step must equal test so that test folds do not overlap")
    d = days.select("date").distinct().withColumn("month", F.date_trunc("month", F.col("date")).cast("date"))
    order = Window.partitionBy(F.lit(0)).orderBy("month")
    months = d.select("month").distinct().withColumn("m", F.row_number().over(order) - 1)
    months = months.withColumn("month_count", F.max("m").over(Window.partitionBy(F.lit(0))) + 1)
    d = d.join(months, "month")
    first = train + embargo
    fold_of_test = F.expr(f"if(m >= {first}, (m - {first}) div {step}, null)")
    whole = F.lit(True) if allow_partial_last else (F.lit(first) + F.col("_f") * step + test <= F.col("month_count"))
    tests = d.withColumn("_f", fold_of_test).filter(F.col("_f").isNotNull() & whole).select("date", "_f", F.lit("test").alias("role"))
    # A month trains every fold whose training window covers it: a short, bounded list.
    lo, hi = f"greatest(ceil((m - {train} + 1) / {step}), 0)", f"least(floor(m / {step}), floor((month_count - 1 - {first}) / {step}))"
    trains = d.filter(F.expr(f"{lo} <= {hi}")).withColumn("_f", F.explode(F.expr(f"sequence(cast({lo} as int), cast({hi} as int))"))).filter(
        F.expr(f"m >= _f * {step} and m < _f * {step} + {train}"))
    starts = tests.groupBy("_f").agg(F.min("date").alias("_first"))
    trains = trains.join(starts, "_f")
    if purge_days > 0:
        trains = trains.filter(F.col("date") < F.date_sub("_first", purge_days))
    rows = trains.select("date", "_f", F.lit("train").alias("role")).unionByName(tests)
    # A fold whose training days are all purged is skipped and the others are renumbered: one row a fold.
    kept = trains.select("_f").distinct().withColumn("fold", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_f")))
    return rows.join(kept, "_f").select("fold", "role", "date")


def _fold_trades(trades: DataFrame, folds: DataFrame) -> DataFrame:
    t = trades.withColumn("date", F.to_date("exit_time"))
    return t.join(folds.filter("role = 'test'").select("fold", "date"), "date").drop("date")


def fold_results(trades: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of the trades that exit on each fold's test days; a fold without trades has zeros."""
    numbers = folds.filter("role = 'test'").agg(F.array_sort(F.collect_set("fold")).alias("_f"))  # one row: the fold numbers
    every = trades.select(*keys).distinct().join(F.broadcast(numbers), F.lit(True)).select(*keys, F.explode("_f").alias("fold"))
    m = metrics(_fold_trades(trades, folds), [*keys, "fold"])
    return every.join(m, [*keys, "fold"], "left").na.fill(0.0, ["net_pnl", "sharpe_ratio"]).na.fill(0, ["trade_count"])


def walk_forward_result(trades: DataFrame, folds: DataFrame, keys: list[str], raw_trials: int, effective_trials: int | None = None) -> DataFrame:
    """Positive-fold share, Sharpe of the concatenated daily returns, its deflation by the effective trials, Sharpe at
    twice the costs, and trades per day.

    Every fold counts, with Sharpe 0 if it has no trades.  Daily returns and trade counts are filled with zeros over the
    weekdays between a fold's first and last exit.
    """
    per = fold_results(trades, folds, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fold_count"), F.avg((F.coalesce("sharpe_ratio", F.lit(0.0)) > 0).cast("double")).alias("pct_positive"),
        F.sum("trade_count").alias("trade_count"), F.sum("net_pnl").alias("net_pnl"))
    t, by_fold = _fold_trades(trades, folds), [*keys, "fold"]
    daily = daily_pnl(trade_pnl(t, "adaptive_cost_rt"), by_fold).withColumnRenamed("net_pnl", "x")
    dear = daily_pnl(trade_pnl(t, "adaptive_cost_rt", 2.0), by_fold).groupBy(*keys).agg(
        F.expr(f"if(stddev_samp(net_pnl) > 0, avg(net_pnl) / stddev_samp(net_pnl) * {math.sqrt(252.0)!r}D, 0D)").alias("sharpe_2x_cost"))
    density = daily_trade_counts(t, by_fold).groupBy(*keys).agg(F.avg("trade_count").alias("avg_trades_per_day"), F.max("trade_count").alias("max_trades_per_day"))
    trials = min(max(1, int(raw_trials if effective_trials is None else effective_trials)), max(1, int(raw_trials)))
    dsr = deflated_sharpe(daily, keys, "x", trials).select(
        *keys, F.expr(f"sharpe * {math.sqrt(252.0)!r}D").alias("aggregate_sharpe"), F.expr("if(available, sharpe - expected_max_sharpe_null, 0D)").alias(
            "deflated_sharpe"), F.expr("if(available, dsr, 0D)").alias("dsr_probability"))
    out = per.join(dsr, keys, "left").join(dear, keys, "left").join(density, keys, "left")
    return out.na.fill(0.0, ["aggregate_sharpe", "deflated_sharpe", "dsr_probability", "sharpe_2x_cost", "avg_trades_per_day"]).na.fill(0, ["max_trades_per_day"])


LOCKBOX = ["lockbox_sharpe", "lockbox_net_pnl", "lockbox_trade_count", "lockbox_sharpe_2x_cost", "lockbox_avg_trades_per_day", "lockbox_max_trades_per_day"]


def lockbox_result(trades: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Sharpe, net PnL, counts and Sharpe at twice the costs of the trades that exit on days with role ``lockbox``, one row per key of ``trades``.

    Daily figures fill the weekdays between the first and last exit with zeros; a key without such trades has zeros.
    """
    days = folds.filter("role = 'lockbox'").select("date").distinct()
    t = trades.withColumn("date", F.to_date("exit_time")).join(days, "date", "left_semi").drop("date")
    pnl = trade_pnl(t, "adaptive_cost_rt")
    year = math.sqrt(252.0)

    def sharpe(name: str):
        return F.expr(f"if(stddev_samp(net_pnl) > 0, avg(net_pnl) / stddev_samp(net_pnl) * {year!r}D, 0D)").alias(name)
    once = daily_pnl(pnl, keys).groupBy(*keys).agg(sharpe("lockbox_sharpe"))
    twice = daily_pnl(trade_pnl(t, "adaptive_cost_rt", 2.0), keys).groupBy(*keys).agg(sharpe("lockbox_sharpe_2x_cost"))
    total = pnl.groupBy(*keys).agg(F.sum("net_pnl").alias("lockbox_net_pnl"), F.count(F.lit(1)).alias("lockbox_trade_count"))
    density = daily_trade_counts(t, keys).groupBy(*keys).agg(F.avg("trade_count").alias("lockbox_avg_trades_per_day"), F.max("trade_count").alias("lockbox_max_trades_per_day"))
    out = trades.select(*keys).distinct()
    for part in (once, twice, total, density):
        out = out.join(part, keys, "left")
    return out.na.fill(0.0, [c for c in LOCKBOX if not c.endswith(("count", "max_trades_per_day"))]).na.fill(0, ["lockbox_trade_count", "lockbox_max_trades_per_day"])


def gates(results: DataFrame, thresholds: DataFrame, keys: list[str], metrics_: list[str]) -> DataFrame:
    """One row per strategy and gate: the metric, its bound and whether it passes (``sense`` is min or max).

    Every threshold gives a row for every strategy; a gate whose metric is missing fails.
    """
    long = results.select(*keys, *[F.col(c).cast("double").alias(c) for c in metrics_]).unpivot(keys, metrics_, "gate", "value")
    bounds = F.array_sort(F.collect_list(F.struct("gate", "sense", "bound")))
    every = results.select(*keys).distinct().join(F.broadcast(thresholds.agg(bounds.alias("_t"))), F.lit(True)).select(*keys, F.explode("_t").alias("_t")).select(*keys, "_t.*")
    return every.join(long, [*keys, "gate"], "left").withColumn("passed", F.coalesce(
        F.expr("if(sense = 'min', value >= bound, value <= bound)"), F.lit(False)))


def promotion_verdict(gate_rows: DataFrame, keys: list[str]) -> DataFrame:
    return gate_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("gate_count"), F.count_if("passed").alias("passed_count")).withColumn(
        "promoted", F.col("gate_count") == F.col("passed_count"))


def two_stage_verdict(search: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Final verdict of search then selection: selection counts only for candidates that passed the search."""
    j = search.select(*keys, F.col("verdict").alias("search_verdict")).join(
        selection.select(*keys, F.col("verdict").alias("selection_verdict")), keys, "left")
    j = j.withColumn("selection_verdict", F.when(F.col("search_verdict") == "PASS", F.col("selection_verdict")))
    return j.withColumns({
        "final_verdict": F.expr("if(search_verdict = 'PASS' and selection_verdict = 'PASS', 'PASS', 'FAIL')"),
        "candidate_status": F.expr("""case when search_verdict <> 'PASS' then 'rejected_search' when selection_verdict is null then 'awaiting_selection'
            when selection_verdict = 'PASS' then 'candidate' else 'rejected_selection' end""")})
