"""Seven robustness checks of a signal.  Iterations, folds and chunks are rows, not reruns.

Each check takes bars with ``signal`` and returns one row per key with a PASS or FAIL ``verdict``.
Random orders come from keyed hashes, so they do not depend on partitioning.  With ``adaptive`` the
trades pay the cost of their entry bar, else the flat round-trip cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import keyed_hash, nth_smallest, running_offset
from ..params import resolve
from ..sources.stage import stored
from .pnl import metrics, with_bar_cost
from .trades import project_to_windows, run_trades, with_day, with_series_order


def _finite(c: str) -> Column:
    return F.coalesce(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)), F.lit(0.0))


def _priced(bars: DataFrame, keys: list[str], params: dict | None = None) -> DataFrame:
    """Bars with ``bar_cost``; costs that are there already stay."""
    return bars if "bar_cost" in bars.columns else with_bar_cost(bars, keys, params)


def _scored(bars: DataFrame, keys: list[str], adaptive: bool, params: dict | None, per: list[str] | None = None) -> DataFrame:
    """Metrics of the run trades of each key, every key present; ``per`` are the keys rolling costs restart on."""
    if adaptive:
        bars = _priced(bars, per or keys, params)
    trades = run_trades(bars, keys, ["bar_cost"] if adaptive else [])
    if adaptive:
        trades = trades.withColumnRenamed("entry_bar_cost", "adaptive_cost_rt")
    m = metrics(trades, keys, params=params)
    return bars.select(*keys).distinct().join(m, keys, "left").na.fill(0.0).na.fill(0, ["trade_count"])


def _pass(cond: Column) -> Column:
    return F.when(cond, "PASS").otherwise("FAIL")


def signal_blocks(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of one signal value over the whole series: start position, length, value.

    A run ends at the next start of its day, else at the first start of a later day, else with the series; the later starts
    come from one row a day, so no window holds a series.
    """
    df = with_series_order(bars, keys)
    starts = df.filter(F.col("prev_signal").isNull() | (F.col("prev_signal") != F.col("signal"))).select(*keys, "date_utc", "pos", "series_rows", "signal")
    inside = Window.partitionBy(*keys, "date_utc").orderBy("pos")
    later = Window.partitionBy(*keys).orderBy(F.desc("date_utc")).rowsBetween(Window.unboundedPreceding, -1)
    days = starts.groupBy(*keys, "date_utc").agg(F.min("pos").alias("_first")).select(*keys, "date_utc", F.min("_first").over(later).alias("_then"))
    end = F.coalesce(F.lead("pos").over(inside), F.col("_then"), F.col("series_rows"))
    return starts.join(days, [*keys, "date_utc"]).select(*keys, F.col("pos").alias("start"), (end - F.col("pos")).alias("length"), F.col("signal").alias("value"))


def shuffled_signals(bars: DataFrame, keys: list[str], iterations: int, seed: int) -> DataFrame:
    """``iterations`` copies of the series with the order of the signal blocks permuted, as key ``iteration``.

    A block's new place is the length of the blocks ahead of it in hash order, from bucket totals and a sum inside its bucket.
    """
    blocks = stored(signal_blocks(bars, keys), "signal_blocks").withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    blocks = blocks.withColumn("_h", keyed_hash(seed, F.col("iteration"), F.col("start")))
    placed = running_offset(blocks, [*keys, "iteration"], "_h", ["start"], "length", "at")
    cells = placed.select(*keys, "iteration", F.explode(F.expr("sequence(at, at + length - 1)")).alias("pos"), F.col("value").alias("signal"))
    base = with_series_order(bars, keys).drop("signal", "prev_signal", "series_rows")
    return cells.join(base, [*keys, "pos"])


def shuffle_test(bars: DataFrame, keys: list[str], iterations: int = 100, adaptive: bool = True, params: dict | None = None) -> DataFrame:
    seed = int(resolve(params)["seed"])
    if adaptive:
        bars = _priced(bars, keys, params)
    real = _scored(bars, keys, adaptive, params).select(*keys, _finite("sharpe_ratio").alias("real_sharpe"))
    many = _scored(shuffled_signals(bars, keys, iterations, seed), [*keys, "iteration"], adaptive, params)
    many = many.select(*keys, _finite("sharpe_ratio").alias("s"))
    return many.join(real, keys).groupBy(*keys).agg(
        F.first("real_sharpe").alias("real_sharpe"), F.avg("s").alias("shuffle_mean"),
        F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("shuffle_std"),
        (F.count_if(F.col("s") <= F.col("real_sharpe")) / F.count(F.lit(1)) * 100.0).alias("percentile")).withColumn(
        "verdict", _pass(F.col("percentile") >= 95.0))


def with_fold(bars: DataFrame, keys: list[str], n_folds: int) -> DataFrame:
    """Fold of each bar: the series is cut into one history segment (0) and ``n_folds`` test segments."""
    df = with_series_order(bars, keys)
    n = n_folds + 1
    k = F.expr(f"(pos * {n}) div series_rows")
    nxt = F.expr(f"((((pos * {n}) div series_rows) + 1) * series_rows) div {n}")
    return df.withColumn("fold", F.when(nxt <= F.col("pos"), k + 1).otherwise(k)).drop("pos", "prev_signal", "series_rows")


def walk_forward_folds(bars: DataFrame, keys: list[str], n_folds: int = 5, adaptive: bool = True, params: dict | None = None) -> DataFrame:
    """Net PnL and Sharpe of each test fold, from trades of the whole history clipped to the fold."""
    df = with_fold(bars, keys, n_folds)
    first, last = F.struct("ts_event", "seq", "open"), F.struct("ts_event", "seq", "close")
    windows = df.filter("fold >= 1").groupBy(*keys, "fold").agg(F.min(first).alias("a"), F.max(last).alias("b")).select(
        *keys, "fold", F.col("a.ts_event").alias("win_start"), F.col("a.open").alias("win_open"),
        F.col("b.ts_event").alias("win_end"), F.col("b.close").alias("win_close"))
    trades = project_to_windows(run_trades(df, keys, ["fold"]), windows, keys)
    if adaptive:
        # Bars may share a time: the last one's cost is the one known then, so a trade never meets two rows.
        cost = with_bar_cost(df, [*keys, "fold"], params).groupBy(*keys, "fold", F.col("ts_event").alias("entry_time")).agg(
            F.max_by("bar_cost", "seq").alias("adaptive_cost_rt"))
        trades = trades.join(cost, [*keys, "fold", "entry_time"])
    m = metrics(trades, [*keys, "fold"], params=params)
    return windows.select(*keys, "fold").join(m, [*keys, "fold"], "left").select(
        *keys, "fold", F.coalesce("trade_count", F.lit(0)).alias("trade_count"), F.coalesce("net_pnl", F.lit(0.0)).alias("net_pnl"),
        _finite("sharpe_ratio").alias("sharpe_ratio"))


def walk_forward_test(bars: DataFrame, keys: list[str], n_folds: int = 5, adaptive: bool = True, params: dict | None = None) -> DataFrame:
    f = walk_forward_folds(bars, keys, n_folds, adaptive, params)
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("fold_count"), F.count_if(F.col("net_pnl") > 0).alias("profitable_folds")).withColumn(
        "verdict", _pass(F.col("profitable_folds") > F.col("fold_count") / 2))


def daily_volatility(bars: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "date_utc").orderBy("ts_event", "seq")
    df = with_day(bars).withColumn("_p", F.lag("close").over(w))
    return df.withColumn("_r", F.when(F.col("_p") != 0, F.col("close") / F.col("_p") - 1)).groupBy(*keys, "date_utc").agg(
        F.stddev_samp("_r").alias("daily_vol")).filter(F.col("daily_vol").isNotNull())


def regime_test(bars: DataFrame, keys: list[str], adaptive: bool = True, params: dict | None = None) -> DataFrame:
    """Trades split by the volatility of their entry day around its median; both sides must earn money."""
    if adaptive:
        bars = _priced(bars, keys, params)
    vol = daily_volatility(bars, keys)
    middle = vol.groupBy(*keys).agg(F.percentile("daily_vol", F.lit(0.5)).alias("_m"))
    days = vol.join(middle, keys).select(*keys, "date_utc", F.when(F.col("daily_vol") > F.col("_m"), "high").otherwise("low").alias("regime"))
    trades = run_trades(bars, keys, ["bar_cost"] if adaptive else [])
    if adaptive:
        trades = trades.withColumnRenamed("entry_bar_cost", "adaptive_cost_rt")
    t = trades.withColumn("date_utc", F.to_date("entry_time")).join(days, [*keys, "date_utc"]).drop("date_utc")
    m = metrics(t, [*keys, "regime"], params=params)

    def side(r: str, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("regime") == r, F.col(c))), F.lit(0.0)).alias(f"{r}_vol_{c.split('_')[0] if c != 'net_pnl' else 'pnl'}")

    sides = m.groupBy(*keys).agg(*[side(r, c) for r in ("high", "low") for c in ("sharpe_ratio", "net_pnl")])
    out = bars.select(*keys).distinct().join(sides, keys, "left").na.fill(0.0)
    return out.withColumn("verdict", _pass((F.col("high_vol_pnl") > 0) & (F.col("low_vol_pnl") > 0)))


def perturbed_signals(bars: DataFrame, keys: list[str], share: float, iterations: int, seed: int) -> DataFrame:
    """Copies of the series with a share of the non-zero signal bars flipped, as key ``iteration``.

    The bars to flip have the smallest hashes of their series and iteration; the largest of these is found by bucket totals and ranks
    inside one bucket, and each bar is then compared with it alone.
    """
    ties, repeated = ["ts_event", "seq"], F.explode(F.sequence(F.lit(1), F.lit(iterations)))
    digest = keyed_hash(seed, F.col("iteration"), F.unix_micros("ts_event"), F.col("seq"))
    live = bars.filter("signal <> 0").select(*keys, *ties, repeated.alias("iteration")).withColumn("_h", digest)
    flips = F.least(F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(float(share)))), F.col("size"))
    last = stored(nth_smallest(live, [*keys, "iteration"], "_h", ties, flips), "flip_limits")  # one row a series and iteration
    df = with_day(bars).withColumn("iteration", repeated).join(last, [*keys, "iteration"], "left")
    flip = (F.col("signal") != 0) & (F.struct(digest.alias("_h"), *ties) <= F.col("last"))
    return df.withColumn("signal", F.when(flip, -F.col("signal")).otherwise(F.col("signal"))).drop("last")


def perturbation_test(bars: DataFrame, keys: list[str], share: float = 0.1, iterations: int = 20, adaptive: bool = True,
                      params: dict | None = None) -> DataFrame:
    seed = int(resolve(params)["seed"])
    if adaptive:
        bars = _priced(bars, keys, params)
    base = _scored(bars, keys, adaptive, params).select(*keys, _finite("sharpe_ratio").alias("baseline_sharpe"))
    many = _scored(perturbed_signals(bars, keys, share, iterations, seed), [*keys, "iteration"], adaptive, params)
    agg = many.select(*keys, _finite("sharpe_ratio").alias("s")).groupBy(*keys).agg(
        F.avg("s").alias("perturbed_mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("perturbed_std"))
    return base.join(agg, keys).withColumns({
        "degradation_pct": F.expr("if(baseline_sharpe <> 0, (baseline_sharpe - perturbed_mean) / abs(baseline_sharpe) * 100D, 0D)"),
        "verdict": _pass(F.expr("baseline_sharpe > 0 and perturbed_mean >= 0.5D * baseline_sharpe"))})


def cost_sensitivity_test(bars: DataFrame, keys: list[str], adaptive: bool = True, params: dict | None = None) -> DataFrame:
    m = _scored(bars, keys, adaptive, params)
    return m.select(*keys, F.col("net_pnl").alias("pnl_1x"), F.expr("gross_pnl - total_costs * 1.5D").alias("pnl_1_5x"),
                    F.expr("gross_pnl - total_costs * 2D").alias("pnl_2x"), F.col("sharpe_ratio").alias("sharpe_1x")).withColumn(
        "verdict", _pass(F.col("pnl_1_5x") > 0))


def decay_test(bars: DataFrame, keys: list[str], n_chunks: int = 4, adaptive: bool = True, params: dict | None = None) -> DataFrame:
    """Sharpe trend over sequential chunks, each traded on its own; the last chunk must earn money."""
    df = with_series_order(bars, keys).withColumn("chunk", F.expr(
        f"least(pos div greatest(series_rows div {n_chunks}, 1), {n_chunks - 1})")).drop("pos", "prev_signal", "series_rows")
    m = _scored(df, [*keys, "chunk"], adaptive, params).withColumn("s", _finite("sharpe_ratio"))
    mid = max(1, n_chunks // 2)
    agg = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.covar_pop("chunk", "s").alias("_c"), F.var_pop("chunk").alias("_vx"), F.var_pop("s").alias("_vy"),
        F.avg(F.when(F.col("chunk") < mid, F.col("s"))).alias("early"), F.avg(F.when(F.col("chunk") >= mid, F.col("s"))).alias("late"),
        F.max_by("net_pnl", "chunk").alias("last_pnl"))
    return agg.withColumns({
        "trend_slope": F.expr("if(_vx > 0, _c / _vx, 0D)"),
        "trend_r_squared": F.expr("if(_vx > 0 and _vy > 0, _c * _c / (_vx * _vy), 0D)")}).withColumn(
        "is_declining", F.expr("trend_slope < 0 and trend_r_squared >= 0.5 and coalesce(late, early) <= early * 0.9")).withColumn(
        "verdict", _pass(~F.col("is_declining") & (F.col("last_pnl") > 0))).select(
        *keys, "chunk_count", "trend_slope", "trend_r_squared", "is_declining", "last_pnl", "verdict")


def trade_count_test(bars: DataFrame, keys: list[str], min_trades: int = 50) -> DataFrame:
    n = run_trades(bars, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("trade_count"))
    return bars.select(*keys).distinct().join(n, keys, "left").na.fill(0, ["trade_count"]).withColumn(
        "verdict", _pass(F.col("trade_count") >= int(min_trades)))


def gauntlet(bars: DataFrame, keys: list[str], min_trades: int = 50, iterations: int = 100, adaptive: bool = True,
             params: dict | None = None) -> DataFrame:
    """Verdict of each check and the overall verdict, one row per key.

    Ordered bars with their costs are staged once; folds and chunks restart costs and take the bars alone.
    """
    own = [*keys, "date_utc", "ts_event", "seq", "open", "high", "low", "close", "volume", "bid_price", "ask_price", "signal"]
    day = with_day(bars)
    bars = stored(day.select(*[c for c in own if c in day.columns]), "series")
    priced = stored(_priced(bars, keys, params), "priced") if adaptive else bars
    checks = {
        "shuffle": shuffle_test(priced, keys, iterations, adaptive, params), "walk_forward": walk_forward_test(bars, keys, 5, adaptive, params),
        "regime": regime_test(priced, keys, adaptive, params), "signal_perturbation": perturbation_test(priced, keys, adaptive=adaptive, params=params),
        "cost_sensitivity": cost_sensitivity_test(priced, keys, adaptive, params), "decay": decay_test(bars, keys, 4, adaptive, params),
        "trade_count": trade_count_test(bars, keys, min_trades)}
    checks = {n: stored(df.select(*keys, "verdict"), "check") for n, df in checks.items()}  # one small plan and table a check
    rows = None
    for name, df in checks.items():
        one = df.select(*keys, F.lit(name).alias("check"), "verdict")
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("check") == n, F.col("verdict"))).alias(n) for n in checks],
                                   F.count_if(F.col("verdict") == "PASS").alias("pass_count"))
    return wide.withColumn("overall_verdict", _pass(F.col("pass_count") == len(checks)))
