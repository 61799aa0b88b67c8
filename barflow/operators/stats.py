"""Statistical validation: deflated Sharpe, overfitting, decay, factors, drift and adversarial checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import keyed_hash, nth_smallest
from ..params import resolve
from ..sources.stage import stored
from .gauntlet import daily_volatility
from .trades import with_day

EULER_GAMMA = 0.5772156649015329


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """Standard normal distribution function; applied to aggregated rows only."""
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)) if pd.notna(v) else None)


@F.pandas_udf(T.DoubleType())
def expected_max_normal(n: pd.Series) -> pd.Series:
    """Expected maximum of ``n`` standard normal draws (extreme-value mix of two quantiles)."""
    q = NormalDist().inv_cdf
    return n.map(lambda t: 0.0 if t <= 1 else (1 - EULER_GAMMA) * q(1 - 1 / t) + EULER_GAMMA * q(1 - 1 / (t * math.e)))


def deflated_sharpe(returns: DataFrame, keys: list[str], value: str, n_trials) -> DataFrame:
    """Deflated Sharpe ratio per key; ``n_trials`` is a number or the name of a column constant per key.

    With fewer than three finite returns, or returns that do not vary, it is not ``available``: Sharpe and ``dsr`` are 0 and the
    other figures null.
    """
    x = F.col(value)
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    trials = F.first(F.col(n_trials)) if isinstance(n_trials, str) else F.lit(int(n_trials))
    m = returns.groupBy(*keys).agg(
        F.count(x).alias("sample_count"), F.greatest(trials, F.lit(1)).cast("double").alias("n_trials"), F.avg(x).alias("mean_return"),
        F.stddev_samp(x).alias("std_return"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    m = m.withColumn("available", F.coalesce(F.expr("sample_count >= 3 and std_return > 1e-12"), F.lit(False)))
    # Spark's moments use the population deviation; standardising by the sample one rescales them.
    m = m.withColumns({
        "_r": F.expr("(sample_count - 1) / greatest(sample_count, 1)"),
        "sharpe": F.expr("if(available, mean_return / std_return, 0D)")}).withColumns({
        "skew": F.expr("if(available, _g1 * pow(_r, 1.5), null)"), "kurtosis": F.expr("if(available, (_g2 + 3) * _r * _r, null)")})
    m = m.withColumn("sharpe_std_error", F.expr(
        "if(available, sqrt(greatest(1 - skew * sharpe + (kurtosis - 3) / 4 * sharpe * sharpe, 1e-9D) / greatest(sample_count - 1, 1)), null)"))
    m = m.withColumn("expected_max_sharpe_null", F.col("sharpe_std_error") * expected_max_normal("n_trials"))
    m = m.withColumn("z_score", F.expr("if(available, (sharpe - expected_max_sharpe_null) / greatest(sharpe_std_error, 1e-9D), null)"))
    return m.withColumn("dsr", F.coalesce(F.when(F.col("available"), normal_cdf("z_score")), F.lit(0.0))).drop("_g1", "_g2", "_r")


def overfit_splits(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Leave-one-split-out: the best in-sample candidate of each split and its out-of-sample rank share."""
    keys = list(keys)
    whole = Window.partitionBy(*keys, "candidate")
    s = scores.withColumns({"_n": F.count("score").over(whole), "_t": F.sum("score").over(whole)})
    own = F.coalesce(F.col("score"), F.lit(0.0))
    left = F.col("_n") - F.when(F.col("score").isNotNull(), 1).otherwise(0)
    s = s.withColumn("in_sample", F.when(left > 0, (F.col("_t") - own) / F.nullif(left, F.lit(0))))
    rank = Window.partitionBy(*keys, "split").orderBy(F.col("score").asc_nulls_first(), "candidate")
    s = s.withColumn("oos_rank", F.row_number().over(rank))
    g = s.groupBy(*keys, "split").agg(
        F.max(F.struct("in_sample", F.col("candidate").alias("c"), "oos_rank")).alias("b"),
        F.max("in_sample").alias("m"), F.count(F.lit(1)).alias("candidate_count"), F.count("score").alias("_live"))
    first = s.join(g.select(*keys, "split", "m"), [*keys, "split"]).filter("in_sample = m").groupBy(*keys, "split").agg(
        F.min(F.struct("candidate", "oos_rank")).alias("best"))
    g = g.join(first, [*keys, "split"]).filter("_live > 0")
    pct = F.least(F.greatest(F.col("best.oos_rank") / F.col("candidate_count"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return g.select(*keys, "split", F.col("best.candidate").alias("candidate"), "candidate_count", pct.alias("oos_percentile")).withColumn(
        "logit", F.expr("ln(oos_percentile / (1 - oos_percentile))"))


def overfit_probability(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of splits whose best candidate falls below the middle out of sample; every key has a row.

    With fewer than two candidates or three usable splits it is not available and counts as 1.
    """
    keys, s = list(keys), overfit_splits(scores, keys)
    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("effective_split_count"), F.max("candidate_count").alias("candidate_count"),
        F.count_if(F.col("oos_percentile") < 0.5).alias("under_median_count"), F.avg("logit").alias("lambda_mean"),
        F.stddev_pop("logit").alias("lambda_std"))
    every = scores.groupBy(*keys).agg(F.countDistinct("candidate").alias("_c"))
    g = every.join(g, keys, "left") if keys else every.join(g, F.lit(True), "left")
    g = g.withColumns({"candidate_count": F.coalesce("candidate_count", "_c"), "effective_split_count": F.coalesce("effective_split_count", F.lit(0)),
                       "under_median_count": F.coalesce("under_median_count", F.lit(0))}).drop("_c")
    g = g.withColumn("available", F.expr("candidate_count >= 2 and effective_split_count >= 3"))
    return g.withColumn("pbo", F.expr("if(available, under_median_count / effective_split_count, 1D)"))


def rolling_sharpe(pnl: DataFrame, keys: list[str], window_days: int = 60, step_days: int = 10) -> DataFrame:
    """Sharpe of trading days in calendar windows; each day is sent to the windows that contain it."""
    days = pnl.groupBy(*keys, F.to_date("exit_time").alias("date")).agg(F.sum("net_pnl").alias("x"))
    whole = Window.partitionBy(*keys)
    d = days.withColumns({"_a": F.min("date").over(whole), "_b": F.max("date").over(whole)})
    d = d.withColumns({"_o": F.datediff("date", "_a"), "_span": F.datediff("_b", "_a") + 1})
    lo = F.expr(f"greatest(ceil((_o - {window_days} + 1) / {step_days}), 0)").cast("int")
    hi = F.expr(f"least(floor(_o / {step_days}), floor((_span - {window_days}) / {step_days}))").cast("int")
    d = d.withColumns({"_lo": lo, "_hi": hi}).filter(f"_span >= {window_days} and _lo <= _hi")
    return d.withColumn("k", F.explode(F.sequence("_lo", "_hi"))).groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).filter("n >= 2").select(
        *keys, (F.col("k") * step_days + window_days / 2.0).alias("midpoint"),
        F.expr(f"if(sd > 0, m / sd * {math.sqrt(252.0)!r}D, 0D)").alias("sharpe"))


def alpha_decay(rolling: DataFrame, keys: list[str], min_windows: int = 5, params: dict | None = None) -> DataFrame:
    """Exponential decay fit on the positive windows and a verdict from the last third."""
    stable = float(resolve(params)["stable_half_life"])
    up = Window.partitionBy(*keys).orderBy("midpoint")
    r = rolling.withColumns({"_i": F.row_number().over(up), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    r = r.withColumns({"_tail": F.expr("_i > _n - greatest(_n div 3, 1)"), "_pos": F.col("sharpe") > 0})
    t, y = F.when(F.col("_pos"), F.col("midpoint")), F.when(F.col("_pos"), F.log(F.when(F.col("_pos"), F.col("sharpe"))))
    g = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_count"), F.count_if("_pos").alias("_np"), F.covar_pop(t, y).alias("_c"), F.var_pop(t).alias("_vt"),
        F.var_pop(y).alias("_vy"), F.avg(t).alias("_mt"), F.avg(y).alias("_my"),
        F.percentile(F.when(F.col("_tail"), F.col("sharpe")), F.lit(0.5)).alias("terminal_sharpe"),
        F.avg(F.when(F.col("_tail"), F.when(F.col("sharpe") <= 0, 1.0).otherwise(0.0))).alias("tail_nonpositive_fraction"))
    g = g.withColumns({
        "available": F.expr(f"window_count >= {min_windows} and (_np = 0 or _np >= {min_windows})"),
        "_slope": F.expr("if(_vt > 0, _c / _vt, 0D)"), "_dead": F.expr("_np = 0")})
    g = g.withColumns({
        "decay_rate": F.expr("if(available and not _dead, -_slope, null)"),
        "initial_sharpe": F.expr("if(available, if(_dead, 0D, exp(_my - _slope * _mt)), null)"),
        "r_squared": F.expr("if(available, if(_vt > 0 and _vy > 0, _c * _c / (_vt * _vy), 0D), null)"),
        "half_life_days": F.expr("case when not available then null when _dead then 0D when _slope < 0 then ln(2) / -_slope end")})
    return g.withColumn("verdict", F.expr(f"""case when not available then 'INSUFFICIENT_DATA'
        when _dead or tail_nonpositive_fraction = 1 then 'DEAD' when terminal_sharpe <= 0 or tail_nonpositive_fraction >= 0.5 then 'DECAYING'
        when half_life_days is null or half_life_days > {stable} then 'STABLE' when r_squared > 0.3 then 'DECAYING' else 'NOISY' end""")).drop(
        "_np", "_c", "_vt", "_vy", "_mt", "_my", "_slope", "_dead")


def factor_returns(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Daily market return, change of realised volatility and lagged return."""
    df = with_day(bars)
    days = df.groupBy(*keys, "date_utc").agg(F.max_by("close", F.struct("ts_event", "seq")).alias("_c")).join(
        daily_volatility(df, keys), [*keys, "date_utc"], "left")
    w = Window.partitionBy(*keys).orderBy("date_utc")
    prev = F.lag("_c").over(w)
    days = days.withColumns({"market_return": F.when(prev != 0, F.col("_c") / prev - 1), "volatility_change": F.col("daily_vol") - F.lag("daily_vol").over(w)})
    return days.withColumn("momentum", F.lag("market_return").over(w)).select(
        *keys, F.col("date_utc").alias("date"), "market_return", "volatility_change", "momentum")


_FACTORS = ["market_return", "volatility_change", "momentum"]


def factor_attribution(pnl: DataFrame, bars: DataFrame, keys: list[str], min_days: int | None = None, params: dict | None = None) -> DataFrame:
    """OLS of daily PnL on the factors that vary, one row per key of ``pnl``.

    One aggregation per key yields the covariance matrix; only that row reaches Python, where the 4x4 system is solved for a
    batch of keys.  A second pass joins the coefficients back to the days for the residuals' Sharpe.  Factors that depend on
    each other leave the design rank short: coefficients are then those of least norm, nothing is significant and the verdict is
    INCONCLUSIVE.
    """
    p = resolve(params)
    need = int(p["factor_min_days"] if min_days is None else min_days)
    r2_bar, level = float(p["factor_r2"]), math.erfc(float(p["factor_t"]) / math.sqrt(2.0))
    days = pnl.groupBy(*keys, F.to_date("exit_time").alias("date")).agg(F.sum("net_pnl").alias("y"))
    j = stored(days.join(factor_returns(bars, keys), [*keys, "date"]).dropna(), "factor_days")
    cols = ["y", *_FACTORS]
    sums = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.array(*[F.avg(c) for c in cols]).alias("mean"), F.array(
        *[F.covar_pop(a, b) for a in cols for b in cols]).alias("cov"))
    sums = pnl.select(*keys).distinct().join(sums, keys, "left").withColumn("n_days", F.coalesce("n_days", F.lit(0)))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema.fields)
    names = ["alpha_daily", "alpha_t_stat", "alpha_pvalue", "alpha_pvalue_adjusted", *[f"{n}_{f}" for n in ("beta", "t", "p", "p_adj") for f in _FACTORS], "r_squared"]
    more = ["active_factors", "design_rank", "regression_stable"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, mean, cov in zip(pdf["n_days"], pdf["mean"], pdf["cov"]):
                if n < max(need, 1):
                    rows.append([False, *[None] * (len(names) + len(more)), "INSUFFICIENT_DATA"])
                    continue
                rows.append([True, *_least_squares(int(n), np.asarray(mean, dtype=float), np.asarray(cov, dtype=float).reshape(4, 4), r2_bar, level)])
            got = pd.DataFrame(rows, columns=["available", *names, *more, "verdict"], dtype=object)
            yield pd.concat([pdf[[*keys, "n_days"]].reset_index(drop=True), got], axis=1)

    schema = f"{out}, n_days bigint, available boolean, " + ", ".join(f"{n} double" for n in names) + ", active_factors string, design_rank int, regression_stable boolean, verdict string"
    fit = stored(sums.mapInPandas(solve, schema), "factor_fits")
    short = fit.filter("available").select(*keys, "alpha_daily", *[f"beta_{f}" for f in _FACTORS])
    left = F.col("y") - F.col("alpha_daily") - sum(F.col(f"beta_{f}") * F.col(f) for f in _FACTORS)
    rest = j.join(short, keys).groupBy(*keys).agg(F.avg(left).alias("_m"), F.stddev_samp(left).alias("_s"))
    sharpe = F.expr(f"if(available, if(_s > 1e-12, _m / _s * {math.sqrt(252.0)!r}D, 0D), null)")
    return fit.join(rest, keys, "left").withColumns({"residual_sharpe": sharpe, "alpha_annualized": F.col("alpha_daily") * 252.0}).drop("_m", "_s")


def _least_squares(n: int, mu: np.ndarray, c: np.ndarray, r2_bar: float, level: float) -> list:
    """Coefficients, tests and verdict from the means and covariances of (y, factors) over ``n`` days."""
    sd = np.sqrt(np.maximum(np.diag(c)[1:], 0))
    live = np.flatnonzero(np.isfinite(sd) & (sd > 1e-12)) + 1
    k = len(live)
    sxx, sxy, m = c[np.ix_(live, live)], c[live, 0], mu[live]
    scaled = sxx / np.outer(sd[live - 1], sd[live - 1])
    rank = 1 + (int((np.linalg.eigvalsh(scaled) > 1e-12 * k).sum()) if k else 0)
    stable = rank == k + 1 and n > k
    if stable:
        inv = np.linalg.inv(scaled) / np.outer(sd[live - 1], sd[live - 1]) if k else np.zeros((0, 0))
        beta = inv @ sxy
        coef = np.r_[mu[0] - beta @ m, beta]
    else:  # least norm over intercept and slopes
        gram = np.block([[np.ones((1, 1)), m[None, :]], [m[:, None], sxx + np.outer(m, m)]])
        coef = np.linalg.pinv(gram, rcond=1e-13, hermitian=True) @ np.r_[mu[0], sxy + m * mu[0]]
        beta = coef[1:]
    gap = mu[0] - coef[0] - beta @ m
    res = max(c[0, 0] - 2 * beta @ sxy + beta @ sxx @ beta + gap * gap, 0.0) * n
    full_b, full_t, pv = np.zeros(4), np.zeros(4), np.ones(4)
    at = np.r_[0, live]
    full_b[at] = coef
    if stable:
        sigma2 = res / max(n - k - 1, 1)
        se = np.sqrt(np.maximum(np.r_[sigma2 / n * (1 + m @ inv @ m), sigma2 / n * np.diag(inv)], 0))
        full_t[at] = np.where(se > 1e-12, coef / np.where(se > 0, se, 1), 0.0)
        pv[at] = [math.erfc(abs(v) / math.sqrt(2.0)) for v in full_t[at]]
    order = np.argsort(pv, kind="stable")
    adj = np.empty(4)
    adj[order] = np.minimum(np.maximum.accumulate(pv[order] * (4 - np.arange(4))), 1.0)
    r2 = 1 - res / (c[0, 0] * n) if c[0, 0] > 0 else 0.0
    a_ok, f_ok = adj[0] <= level, bool((adj[1:] <= level).any())
    verdict = ("INCONCLUSIVE" if not stable else "PURE_ALPHA" if r2 < r2_bar and a_ok else "ALPHA_WITH_BETA_EXPOSURE" if r2 >= r2_bar and a_ok and f_ok
               else "FACTOR_EXPOSED" if r2 >= r2_bar and f_ok else "INCONCLUSIVE")
    return [full_b[0], full_t[0], pv[0], adj[0], *full_b[1:], *full_t[1:], *pv[1:], *adj[1:], r2, ",".join(_FACTORS[i - 1] for i in live), rank, stable, verdict]


def drift(train: DataFrame, holdout: DataFrame, features: list[str]) -> DataFrame:
    """Standardised mean difference of each feature between two sets; one pass over each."""
    def moments(df: DataFrame, side: str) -> DataFrame:
        fin = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
        row = df.agg(*[f(fin[c]).alias(f"{n}{c}") for c in features for n, f in (("m_", F.avg), ("v_", F.var_pop))])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias(f"{side}_mean"),
                                                      F.col(f"v_{c}").alias(f"{side}_var")) for c in features])).alias("s")).select("s.*")
    j = moments(train, "train").join(moments(holdout, "holdout"), "feature")
    return j.withColumn("std_mean_diff", F.expr("(holdout_mean - train_mean) / sqrt(greatest((train_var + holdout_var) / 2, 1e-9D))"))


def drift_ranking(drifts: DataFrame, importance: DataFrame, top_k: int = 20) -> DataFrame:
    """Features by the sum of their importance rank and drift rank, largest first; one row per feature."""
    one = Window.partitionBy(F.lit(0))
    j = drifts.join(importance, "feature").withColumn("_d", F.abs("std_mean_diff"))
    j = j.withColumn("combined_rank_score", (F.row_number().over(one.orderBy("importance", "feature"))
                                             + F.row_number().over(one.orderBy("_d", "feature"))).cast("double"))
    return j.drop("_d").orderBy(F.col("combined_rank_score").desc(), "feature").limit(int(top_k))


def exact_auc(scored: DataFrame, score: str, label: str, keys: list[str] = (), buckets: int = 1024) -> DataFrame:
    """(keys, positives, negatives, auc): area under the ROC curve by rank sums, ties counting half, per key.

    Rows are counted by distinct score; scores are cut into ordered buckets, so the negatives below a score are a bucket
    prefix plus a sum inside one bucket.  Without rows of both classes the area is null.
    """
    keys = list(keys)
    d = scored.select(*keys, F.col(score).cast("double").alias("_v"), F.col(label).cast("int").alias("_y")).filter("_v is not null and not isnan(_v) and _y is not null")
    counts = d.groupBy(*keys, "_v").agg(F.count_if(F.col("_y") == 1).alias("_p"), F.count_if(F.col("_y") != 1).alias("_q"))
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"))
    counts = counts.join(span, keys) if keys else counts.withColumn("_k", F.lit(1)).join(F.broadcast(span.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row
    counts = counts.withColumn("_b", F.expr(f"if(_hi > _lo, least(floor((_v - _lo) / (_hi - _lo) * {buckets}), {buckets - 1}), 0)"))
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_q").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    r = counts.join(totals, [*keys, "_b"]).withColumn("_below", F.col("_before") + F.coalesce(F.sum("_q").over(inside), F.lit(0)))
    wins = F.sum((F.col("_p") * (2 * F.col("_below") + F.col("_q"))).cast("decimal(38,0)"))
    g = r.groupBy(*keys).agg(F.first("positives").alias("positives"), F.first("negatives").alias("negatives"), wins.alias("_w"))
    return g.withColumn("auc", F.expr("if(positives > 0 and negatives > 0, cast(_w as double) / (2D * positives * negatives), null)")).drop("_w")


def class_split(rows: DataFrame, label: str, columns: list[str], share: float = 0.7, seed: int = 42) -> DataFrame:
    """``rows`` with ``fit``: true for exactly the share (rounded down, one row at least) of each class, in the order of keyed hashes of ``columns``.

    The share is taken as the decimal it is written as: as a double, 0.7 of 1460 rows would be just under 1022.
    """
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "split_rows")
    digest = keyed_hash(seed, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    d = numbered.withColumn("_h", digest)
    last = stored(nth_smallest(d, [label], "_h", ["_row"], F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(Decimal(repr(float(share))))))), "split_limits")  # one row a class
    return d.join(last, label).withColumn("fit", F.struct("_h", "_row") <= F.col("last")).drop("_row", "_h", "last")


MIN_SIDE_ROWS, MIN_VALIDATION_ROWS, MIN_FEATURES = 200, 50, 3


def adversarial_validation(train: DataFrame, holdout: DataFrame, features: list[str], seed: int = 42, trees: int = 300,
                           depth: int = 6, top_k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Random forest that tries to tell the sets apart: (one-row report, features ranked by importance and drift).

    The report's ``used`` is false, with a ``reason`` and an AUC of 0.5, for fewer than ``MIN_FEATURES`` common features, ``MIN_SIDE_ROWS`` rows a
    side or ``MIN_VALIDATION_ROWS`` rows to validate on.  Exactly 70 % of each class are fitted on.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    spark = train.sparkSession
    common = [c for c in features if c in train.columns and c in holdout.columns]
    none = spark.createDataFrame([], "feature string, importance double, std_mean_diff double, combined_rank_score double, train_mean double, holdout_mean double")

    def report(used: bool, reason: str | None, rows: tuple = (None, None, None), auc: float = 0.5) -> DataFrame:
        return spark.createDataFrame([(used, reason, len(common), *rows, float(auc))],
                                     "used boolean, reason string, feature_count int, train_rows bigint, holdout_rows bigint, validation_rows bigint, auc double")
    if len(common) < MIN_FEATURES:
        return report(False, "insufficient_common_features"), none
    finite = [F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(c) for c, x in ((c, F.col(c).cast("double")) for c in common)]
    both = train.select(*finite, F.lit(0.0).alias("label")).unionByName(holdout.select(*finite, F.lit(1.0).alias("label")))
    both = stored(class_split(both, "label", common, 0.7, seed), "adversarial_rows")
    size = {(r.label, r.fit): r["count"] for r in both.groupBy("label", "fit").count().collect()}  # four rows
    sides = tuple(sum(n for (y, _), n in size.items() if y == k) for k in (0.0, 1.0))
    held = sum(n for (_, fit), n in size.items() if not fit)
    if min(sides) < MIN_SIDE_ROWS:
        return report(False, "insufficient_rows", (*sides, None)), none
    if held < MIN_VALIDATION_ROWS:
        return report(False, "insufficient_validation_rows", (*sides, held)), none
    p = size[1.0, True] / (size[0.0, True] + size[1.0, True])
    fit = both.filter("fit").withColumn("w", F.when(F.col("label") == 1, 0.5 / p).otherwise(0.5 / (1 - p)))
    filled = [f"{c}__f" for c in common]
    stages = [Imputer(strategy="median", inputCols=common, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"),
              StandardScaler(withMean=True, inputCol="raw", outputCol="features"),
              RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=20, seed=seed + 91, weightCol="w")]
    model = Pipeline(stages=stages).fit(fit)
    scored = model.transform(both.filter("not fit")).select("label", vector_to_array("probability")[1].alias("score"))
    auc = exact_auc(scored, "score", "label").first().auc
    weights = model.stages[-1].featureImportances.toArray()
    importance = spark.createDataFrame([(c, float(v)) for c, v in zip(common, weights)], "feature string, importance double")
    ranking = drift_ranking(drift(train, holdout, common), importance, top_k)
    return report(True, None, (*sides, held), auc), ranking.select(*none.columns)


def advanced_gates(results: DataFrame, min_dsr: float | None = None, decay_verdicts: list[str] | None = None,
                   factor_verdicts: list[str] | None = None) -> DataFrame:
    """Which configured checks pass, given columns ``dsr`` with ``dsr_available``, ``decay_verdict`` and ``factor_verdict``.

    A deflated Sharpe ratio that is not available counts as 0 and fails its gate, whatever the bound.
    """
    checks = {}
    if min_dsr is not None:
        there = F.coalesce(F.col("dsr_available"), F.lit(False))
        results = results.withColumn("dsr", F.when(there, F.coalesce("dsr", F.lit(0.0))).otherwise(0.0))
        checks["dsr_passed"] = there & (F.col("dsr") >= float(min_dsr))
    for name, allowed in (("decay", decay_verdicts), ("factor", factor_verdicts)):
        if allowed is not None:
            names = [a.strip() for a in allowed if a.strip()]
            checks[f"{name}_passed"] = F.coalesce(F.trim(F.col(f"{name}_verdict")).isin(*names), F.lit(False)) if names else F.lit(False)
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & c
    return results.withColumns({**checks, "enabled": F.lit(bool(checks)), "passed": passed})
