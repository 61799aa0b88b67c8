"""User strategies: column functions, Python functions per day, fitted models, their causality check and their staged evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import BAR_ORDER, with_ewm
from ..operators import edge
from ..operators.edge import FAMILIES
from ..operators.gauntlet import gauntlet
from ..operators.pnl import daily_pnl, metrics, trade_pnl, with_bar_cost
from ..operators.stats import advanced_gates, alpha_decay, deflated_sharpe, factor_attribution, rolling_sharpe
from ..operators.trades import run_trades, sign_signal, signal_from_conditions, with_day, with_series_order
from ..sources.stage import stored


def column_strategy(df: DataFrame, fn: Callable[[DataFrame, dict], DataFrame], params: dict | None = None) -> DataFrame:
    """Run ``fn(df, params)``; its ``signal`` column is normalised to -1, 0, 1."""
    out = fn(df, params or {})
    if "signal" not in out.columns:
        raise ValueError("the strategy did not add a signal column")
    return out.withColumn("signal", sign_signal(F.col("signal")))


def _signals(raw, rows: int) -> np.ndarray:
    out = np.asarray(raw, dtype=float)
    if out.shape != (rows,):
        raise ValueError(f"signal has shape {out.shape}, expected ({rows},)")
    return np.sign(np.where(np.isfinite(out), out, 0.0)).astype("int8")


def python_strategy(df: DataFrame, fn: Callable, params: dict | None = None, keys: tuple[str, ...] = ("symbol", "session_date"), states: DataFrame | None = None,
                    on: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Run a Python function on each (symbol, day) frame; Spark partitions the days, one Arrow batch each.

    With ``states`` (see :func:`fit_states`) each day meets the model state of its ``on`` columns and ``fn(frame, params, state)`` is called; a day
    without a state gets None.
    """
    params, schema = params or {}, T.StructType([f for f in df.schema.fields if f.name not in ("signal", "state")] + [T.StructField("signal", T.ByteType())])
    names = [f.name for f in schema.fields]
    with_state = states is not None

    def one_day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(BAR_ORDER)).reset_index(drop=True)
        if not with_state:
            return pdf.assign(signal=_signals(fn(pdf, params), len(pdf)))[names]
        packed = pdf["state"].iloc[0]
        pdf = pdf.drop(columns="state")
        return pdf.assign(signal=_signals(fn(pdf, params, None if packed is None else json.loads(packed)), len(pdf)))[names]

    if with_state:
        return df.join(states.select(*on, "state"), list(on), "left").groupBy(*keys).applyInPandas(one_day, schema)
    return df.groupBy(*keys).applyInPandas(one_day, schema)


def fold_rows(df: DataFrame, folds: DataFrame, role: str, day: str = "session_date") -> DataFrame:
    """The rows of each fold's ``role`` days, with ``fold``."""
    return df.join(folds.filter(F.col("role") == role).select("fold", F.col("date").alias(day)), day)


def fit_states(df: DataFrame, folds: DataFrame, summarise: Callable[[pd.DataFrame, dict], dict], combine: Callable[[list[dict], dict], dict], params: dict | None = None,
               keys: tuple[str, ...] = ("symbol",), day: str = "session_date") -> DataFrame:
    """(keys, fold, state): the model state of each fold, fitted once on its training days; states are JSON.

    ``summarise(frame, params)`` turns one day of one key into a small record, and ``combine(records, params)`` the records of a fold's days, in
    the order of days, into the state.  So no task holds a fold's bars: it holds one day, or one record a day.
    """
    params, keys = params or {}, list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    lead = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def one_day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(BAR_ORDER)).reset_index(drop=True)
        return pdf.iloc[:1][[*keys, day]].assign(record=json.dumps(summarise(pdf, params)))

    def one_fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        return pdf.iloc[:1][[*keys, "fold"]].assign(state=json.dumps(combine([json.loads(r) for r in pdf["record"]], params)))
    trained = df.join(folds.filter("role = 'train'").select(F.col("date").alias(day)).distinct(), day, "left_semi")
    records = stored(trained.groupBy(*keys, day).applyInPandas(one_day, f"{lead}, `{day}` {kinds[day]}, record string"), "day_records")  # a day once, however many folds it trains
    return fold_rows(records, folds, "train", day).groupBy(*keys, "fold").applyInPandas(one_fold, f"{lead}, fold {folds.schema['fold'].dataType.simpleString()}, state string")


def fitted_strategy(df: DataFrame, folds: DataFrame, n_folds: int, estimator, day: str = "session_date", threshold: float = 0.5) -> DataFrame:
    """Fit a Spark ML estimator on each fold's training days and signal its test days.

    ``estimator`` yields a ``probability`` vector for class 1; there is one model per fold, not per row group.
    """
    from pyspark.ml.functions import vector_to_array
    out = None
    for k in range(1, int(n_folds) + 1):
        days = folds.filter(F.col("fold") == k).select("role", F.col("date").alias(day))
        part = df.join(days, day)
        model = estimator.fit(part.filter("role = 'train'"))
        scored = model.transform(part.filter("role = 'test'"))
        p = vector_to_array("probability")[1]
        one = scored.select(*df.columns, F.lit(k).alias("fold"), signal_from_conditions(p > threshold, p < 1 - threshold).alias("signal"))
        out = one if out is None else out.unionByName(one)
    return out


#: Gaps of close and EMA that are rounding noise.
FLAT = 1e-12


def ema_turn(df: DataFrame, params: dict | None = None, keys: tuple[str, ...] = ("symbol", "session_date")) -> DataFrame:
    """Example: long when the close crosses above its EMA, short when it crosses below.

    The gap of close and EMA is summed up from the changes of the close, so it is zero, not rounding noise, while the close
    stands still; gaps of at most ``FLAT`` count as zero, where changes cancel each other.
    """
    span = int((params or {}).get("span", 8))
    alpha = 2.0 / (span + 1)
    w = Window.partitionBy(*keys).orderBy(*BAR_ORDER)
    out = df.withColumn("_move", F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0)))
    out = with_ewm(out, {"_ema": ("_move", alpha, 1)}, list(keys), list(BAR_ORDER))
    gap = F.col("_ema") * ((1 - alpha) / alpha)
    out = out.withColumn("_gap", F.when(F.abs(gap) > FLAT, gap).otherwise(0.0))
    before = F.coalesce(F.lag("_gap").over(w), F.lit(0.0))
    out = out.withColumn("_before", before)
    return out.withColumn("signal", signal_from_conditions((F.col("_before") <= 0) & (F.col("_gap") > 0),
                                                           (F.col("_before") >= 0) & (F.col("_gap") < 0))).drop("_move", "_ema", "_gap", "_before")


MIN_PREFIX = 32


def causality_check(df: DataFrame, fn: Callable[[DataFrame, dict], DataFrame], params: dict | None = None, key: str = "symbol",
                    shares: tuple[float, ...] = (0.5, 0.75, 0.9, 1.0), strict: bool = True) -> DataFrame:
    """Prefix test: the signal computed on the first K bars must equal the first K signals of the full run.

    One row per series and cut: K is the rounded share of its bars (the last share leaves out one bar), cuts below
    ``MIN_PREFIX`` bars are left out.  ``status`` is ``ok``, ``mismatch`` or ``length`` (rows lost or added); a series too
    short for any cut has one row with status ``short``.
    """
    bars = with_series_order(df.withColumn("signal", F.lit(0)) if "signal" not in df.columns else df, [key])
    base = bars.withColumns({"_rn": F.col("pos") + 1, "_n": F.col("series_rows")}).drop("pos", "series_rows", "prev_signal")
    base = base if "signal" in df.columns else base.drop("signal")
    sizes = base.groupBy(key).agg(F.max("_n").alias("_n"))
    full = fn(base, params or {}).select(key, "_rn", F.col("signal").cast("double").alias("_full"))
    out = sizes.filter(F.col("_n") < MIN_PREFIX + 1).select(
        key, F.lit(None).cast("double").alias("share"), F.col("_n").alias("prefix_rows"), F.lit(0).cast("bigint").alias("mismatches"),
        F.lit(None).cast("bigint").alias("first_mismatch"), F.lit("short").alias("status"))
    for s in shares:
        cut = F.col("_n") - 1 if float(s) >= 1.0 else F.bround(F.col("_n") * float(s)).cast("bigint")
        fit = (cut >= MIN_PREFIX) & (cut < F.col("_n"))
        part = fn(base.filter(fit & (F.col("_rn") <= cut)), params or {}).select(key, "_rn", F.col("signal").cast("double").alias("_part"))
        a, b = (F.col("_full"), F.col("_part")) if strict else (F.signum("_full"), F.signum("_part"))
        want = sizes.filter(fit).select(key, cut.cast("bigint").alias("prefix_rows"))
        both = part.withColumn("_in_part", F.lit(1)).join(full.withColumn("_in_full", F.lit(1)).join(want, key).filter("_rn <= prefix_rows"), [key, "_rn"], "full")
        bad = ~a.eqNullSafe(b)
        one = both.groupBy(key).agg(F.count("_in_part").alias("_p"), F.count("_in_full").alias("_f"), F.count_if(bad).alias("mismatches"),
                                    F.min(F.when(bad, F.col("_rn"))).cast("bigint").alias("first_mismatch"))
        one = want.join(one, key, "left").select(
            key, F.lit(float(s)).alias("share"), "prefix_rows", F.coalesce("mismatches", F.lit(0)).cast("bigint").alias("mismatches"), "first_mismatch",
            F.expr("case when coalesce(_p, 0) <> prefix_rows or coalesce(_f, 0) <> prefix_rows then 'length' when mismatches > 0 then 'mismatch' else 'ok' end").alias("status"))
        out = out.unionByName(one)
    return out


def contract_check(bars: DataFrame, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """(keys, row_count, signal_count, contract_ok): signals are -1, 0 or 1, none is missing, and rows are as many as ``expected`` has."""
    s = F.col("signal").cast("double")
    bad = s.isNull() | F.isnan(s) | ~s.isin(-1.0, 0.0, 1.0)
    got = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(s != 0).alias("signal_count"), F.count_if(bad).alias("_bad"))
    want = got.select(*keys, F.col("row_count").alias("_want")) if expected is None else expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_want"))
    both = want.join(got, keys, "left")
    return both.select(*keys, F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("signal_count", F.lit(0)).alias("signal_count"),
                       F.coalesce(F.expr("row_count = _want and _bad = 0"), F.lit(False)).alias("contract_ok"))


STAGES = ("signal_contract", "signal_causality", "edge_surface", "metrics")


def evaluate(bars: DataFrame, keys: list[str], min_trades: int = 50, iterations: int = 100, expected: DataFrame | None = None, causality: DataFrame | None = None,
             edge_config: dict | None = None, next_open_edge: bool = False, target_sharpe: float = 0.0, effective_trials: int = 1, gate_config: dict | None = None,
             run_gauntlet: bool = True, frame: list[str] = (), params: dict | None = None) -> DataFrame:
    """One row per strategy key with the outcome of every stage; a key that fails a stage does not enter the later ones.

    Stages: signal contract (rows of ``expected``), causality (rows of :func:`causality_check`, every status of a key being ``ok``), edge surface
    (``edge_config``), then metrics at adaptive costs, gauntlet, deflated Sharpe, decay and factors with their gates (arguments of
    ``advanced_gates``).  After each stage the keys that stay are a small staged table, and the bars of the others are not read again.  Rolling
    costs restart on the ``frame`` columns.  ``failed_stage`` and ``failure_code`` tell where a key stopped.
    """
    own = [*keys, *frame, "date_utc", "ts_event", "seq", "open", "high", "low", "close", "volume", "bid_price", "ask_price", "signal", *[c for c, _ in FAMILIES.values()], "position_in_va"]
    bars = stored(with_day(bars).select(*dict.fromkeys(c for c in own if c in (*bars.columns, "date_utc"))), "evaluated_bars")
    first = contract_check(bars, keys, expected)
    if causality is not None:
        held = causality.groupBy(*keys).agg((F.count_if(F.col("status") != "ok") == 0).alias("causality_ok"))
        first = first.join(held, keys, "left").withColumn("causality_ok", F.when(F.col("contract_ok"), F.coalesce("causality_ok", F.lit(False))))
    else:
        first = first.withColumn("causality_ok", F.when(F.col("contract_ok"), F.lit(True)))
    first = stored(first, "evaluation_first")
    live = bars.join(first.filter("causality_ok").select(*keys), keys, "left_semi")
    surface = edge.edge_surface(live, keys, next_open_edge, edge_config, params) if edge.normalize_config(edge_config)["enabled"] else live.select(*keys).distinct()
    status = edge.surface_status(surface, keys, edge_config).select(*keys, F.col("status").alias("edge_status"), F.col("passed").alias("edge_passed"))
    status = stored(status, "evaluation_edge")
    live = stored(live.join(status.filter("edge_passed").select(*keys), keys, "left_semi"), "evaluation_bars")
    priced = stored(with_bar_cost(live, [*keys, *frame], params), "evaluation_priced")
    trades = stored(run_trades(priced, keys, ["bar_cost"]).withColumnRenamed("entry_bar_cost", "adaptive_cost_rt").drop("exit_bar_cost"), "evaluation_trades")
    pnl = trade_pnl(trades, "adaptive_cost_rt", params=params)
    parts = [metrics(trades, keys, params=params).select(*keys, "trade_count", "net_pnl", "sharpe_ratio"),
             deflated_sharpe(daily_pnl(pnl, keys), keys, "net_pnl", int(effective_trials)).select(*keys, "dsr", F.col("available").alias("dsr_available")),
             alpha_decay(rolling_sharpe(pnl, keys), keys, params=params).select(*keys, F.col("verdict").alias("decay_verdict")),
             factor_attribution(pnl, live, keys, params=params).select(*keys, F.col("verdict").alias("factor_verdict"))]
    if run_gauntlet:
        signalled = live.join(first.filter("signal_count > 0").select(*keys), keys, "left_semi")
        g = gauntlet(signalled, keys, min_trades, iterations, params=params)
        checks = [c for c in g.columns if c not in (*keys, "pass_count", "overall_verdict")]
        parts.append(g.select(*keys, *[F.col(c).alias(f"check_{c}") for c in checks], "pass_count", F.col("overall_verdict").alias("gauntlet_verdict")))
    out = first.join(status, keys, "left")
    for part in parts:
        out = out.join(stored(part, "evaluation_part"), keys, "left")
    passed = F.coalesce("edge_passed", F.lit(False))
    out = out.withColumns({"trade_count": F.when(passed, F.coalesce("trade_count", F.lit(0))), "net_pnl": F.when(passed, F.coalesce("net_pnl", F.lit(0.0))),
                           "decay_verdict": F.when(passed, F.coalesce("decay_verdict", F.lit("INSUFFICIENT_DATA"))),
                           "factor_verdict": F.when(passed, F.coalesce("factor_verdict", F.lit("INSUFFICIENT_DATA"))), "dsr_available": F.coalesce("dsr_available", F.lit(False))})
    out = advanced_gates(out, **(gate_config or {})).withColumnRenamed("passed", "gates_passed").drop("enabled")
    enough = F.coalesce((F.col("sharpe_ratio") >= float(target_sharpe)) & (F.col("trade_count") >= int(min_trades)), F.lit(False))
    checked = F.coalesce(F.col("gauntlet_verdict") == "PASS", F.lit(False)) if run_gauntlet else F.lit(True)
    stage = (F.when(~F.col("contract_ok"), STAGES[0]).when(~F.col("causality_ok"), STAGES[1]).when(~passed, STAGES[2]).when(~enough, STAGES[3])
             .when(~checked, "gauntlet").when(~F.col("gates_passed"), "advanced_gates"))
    return out.withColumns({"gates_passed": F.when(passed, F.col("gates_passed")), "meets_thresholds": F.when(passed, enough), "failed_stage": stage}).withColumns({
        "failure_code": F.when(F.col("failed_stage") == STAGES[2], F.col("edge_status")).when(F.col("failed_stage").isin(*STAGES[:2]), F.col("failed_stage")),
        "verdict": F.when(stage.isNull(), "PASS").otherwise("FAIL")})
