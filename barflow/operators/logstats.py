"""Experiment-log analytics: trial counts, scorecards, near misses, identities and status boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import first_filled, json_array, json_object, json_reordered, json_text, short_digest, slug, stripped

TRIAL_EVENTS = ("task_result", "task_error")


def trials(log: DataFrame) -> DataFrame:
    """Rows that stand for one execution: task events, or rows without event that name a strategy."""
    named = F.coalesce(F.nullif("strategy_id", F.lit("")), F.nullif("strategy_name", F.lit(""))).isNotNull()
    blank = F.coalesce(F.trim("event"), F.lit("")) == ""
    return log.filter(F.col("event").isin(*TRIAL_EVENTS) | (blank & named))


def trial_keys(log: DataFrame) -> DataFrame:
    """(family, key, n) of counted trials: the strategy's name, and its identity, which is the id or else name and parameters in canonical order.

    Rows are counted by their texts first, so each parameter text is parsed once.
    """
    raw = trials(log).groupBy("strategy_id", "strategy_name", "params").agg(F.count(F.lit(1)).alias("n"))
    key = F.coalesce(F.nullif("strategy_id", F.lit("")), F.concat_ws(":", F.col("strategy_name"), json_reordered(F.col("params"))))
    return raw.select(F.coalesce(F.nullif(F.trim("strategy_name"), F.lit("")), "strategy_id").alias("family"), key.alias("key"), "n")


def trial_totals(counts: DataFrame) -> DataFrame:
    """Raw, unique and effective trials of counted (family, key, n) rows; families count with the square root of their size."""
    f = counts.groupBy("family").agg(F.sum("n").alias("n")).agg(
        F.sum("n").alias("raw_trials"), F.count("family").alias("family_count"), F.sum(F.when(F.col("family").isNotNull(), F.sqrt("n"))).alias("_e"), F.lit(1).alias("_k"))
    u = counts.agg(F.countDistinct("key").alias("unique_strategies"), F.lit(1).alias("_k"))
    return f.join(u, "_k").select(
        F.coalesce("raw_trials", F.lit(0)).alias("raw_trials"), "unique_strategies", "family_count",
        F.expr("if(coalesce(raw_trials, 0) = 0 or _e is null, 1L, greatest(1L, least(cast(round(_e) as bigint), raw_trials)))").alias("effective_trials"))


def trial_counts(log: DataFrame) -> DataFrame:
    """Raw, unique and effective trials of a log."""
    return trial_totals(trial_keys(log).groupBy("family", "key").agg(F.sum("n").alias("n")))


def normalize_theme(tag: Column) -> Column:
    """Slug of at most four parts; an empty tag is ``other``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(tag), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "other").otherwise(F.array_join(F.slice(F.split(slug, "_"), 1, 4), "_"))


def failure_codes(result: str) -> Column:
    """Sorted union of failed gauntlet checks, failed gates and the explicit failure code.

    A failed edge surface stops the later stages, so only its status and the failure code count.
    """
    r = F.col(result)
    failed = F.map_keys(F.map_filter(r["gauntlet"], lambda k, v: F.upper(v["verdict"]) == "FAIL"))
    code = F.array_compact(F.array(F.nullif(F.trim(r["failure_code"]), F.lit(""))))
    empty = F.array().cast("array<string>")
    checks = F.array_union(F.array_union(F.coalesce(failed, empty), F.coalesce(r["failed_gates"], empty)), code)
    edge = F.array_union(code, F.array_compact(F.array(F.nullif(F.trim(r["edge_status"]), F.lit("")))))
    return F.when(r.isNull(), empty).otherwise(F.array_sort(F.when(~r["edge_passed"], edge).otherwise(checks)))


def task_results(log: DataFrame) -> DataFrame:
    """Rows that report one finished task of a bar configuration; the only ones that count as attempts."""
    return log.filter((F.col("event") == "task_result") & (F.coalesce(F.trim("bar_config"), F.lit("")) != ""))


def with_outcome(log: DataFrame) -> DataFrame:
    """Task results with theme, stage outcomes and failure codes."""
    s, t = F.col("search_result"), F.col("selection_result")
    return task_results(log).withColumns({
        "theme": normalize_theme(F.col("theme_tag")), "edge_pass": F.coalesce(s["edge_passed"], F.lit(True)),
        "search_pass": F.coalesce(F.upper(s["verdict"]) == "PASS", F.lit(False)), "selection_attempt": t.isNotNull(),
        "selection_pass": F.coalesce(F.upper(t["verdict"]) == "PASS", F.lit(False)),
        "codes": F.array_sort(F.array_union(failure_codes("search_result"), failure_codes("selection_result")))})


def laplace(passes: Column, attempts: Column) -> Column:
    return (passes + 1) / (attempts + 2)


def scorecard(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, passes by stage and Laplace rates per theme, bar configuration or setup."""
    n = F.col("attempts")
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("edge_pass").alias("edge_passes"), F.count_if("search_pass").alias("search_passes"),
        F.count_if("selection_attempt").alias("selection_attempts"), F.count_if("selection_pass").alias("selection_passes")).withColumns({
            "edge_rate": laplace(F.col("edge_passes"), n), "search_rate": laplace(F.col("search_passes"), n),
            "selection_rate": laplace(F.col("selection_passes"), F.col("selection_attempts"))})


def theme_scorecard(log: DataFrame) -> DataFrame:
    """Attempts and passes of each theme, from completed validation hand-offs."""
    n = F.col("attempts")
    done = log.filter(F.col("event") == "validation_handoff_completed").withColumn("theme", normalize_theme(F.col("theme_tag")))
    return done.groupBy("theme").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("pass_count") > 0).alias("search_passes"),
        F.count_if("selection_attempted").alias("selection_attempts"), F.count_if("selection_passed").alias("selection_passes")).withColumns({
            "search_rate": laplace(F.col("search_passes"), n), "selection_rate": laplace(F.col("selection_passes"), F.col("selection_attempts"))})


def failure_counts(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return outcomes.select(*keys, F.explode("codes").alias("code")).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("fail_count"))


def near_misses(log: DataFrame, top: int = 10) -> DataFrame:
    """Failed task results with a positive Sharpe and at least one code: best per strategy, configuration and split."""
    parts = None
    for split, col in (("search", "search_result"), ("selection", "selection_result")):
        one = task_results(log).select("strategy_name", "bar_config", F.lit(split).alias("split"), F.col(f"{col}.verdict").alias("verdict"), "timestamp", "event_id",
                                       normalize_theme(F.col("theme_tag")).alias("theme"), F.col(f"{col}.metrics.sharpe_ratio").alias("sharpe"), failure_codes(col).alias("codes"))
        parts = one if parts is None else parts.unionByName(one)
    hit = parts.filter((F.upper("verdict") == "FAIL") & (F.col("sharpe") > 0) & (F.size("codes") > 0))
    row = F.struct("sharpe", "timestamp", "event_id", "theme", "codes")
    best = hit.groupBy("strategy_name", "bar_config", "split").agg(F.max(row).alias("b"))
    best = best.select("strategy_name", "bar_config", "split", "b.sharpe", "b.theme", F.array_join("b.codes", ",").alias("failed_checks"))
    return best.orderBy(F.col("sharpe").desc(), "strategy_name", "bar_config", "split").limit(int(top))


def low_sample_themes(outcomes: DataFrame, below: int = 3) -> DataFrame:
    return outcomes.groupBy("theme").agg(F.count(F.lit(1)).alias("attempts")).filter(F.col("attempts") < int(below))


def recent_outcomes(outcomes: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc(), F.col("event_id").desc())
    return outcomes.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= int(n))


# Parameters that describe how a setup leaves a trade, in the order in which they are listed.
EXIT_PARAMS = ("sl_ticks", "pt_ticks", "max_bars", "exit_bars", "profit_target", "stop_loss", "profit_target_return", "stop_loss_return", "min_bars_between")


def condition_signatures(conditions: Column) -> Column:
    """Sorted (feature, operator, role, kind) of an array of conditions with ``feature`` or ``column``, ``op`` or ``operator``, and ``role``."""
    def one(c: Column) -> Column:
        op, role = first_filled(c["op"], c["operator"]), F.lower(stripped(c["role"]))
        kind = F.when(op == "between", "between").when(op.isin("bool_true", "bool_false"), "boolean").otherwise("compare")
        return F.struct(first_filled(c["feature"], c["column"]).alias("feature"), op.alias("operator"),
                        F.coalesce(F.nullif(role, F.lit("")), F.lit("confirmation")).alias("role"), kind.alias("kind"))
    return F.array_sort(F.filter(F.transform(conditions, one), lambda c: (c["feature"] != "") & (c["operator"] != "")))


def _param_keys(params: Column) -> Column:
    """Keys of a JSON object of parameters."""
    return F.coalesce(F.json_object_keys(params), F.array().cast("array<string>"))


def setup_identity(rows: DataFrame, bar_config: str = "bar_config", theme: str = "theme_tag", conditions: str = "entry_conditions", params: str = "params",
                   logic: str = "entry_logic") -> DataFrame:
    """``rows`` with ``setup_key`` and ``setup_label``: digest and description of configuration, theme, conditions, exits and entry text."""
    d = rows.withColumns({"_conditions": F.coalesce(condition_signatures(F.col(conditions)), F.array().cast("array<struct<feature:string,operator:string,role:string,kind:string>>")),
                          "_bar": stripped(F.col(bar_config)),
                          "_exits": F.filter(F.array(*[F.lit(k) for k in EXIT_PARAMS]), lambda k: F.array_contains(_param_keys(F.col(params)), k))})
    words = F.trim(F.regexp_replace(F.lower(stripped(F.col(logic))), "[^a-z0-9]+", " "))
    signature = json_object({
        "bar_config": json_text(F.col("_bar")), "theme_tag": json_text(slug(F.col(theme))), "condition_count": F.size("_conditions").cast("string"),
        "conditions": json_array(F.col("_conditions"), lambda c: json_object({n: json_text(c[n]) for n in ("feature", "operator", "role", "kind")})),
        "exit_profile": json_array(F.col("_exits")), "direction_logic_hash": json_text(F.when(words == "", "").otherwise(short_digest(words, 12)))})
    named = F.transform(F.slice("_conditions", 1, 3), lambda c: F.concat(c["feature"], F.lit(" "), c["operator"], F.lit(" ("), c["role"], F.lit(")")))
    more = F.when(F.size("_conditions") > 3, F.array(F.concat(F.lit("+"), (F.size("_conditions") - 3).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    listed = F.coalesce(F.nullif(F.array_join(F.concat(named, more), ", "), F.lit("")), F.lit("no_conditions"))
    exits = F.coalesce(F.nullif(F.array_join(F.slice("_exits", 1, 3), ","), F.lit("")), F.lit("basic_exit"))
    label = F.concat(F.coalesce(F.nullif(F.col("_bar"), F.lit("")), F.lit("unknown_bar")), F.lit(" | "), listed, F.lit(" | exit="), exits)
    out = d.withColumns({"setup_key": F.concat(F.lit("setup_"), short_digest(signature, 16)), "setup_label": label})
    return out.drop("_conditions", "_bar", "_exits")


def task_setup(rows: DataFrame, params: str = "params") -> DataFrame:
    """``rows`` with the ``setup_key`` and ``setup_label`` that a task or its ``source`` names; without one, a digest of configuration, strategy and parameter names."""
    def given(name: str) -> Column:
        return first_filled(*([F.col(name)] if name in rows.columns else []), *([F.col("source")[name]] if "source" in rows.columns else []), F.lit(""))
    bar, strategy = stripped(F.col("bar_config")), stripped(F.col("strategy_name"))
    body = json_object({"bar_config": json_text(bar), "strategy_name": json_text(strategy), "param_keys": json_array(F.array_sort(_param_keys(F.col(params))))})
    known = given("setup_key") != ""
    key = F.when(known, given("setup_key")).otherwise(F.concat(F.lit("setup_"), short_digest(body, 16)))
    named = F.coalesce(F.nullif(given("setup_label"), F.lit("")), given("setup_key"))
    other = F.concat(F.coalesce(F.nullif(bar, F.lit("")), F.lit("unknown_bar")), F.lit(" | "), F.coalesce(F.nullif(strategy, F.lit("")), F.lit("unknown_strategy")))
    return rows.withColumns({"setup_key": key, "setup_label": F.when(known, named).otherwise(other)})


def event_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def request_summary(log: DataFrame) -> DataFrame:
    """Verdict counts, averages, configurations and best configuration per validation request.

    A task that is neither PASS nor ERROR has failed; any error makes the request an ERROR.
    """
    r = F.col("search_result.metrics")
    verdict = F.when(F.col("event") == "task_error", "ERROR").otherwise(F.upper(F.coalesce("verdict", F.lit(""))))
    t = log.filter(F.col("event").isin(*TRIAL_EVENTS)).withColumn("_v", verdict)
    ok, won, lost = F.col("_v") != "ERROR", F.col("_v") == "PASS", ~F.col("_v").isin("PASS", "ERROR")
    best = F.when(ok & r["sharpe_ratio"].isNotNull(), F.struct(r["sharpe_ratio"].alias("s"), F.col("bar_config").alias("b")))

    def configs(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.nullif(F.trim("bar_config"), F.lit(""))))), ",")
    g = t.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("task_count"), F.count_if(won).alias("pass_count"), F.count_if(lost).alias("fail_count"),
        F.count_if(~ok).alias("error_count"), F.avg(F.when(ok, r["sharpe_ratio"])).alias("avg_sharpe"), F.avg(F.when(ok, r["net_pnl"])).alias("avg_net_pnl"),
        F.avg(F.when(ok, r["trade_count"])).alias("avg_trade_count"), configs(won).alias("passing_configs"), configs(lost).alias("failing_configs"),
        F.max(best).alias("_best"))
    return g.withColumns({
        "pass_fraction": F.col("pass_count") / F.col("task_count"), "best_bar_config": F.col("_best.b"), "best_sharpe": F.col("_best.s"),
        "overall": F.expr("case when error_count > 0 then 'ERROR' when pass_count = task_count then 'PASS' when pass_count > 0 then 'MIXED' else 'FAIL' end")}).drop("_best")


def status_board(log: DataFrame, recent: int = 10) -> DataFrame:
    """Result and error counts of the log, and rates, averages, best and worst of the last ``recent`` results (a report of the newest)."""
    ok = F.col("event") == "task_result"
    pnl, sharpe = F.col("search_result.metrics.net_pnl"), F.col("search_result.metrics.sharpe_ratio")
    finite = pnl.isNotNull() & sharpe.isNotNull() & ~F.isnan(pnl) & ~F.isnan(sharpe) & (F.abs(pnl) < float("inf")) & (F.abs(sharpe) < float("inf"))
    order = F.when(finite, F.struct(pnl.alias("p"), F.col("strategy_name").alias("s")))
    total = log.agg(F.count_if(ok).alias("results"), F.count_if(F.col("event") == "task_error").alias("errors"))
    last = log.filter(ok).orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(int(recent)).agg(
        F.count_if(finite).alias("tested"), (100.0 * F.count_if(F.col("verdict") == "PASS") / F.count(F.lit(1))).alias("pass_rate_pct"),
        F.avg(F.when(finite, pnl)).alias("avg_net_pnl"), F.avg(F.when(finite, sharpe)).alias("avg_sharpe"), F.max(order).alias("_b"), F.min(order).alias("_w"))
    return total.join(last, F.lit(True)).select("results", "errors", "tested", "pass_rate_pct", "avg_net_pnl", "avg_sharpe", F.col("_b.s").alias("best_strategy"),
                                                F.col("_b.p").alias("best_pnl"), F.col("_w.s").alias("worst_strategy"), F.col("_w.p").alias("worst_pnl"))


def queue_states(tasks: DataFrame) -> DataFrame:
    """Tasks per state of the four known ones; a state without tasks counts zero."""
    n = [F.count_if(F.col("state") == s).alias(s) for s in ("pending", "in_progress", "completed", "failed")]
    return tasks.agg(*n)


def active_hypotheses(tasks: DataFrame, top: int = 4) -> DataFrame:
    """The hypotheses with most pending or running tasks."""
    live = tasks.filter(F.col("state").isin("pending", "in_progress") & (F.coalesce(F.trim("hypothesis_id"), F.lit("")) != ""))
    return live.groupBy(F.trim("hypothesis_id").alias("hypothesis_id")).agg(F.count(F.lit(1)).alias("tasks")).orderBy(F.desc("tasks"), "hypothesis_id").limit(int(top))


def strategy_results(log: DataFrame, recent: int | None = None, latest: bool = False) -> DataFrame:
    """One result per strategy: the oldest by default, the newest on request; over the last ``recent`` rows only if asked."""
    rows = log.filter(F.col("event") == "task_result")
    if recent is not None:
        rows = rows.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(int(recent))
    order = F.struct("timestamp", "event_id")
    row = F.struct("timestamp", "event_id", "bar_config", "verdict", F.col("search_result.metrics.net_pnl").alias("net_pnl"))
    return rows.groupBy("strategy_name").agg((F.max_by if latest else F.min_by)(row, order).alias("r")).select("strategy_name", "r.*")


QUERY_MODES = ("plain", "research", "deep_research")


def query_audit(audit: DataFrame, keys: list[str] = ("run_id", "iteration", "stage", "lane_id")) -> DataFrame:
    """Queries by mode, the successful ones without fallback, errors, source sums and the first three distinct previews."""
    keys, mode = list(keys), F.lower(F.trim("mode"))
    good = F.coalesce(F.lower(F.trim("status")) == "success", F.lit(False))
    fallback = F.coalesce("fallback_to_plain", F.lit(False))
    preview = F.trim(F.coalesce("question_preview", F.lit("")))
    firsts = audit.withColumn("_p", preview).filter("_p <> ''").groupBy(*keys, "_p").agg(F.min(F.struct("timestamp", "seq")).alias("_at"))
    w = Window.partitionBy(*keys).orderBy("_at")
    firsts = firsts.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_p"))), lambda s: s["_p"]), "|").alias("previews"))
    counts = audit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("query_count"), F.count_if(good).alias("success_count"), F.count_if(~good).alias("error_count"), F.count_if(fallback).alias("fallback_count"),
        *[F.count_if(mode == m).alias(f"{m}_count") for m in QUERY_MODES], *[F.count_if((mode == m) & good & ~fallback).alias(f"{m}_kept") for m in QUERY_MODES],
        F.sum(F.coalesce("discovered_sources", F.lit(0))).alias("discovered_sources"), F.sum(F.coalesce("imported_sources", F.lit(0))).alias("imported_sources"))
    return counts.join(firsts, keys, "left")


def feature_family(feature: Column) -> Column:
    """Family that a primary feature rests with (fixed names of the feature matrix); other features rest alone."""
    f = F.lower(F.trim(feature))
    return (F.when(f.contains("va_position") | (f == "position_in_va"), "value_area_position")
            .when(f.startswith("dist_prev_") | f.isin("prev_day_poc", "prev_day_vah", "prev_day_val"), "previous_session_value_reference")
            .when(f.isin("value_acceptance_rate_8", "va_rejection_score", "price_discovery_score", "failed_auction_score"), "auction_state_anchor")
            .otherwise(f))


def cooldowns(attempts: DataFrame, keep_from: int = 2, top: int = 4) -> DataFrame:
    """Feature families to rest; the strongest few are listed with their first feature.

    A primary condition scores 2 if its attempt has conflicts between samples, else 1 if the attempt failed without a
    signal or on a dead primary feature and the condition blocks all rows.
    """
    stuck = F.lower(F.trim("failure_type")).isin("zero_signal", "dead_feature_primary")
    blocks = (F.lower(F.trim(F.coalesce("severity", F.lit("")))) == "blocks_all") | (F.coalesce("pass_rate_pct", F.lit(0.0)) <= 0)
    score = F.when(F.coalesce("has_conflicts", F.lit(False)), 2).when(F.coalesce(stuck, F.lit(False)) & blocks, 1).otherwise(0)
    role = F.coalesce(F.nullif(F.lower(F.trim("role")), F.lit("")), F.lit("primary"))
    a = attempts.filter((role == "primary") & (F.trim(F.coalesce("feature", F.lit(""))) != "")).withColumn("_s", score).filter("_s > 0")
    g = a.groupBy(feature_family(F.col("feature")).alias("family")).agg(F.sum("_s").alias("score"), F.min_by("feature", F.struct("attempt", "feature")).alias("feature"))
    return g.filter(F.col("score") >= int(keep_from)).orderBy(F.col("score").desc(), "feature").limit(max(1, int(top)))


def feedback_feed(logs: list[DataFrame], limit: int) -> DataFrame:
    """Newest task rows of each log, merged in source order."""
    out = None
    for i, log in enumerate(logs):
        w = Window.partitionBy(F.lit(0)).orderBy("_neg", F.col("event_id").desc())
        top = log.filter(F.col("event").isin(*TRIAL_EVENTS)).orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(int(limit))
        one = top.withColumn("_neg", -F.unix_micros("timestamp")).select(F.lit(i).alias("source"), F.row_number().over(w).alias("position"),
                                                                         "event_id", "event", "strategy_name", "timestamp")
        out = one if out is None else out.unionByName(one)
    return out
