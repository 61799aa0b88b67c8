"""Entry conditions as a table: rules, feasibility on samples, conflicts between samples and new thresholds.

A condition table has one row per (brief, pos): ``feature``, ``op``, ``role``, the parameter names ``param_key`` (comparisons), ``param_key_low`` and
``param_key_high`` (between), and their values ``value``, ``low`` and ``high``.  ``condition_table`` fills the values in from parameters.

Predicates are data: briefs are packed into one array and each bar row meets all of them in place, yielding a bit mask of the
conditions that hold and one of the features that are finite.  Bars are then counted by (sample, brief, masks), so what is
shuffled are counts; passes of single conditions, the combination of all of them and the status of a sample come from the
masks.  Only the columns that conditions name are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..sources.stage import stored

EPS = 1e-12
OVER_SIGNAL_PCT = 2.0
MAX_CONDITIONS, MAX_PRIMARY, MAX_CONFIRMATION = 3, 2, 1
#: Briefs that are packed and sent to the bars at once; more briefs are taken in turns.
BRIEFS = 512
# Operators and roles, other names for roles, prefixes of features that need earlier sessions, parameters that stay.
COMPARISONS = (">", ">=", "<", "<=")
OPS = (*COMPARISONS, "between", "bool_true", "bool_false")
ROLES = ("primary", "confirmation")
ROLE_ALIASES = {"location_filter": "primary", "setup_filter": "primary", "structural_filter": "primary", "market_regime_filter": "primary",
                "anchor_filter": "primary", "trigger_filter": "confirmation", "timing_filter": "confirmation", "confirmation_filter": "confirmation",
                "micro_trigger": "confirmation", "micro_trigger_filter": "confirmation"}
CONTEXT_PREFIXES = ("prev_day_", "dist_prev_")
PROTECTED_PREFIXES = ("sl_ticks", "pt_ticks")
IDENTITY = ["feature", "op", "role", "param_key", "param_key_low", "param_key_high"]
COLUMNS = {"brief": "string", "pos": "int", "feature": "string", "op": "string", "role": "string", "param_key": "string", "param_key_low": "string",
           "param_key_high": "string", "value": "double", "low": "double", "high": "double"}


def _trimmed(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))


def _role() -> Column:
    """The role as it is read: lower case, ``primary`` where it is empty."""
    role = F.lower(_trimmed("role"))
    return F.when(role == "", "primary").otherwise(role)


def condition_table(rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """The table with all its columns, texts trimmed and parameter names only where the operator takes them.

    ``params`` (brief, param_key, value) gives the values of parameters; without it ``value``, ``low`` and ``high`` are those of ``rows``.
    """
    d = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    d = d.withColumns({"feature": _trimmed("feature"), "op": _trimmed("op"), "role": _role()})
    compare, between = F.col("op").isin(*COMPARISONS), F.col("op") == "between"
    d = d.withColumns({"param_key": F.when(compare, _trimmed("param_key")).otherwise(""),
                       **{c: F.when(between, _trimmed(c)).otherwise("") for c in ("param_key_low", "param_key_high")}})
    if params is None:
        return d
    for key, name in (("param_key", "value"), ("param_key_low", "low"), ("param_key_high", "high")):
        p = params.select("brief", F.col("param_key").alias(key), F.col("value").cast("double").alias("_v"))
        d = d.join(p, ["brief", key], "left").withColumn(name, F.col("_v")).drop("_v")
    return d.select(*COLUMNS)


def check_conditions(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rule violations of each brief: its size, roles, operators, features, parameters, bounds and duplicates.

    A comparison needs a named parameter with a value, ``between`` two of them in order; a condition is a duplicate where
    feature, operator, role and parameter names are those of an earlier one.
    """
    d = condition_table(table.withColumn("brief", F.to_json(F.struct(*keys)))).withColumn("_keys", F.from_json("brief", table.select(*keys).schema))
    compare, between = F.col("op").isin(*COMPARISONS), F.col("op") == "between"
    lacking = (compare & ((F.col("param_key") == "") | F.col("value").isNull())) | (between & (
        (F.col("param_key_low") == "") | (F.col("param_key_high") == "") | F.col("low").isNull() | F.col("high").isNull()))
    g = d.groupBy("_keys").agg(
        F.count(F.lit(1)).alias("condition_count"), F.count_if(F.col("role") == "primary").alias("primary_count"),
        F.count_if(F.col("role") == "confirmation").alias("confirmation_count"),
        F.count_if(~F.col("op").isin(*OPS) | ~F.col("role").isin(*ROLES)).alias("unknown_count"), F.count_if(F.col("feature") == "").alias("unnamed_count"),
        F.count_if(lacking).alias("missing_value_count"), F.count_if(between & (F.col("low") > F.col("high"))).alias("bad_bounds"),
        F.countDistinct(F.struct(*IDENTITY)).alias("_distinct"))
    g = g.withColumn("duplicate_count", F.expr("condition_count - _distinct")).withColumn("valid", F.expr(
        f"condition_count <= {MAX_CONDITIONS} and primary_count <= {MAX_PRIMARY} and confirmation_count <= {MAX_CONFIRMATION} and unknown_count = 0 "
        "and unnamed_count = 0 and missing_value_count = 0 and bad_bounds = 0 and duplicate_count = 0"))
    return g.select("_keys.*", *[c for c in g.columns if c not in ("_keys", "_distinct")])


def coerce_conditions(table: DataFrame) -> DataFrame:
    """Briefs put in shape rather than refused: other role names are read, and repeated or surplus conditions left out, the first ones staying."""
    d = condition_table(table)
    known = F.create_map(*[F.lit(v) for pair in ROLE_ALIASES.items() for v in pair])[F.col("role")]
    held = [F.contains(F.col("role"), F.lit(w)) for w in ("confirm", "trigger", "timing", "location", "struct", "regime", "setup", "anchor")]
    yes_no = F.when(F.col("op").isin("bool_true", "bool_false"), "confirmation").otherwise("primary")
    role = (F.when(F.col("role").isin(*ROLES), F.col("role")).when(known.isNotNull(), known).when(held[0] | held[1] | held[2], "confirmation")
            .when(held[3] | held[4] | held[5] | held[6] | held[7], "primary").when(F.endswith("role", F.lit("_filter")), yes_no).otherwise(F.col("role")))
    d = d.withColumn("role", role)
    d = d.withColumn("_again", F.row_number().over(Window.partitionBy("brief", *IDENTITY).orderBy("pos"))).where("_again = 1")
    d = d.withColumn("_place", F.row_number().over(Window.partitionBy("brief", "role").orderBy("pos")))
    return d.where(F.col("_place") <= F.when(F.col("role") == "confirmation", MAX_CONFIRMATION).otherwise(MAX_PRIMARY)).select(*COLUMNS)


def _holds(x: Column, c: Column) -> Column:
    op = c["op"]
    return (F.when(op == ">", x > c["value"]).when(op == ">=", x >= c["value"]).when(op == "<", x < c["value"]).when(op == "<=", x <= c["value"])
            .when(op == "between", (x >= c["low"]) & (x <= c["high"])).when(op == "bool_true", x > 0.5).when(op == "bool_false", x <= 0.5))


def _masks(df: DataFrame, packed: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, brief, passed, finite, n): rows counted by which conditions hold and which features are finite."""
    cells = [F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) for x in (F.col(f"`{c}`").cast("double") for c in features)]
    rows = df.select(*keys, F.array(*cells).cast("array<double>").alias("_v"), F.lit(1).alias("_k")).join(F.broadcast(packed), "_k")  # one row of at most BRIEFS briefs
    rows = rows.select(*keys, "_v", F.explode("_briefs").alias("_b"))

    def mask(test) -> Column:
        return F.aggregate("_b.conditions", F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseOR(
            F.when(F.coalesce(test(F.get("_v", c["at"]), c), F.lit(False)), c["bit"]).otherwise(F.lit(0).cast("bigint"))))
    rows = rows.select(*keys, F.col("_b.brief").alias("brief"), mask(_holds).alias("passed"), mask(lambda x, c: x.isNotNull()).alias("finite"))
    return rows.groupBy(*keys, "brief", "passed", "finite").agg(F.count(F.lit(1)).alias("n"))


def pass_through(df: DataFrame, conditions: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Each condition of each brief on its own, and all of a brief together, per key.

    A condition on an absent column, or on one without finite values, holds nowhere and is a dead feature; where the column
    needs earlier sessions, a column without finite values is ``context_unavailable``.
    """
    keys = list(keys)
    table = condition_table(conditions).withColumn("_i", F.row_number().over(Window.partitionBy("brief").orderBy("pos", *IDENTITY)) - 1)
    named = {r.feature for r in table.select("feature").distinct().where(F.col("feature").isin(*df.columns)).collect()}  # columns of ``df`` at most
    features = sorted(named)
    place = F.array_position(F.array(*[F.lit(c) for c in features]).cast("array<string>"), F.col("feature"))
    table = stored(table.withColumns({"at": F.nullif(place, F.lit(0)).cast("int") - 1, "bit": F.expr("shiftleft(1L, _i)")}), "conditions")
    size = table.agg(F.count_distinct("brief").alias("n"), F.max("_i").alias("most")).first()
    if size.most is not None and size.most > 62:
        raise ValueError("a brief has at most 63 conditions")
    turns = max(1, -(-size.n // BRIEFS))
    found = []
    for turn in range(turns):
        part = table.where(F.pmod(F.xxhash64("brief"), F.lit(turns)) == turn)
        packed = part.groupBy("brief").agg(F.collect_list(F.struct("at", "bit", "op", "value", "low", "high")).alias("conditions"))
        packed = packed.agg(F.collect_list(F.struct("brief", "conditions")).alias("_briefs")).withColumn("_k", F.lit(1))
        found.append(_masks(df, packed, features, keys))
    counts = reduce(DataFrame.unionByName, found)
    whole = table.groupBy("brief").agg(F.sum("bit").alias("_all"))
    on = F.expr("passed & bit") != 0
    rows = counts.join(whole, "brief").join(table.drop("at"), "brief")
    g = rows.groupBy(*keys, *[c for c in table.columns if c not in ("at", "bit", "_i")]).agg(
        F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(F.expr("passed = _all"), F.col("n"))), F.lit(0)).alias("combined_count"),
        F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias("pass_count"),
        F.coalesce(F.sum(F.when(F.expr("finite & bit") != 0, F.col("n"))), F.lit(0)).alias("finite_count"))
    g = g.withColumn("pass_rate_pct", F.expr("if(total_count > 0, 100D * pass_count / total_count, 0D)"))
    away = reduce(Column.__or__, [F.startswith(F.lower("feature"), F.lit(p)) for p in CONTEXT_PREFIXES])
    there = F.col("feature").isin(*features) if features else F.lit(False)
    return g.withColumn("severity", F.when(F.col("finite_count") == 0, F.when(there & away, "context_unavailable").otherwise("dead_feature"))
                        .when(F.col("pass_count") == 0, "blocks_all").when(F.col("pass_rate_pct") < 1, "restrictive").otherwise("normal"))


def feature_quantiles(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, p02, p10, p50, p90, p98, is_binary_like) of the finite values of the named columns."""
    long = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in features]).unpivot(keys, features, "feature", "value")
    q = exact_quantiles(long, [*keys, "feature"], "value", {"p02": 0.02, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p98": 0.98})
    ok = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    two = long.groupBy(*keys, "feature").agg((F.count_if(~ok.isin(0.0, 1.0)) == 0).alias("is_binary_like"))
    return q.join(two, [*keys, "feature"])


def feasibility(df: DataFrame, conditions: DataFrame, sample: list[str], requested: DataFrame | None = None, over_signal_pct: float = OVER_SIGNAL_PCT) -> DataFrame:
    """Conditions of each brief on each sample with their features' quantiles, and the brief's status on the sample.

    ``requested`` names the samples that are wanted: one without rows is an ``empty_sample``.
    """
    rows = pass_through(df, conditions, sample)
    features = [r.feature for r in condition_table(conditions).select("feature").distinct().where(F.col("feature").isin(*df.columns)).collect()]
    if requested is not None:
        wanted = requested.select(*sample).distinct().withColumn("_k", F.lit(1))
        own = condition_table(conditions).withColumn("_k", F.lit(1))
        none = wanted.join(rows.select(*sample).distinct(), sample, "left_anti").join(own, "_k").drop("_k")
        zero = {c: F.lit(0).cast("bigint") for c in ("pass_count", "finite_count", "total_count", "combined_count")}
        rows = rows.unionByName(none.withColumns({**zero, "pass_rate_pct": F.lit(0.0), "severity": F.lit("empty_sample")}))
    whole = Window.partitionBy(*sample, "brief")
    rows = rows.withColumns({
        "_away": F.max((F.col("severity") == "context_unavailable").cast("int")).over(whole),
        "_dead": F.max(((F.col("severity") == "dead_feature") & (F.col("role") == "primary")).cast("int")).over(whole)})
    rows = rows.withColumn("status", F.expr(f"""case when total_count = 0 then 'empty_sample' when _away = 1 then 'context_unavailable'
        when _dead = 1 then 'dead_feature_primary' when combined_count = 0 then 'zero_signal'
        when 100D * combined_count / total_count > {float(over_signal_pct)}D then 'over_signal' else 'ok' end""")).drop("_away", "_dead")
    if not features:
        return rows.withColumns({**{p: F.lit(None).cast("double") for p in ("p02", "p10", "p50", "p90", "p98")}, "is_binary_like": F.lit(None).cast("boolean")})
    return rows.join(feature_quantiles(df, features, sample), [*sample, "feature"], "left")


def repair_conflicts(feas: DataFrame, keys: list[str], sample: list[str], dense_pct: float = 2.0) -> DataFrame:
    """Conditions whose threshold is too tight on some samples and too loose on others: one row per condition that a failing sample holds against it.

    A sample without signals counts where the condition itself holds for at most one bar in a hundred, a sample with too many where it holds for
    more than ``dense_pct``.  The samples are given as ordered sets.
    """
    zero = (F.col("status") == "zero_signal") & (F.col("severity").isin("blocks_all", "restrictive") | (F.col("pass_rate_pct") <= 1.0))
    dense = (F.col("status") == "over_signal") & (F.col("pass_rate_pct") > dense_pct)
    name = F.struct(*sample)
    g = feas.where(zero | dense).groupBy(*keys, *IDENTITY).agg(
        F.sort_array(F.collect_set(F.when(zero, name))).alias("zero_samples"), F.sort_array(F.collect_set(F.when(dense, name))).alias("dense_samples"))
    return g.withColumn("conflict", (F.size("zero_samples") > 0) & (F.size("dense_samples") > 0))


def sample_conflicts(feas: DataFrame, keys: list[str], sample: list[str], dense_pct: float = 2.0) -> DataFrame:
    """Quantile ranges of each condition over the samples with data, the samples it likely blocks and those where it still is dense.

    A comparison is taken to block a sample where the feature's p90 (p10 for ``<`` and ``<=``) lies beyond the threshold.  Only conditions
    met on two or more samples are reported.
    """
    blocked = F.expr(f"(op in ('>', '>=') and p90 < value - {EPS}D) or (op in ('<', '<=') and p10 > value + {EPS}D)")
    name = F.struct(*sample)
    used = feas.where(~F.col("status").isin("empty_sample", "context_unavailable"))
    return used.groupBy(*keys, *IDENTITY).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("p10").alias("p10_min"), F.max("p10").alias("p10_max"), F.min("p90").alias("p90_min"), F.max("p90").alias("p90_max"),
        F.sort_array(F.collect_set(F.when(blocked, name))).alias("blocked_samples"),
        F.sort_array(F.collect_set(F.when(F.col("pass_rate_pct") > dense_pct, name))).alias("dense_samples")).where("sample_count >= 2 and p10_min is not null")


def suggest_thresholds(feas: DataFrame) -> DataFrame:
    """New thresholds from the feature's own quantiles: looser where a sample has no signals, tighter where it has too many.

    Nothing is suggested for protected parameters, where nothing would change, or where the bounds of ``between`` would meet.
    """
    up, down = "op in ('>', '>=')", "op in ('<', '<=')"
    looser_up = f"case when p90 < value - {EPS}D then p90 when p50 < value - {EPS}D then p50 when p10 < value - {EPS}D then p10 end"
    looser_dn = f"case when p10 > value + {EPS}D then p10 when p50 > value + {EPS}D then p50 when p90 > value + {EPS}D then p90 end"
    tighter_up = f"if(p98 <= value + {EPS}D, value + greatest((p98 - p90) * 0.25D, abs(p98) * 0.02D, 1e-6D), p98)"
    tighter_dn = f"if(p02 >= value - {EPS}D, value - greatest((p10 - p02) * 0.25D, abs(p02) * 0.02D, 1e-6D), p02)"
    held_lo, held_hi = "greatest(low, (p10 + p50) / 2)", "least(high, (p50 + p90) / 2)"
    half = "greatest((p90 - p10) / 8, 1e-6D)"

    def free(key: str) -> str:
        return f"({key} <> '' and not ({' or '.join(f'''{key} like '{p}%' ''' for p in PROTECTED_PREFIXES)}))"
    one = f"""round(case when status = 'zero_signal' and {up} then {looser_up} when status = 'zero_signal' and {down} then {looser_dn}
        when status = 'over_signal' and {up} then {tighter_up} when status = 'over_signal' and {down} then {tighter_dn} end, 6)"""
    known = f"op = 'between' and {free('param_key_low')} and {free('param_key_high')} and low is not null and high is not null and p50 is not null"
    lo = f"case when status = 'zero_signal' then least(low, p10) when status = 'over_signal' then if({held_lo} >= {held_hi}, p50 - {half}, {held_lo}) end"
    hi = f"case when status = 'zero_signal' then greatest(high, p90) when status = 'over_signal' then if({held_lo} >= {held_hi}, p50 + {half}, {held_hi}) end"
    d = feas.withColumns({"_one": F.expr(f"if({free('param_key')} and value is not null and p50 is not null, {one}, null)"),
                          "_lo": F.expr(f"if({known}, round({lo}, 6), null)"), "_hi": F.expr(f"if({known}, round({hi}, 6), null)")})
    changes = f"(_lo < _hi and (abs(_lo - low) > {EPS}D or abs(_hi - high) > {EPS}D))"
    return d.withColumns({"new_value": F.expr(f"if(abs(_one - value) > {EPS}D, _one, null)"), "new_low": F.expr(f"if({changes}, _lo, null)"),
                          "new_high": F.expr(f"if({changes}, _hi, null)")}).drop("_one", "_lo", "_hi")
