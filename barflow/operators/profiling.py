"""Feature profiles and the choice of a bar configuration by the feasibility of conditions (see ``conditions``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import column_quantiles

EPS = 1e-12
SPARSE_RATE = 0.005

# Name fragments that mark features suited to thresholds.
HINT_PATTERNS = ("zscore", "ratio", "position", "width", "bandwidth", "velocity", "intensity", "imbalance", "distance", "progress", "wick", "delta", "cvd",
                 "volume", "range", "pctb")


RANKS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def column_profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows, nulls, non-zero rate, quantiles and kind of each numeric column per key; ``df`` is read three times."""
    s = column_quantiles(df, keys, columns, RANKS, lambda value, x: {
        "row_count": F.count(F.lit(1)), "null_count": F.count_if(value.isNull()), "finite_count": F.count(x), "nonzero_count": F.count_if(F.abs(x) > EPS),
        "_other": F.count_if(~x.isin(0.0, 1.0)), "_lo": F.min(x), "_hi": F.max(x)})
    s = s.where("row_count > 0").withColumns({"null_rate": F.col("null_count") / F.col("row_count"),
                                              "nonzero_rate": F.expr("if(finite_count > 0, nonzero_count / finite_count, 0D)")})
    kind = F.expr(f"""case when finite_count = 0 then 'all_null' when nonzero_count = 0 then 'constant_zero'
        when _other = 0 and nonzero_rate <= {SPARSE_RATE} then 'binary_sparse' when nonzero_rate <= {SPARSE_RATE} then 'sparse'
        when _hi - _lo <= {EPS} then 'constant' when _other = 0 then 'binary_active' else 'variable' end""")
    return s.withColumn("kind", kind).drop("_other", "_lo", "_hi")


def sample_spread(df: DataFrame, keys: list[str], sample: str, columns: list[str]) -> DataFrame:
    """Range over samples of each column's p10, p50 and p90; columns without finite values have no row."""
    q = column_quantiles(df, [*keys, sample], columns, RANKS).where("p50 is not null")
    return q.groupBy(*keys, "column_name").agg(*[f(p).alias(f"{p}_{n}") for p in RANKS for n, f in (("min", F.min), ("max", F.max))])


def dead_and_sparse(profile: DataFrame) -> DataFrame:
    return profile.withColumn("group", F.expr("""case when kind in ('all_null', 'constant_zero') then 'dead'
        when kind in ('binary_sparse', 'sparse') then 'sparse' end""")).filter(F.col("group").isNotNull())


def threshold_hints(profile: DataFrame, keys: list[str], top: int = 6, priority: list[str] = ()) -> DataFrame:
    """Columns worth a threshold, priority names first, then by score and spread."""
    usable = profile.filter(F.col("kind").isin("variable", "binary_active") & (F.abs(F.col("p90") - F.col("p10")) > EPS))
    named = F.lit(False)
    for frag in HINT_PATTERNS:
        named = named | F.contains(F.lower("column_name"), F.lit(frag))
    score = F.when(named, 4).otherwise(0) + F.when(F.col("kind") == "variable", 2).otherwise(0) + F.when(F.col("null_rate") == 0, 1).otherwise(0) + 1
    first = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]).cast("array<string>"), F.col("column_name")), F.lit(0)),
                       F.lit(1 << 30).cast("bigint"))
    u = usable.withColumns({"score": score, "spread": F.abs(F.col("p90") - F.col("p10")), "_f": first})
    w = Window.partitionBy(*keys).orderBy("_f", F.col("score").desc(), F.col("spread").desc(), F.lower("column_name"))
    return u.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(top)).drop("_f")


def choose_bar_config(feas: DataFrame, config: str = "bar_config", sample: str = "sample", target: float = 0.00175, requested: list[str] = ()) -> DataFrame:
    """Bar configurations ranked by how few samples fail and how close their signal rate is to the target.

    Empty samples and samples without context do not count; a configuration with no other samples comes last.  Ties follow
    the requested order, then the name.
    """
    one = feas.dropDuplicates([config, sample])
    counts = ~F.col("status").isin("empty_sample", "context_unavailable")
    bad = counts & (F.col("status") != "ok")
    known = F.col("status").isin("dead_feature_primary", "zero_signal", "over_signal")
    gap = F.when(F.col("status") == "ok", F.abs(F.col("combined_count") / F.col("total_count") - float(target)))
    g = one.groupBy(config).agg(
        F.count_if(counts).alias("with_data"), F.count_if(F.col("status") == "dead_feature_primary").alias("dead"), F.count_if(bad & ~known).alias("other"),
        F.count_if(bad).alias("failing"), F.count_if(F.col("status") == "zero_signal").alias("zero"), F.count_if(F.col("status") == "over_signal").alias("over"),
        F.avg(gap).alias("distance"), F.min(gap).alias("best_distance"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in requested]).cast("array<string>"), F.col(config)), F.lit(0)), F.lit(1 << 30).cast("bigint"))
    w = Window.partitionBy(F.lit(0)).orderBy((F.col("with_data") == 0).cast("int"), "dead", "other", "failing", "zero", "over",
                                             F.col("distance").asc_nulls_last(), F.col("best_distance").asc_nulls_last(), place, config)
    return g.withColumn("rank", F.row_number().over(w))
