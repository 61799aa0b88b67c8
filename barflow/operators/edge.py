"""Conditional edge surface: horizon trades scored globally, by side and by market-context bucket.

Bars get their context labels and their round-trip cost once (``edge_inputs``), events the closes of the bars their horizons reach and the
cost of their fill bar (``edge_events``); both are staged, and everything else is made from the events by one expansion
of an event to the slices it belongs to.  A key's bars are one frame: costs roll over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.windows import eastern_minute
from ..sources.stage import stored
from .pnl import metrics, with_bar_cost
from .trades import entry_events, event_trades, with_day

# Context families, their source column and their three labels; default settings.
FAMILIES = {
    "vol_bucket": ("regime_vol_relative", ("low", "medium", "high")),
    "spread_bucket": ("spread_bps", ("tight", "normal", "wide")),
    "activity_bucket": ("trade_intensity", ("quiet", "normal", "active")),
    "direction_bucket": ("return_5bar", ("mean_revert", "neutral", "trend")),
}
CONFIG = {"enabled": False, "horizons": [1, 3, 5, 10, 20, 40, 60, 90], "min_events": 60, "min_pocket_events": 30, "min_positive_horizons": 1,
          "min_avg_trade_pnl": 0.0, "min_positive_day_fraction": 0.52, "max_day_concentration": 0.40, "max_best_pockets": 5}


def normalize_config(config: dict | None) -> dict:
    """Settings with defaults filled in: distinct rising horizons of at least one bar, and pockets of no more events than the whole needs."""
    c = {**CONFIG, **(config or {})}
    raw = c["horizons"] if isinstance(c["horizons"], (list, tuple)) else CONFIG["horizons"]
    least = max(1, int(c["min_events"]))
    return {"enabled": bool(c["enabled"]), "horizons": sorted({max(1, int(h)) for h in raw if h is not None}) or list(CONFIG["horizons"]), "min_events": least,
            "min_pocket_events": min(max(1, int(c["min_pocket_events"])), least), "min_positive_horizons": max(1, int(c["min_positive_horizons"])),
            **{k: float(c[k]) for k in ("min_avg_trade_pnl", "min_positive_day_fraction", "max_day_concentration")}, "max_best_pockets": max(1, int(c["max_best_pockets"]))}


def tercile_thresholds(bars: DataFrame, columns: list[str]) -> DataFrame:
    """One row per usable column: lower and upper tercile over all rows; columns without variation are left out."""
    present = [c for c in columns if c in bars.columns]
    long = bars.select(*[F.col(c).cast("double").alias(c) for c in present]).unpivot([], present, "column_name", "value")
    n = long.filter(~F.isnan("value")).groupBy("column_name").agg(F.count("value").alias("n"))
    q = exact_quantiles(long, ["column_name"], "value", {"lower": 1.0 / 3.0, "upper": 2.0 / 3.0})
    return q.join(n, "column_name").filter("n >= 3 and upper > lower").select("column_name", "lower", "upper")


def session_bucket(ts):
    m = eastern_minute(ts)
    return (F.when(m < 180, "eth_overnight").when(m < 570, "london").when(m < 660, "rth_open").when(m < 900, "rth_midday")
            .when(m < 960, "power_hour").otherwise("eth_overnight"))


def value_area_bucket(position):
    return F.when(position < 0.0, "below_value").when(position > 1.0, "above_value").when(position.isNotNull() & ~F.isnan(position), "inside_value")


def with_buckets(bars: DataFrame, families: dict = FAMILIES) -> DataFrame:
    """Add one label column per family; a family whose column is missing or flat is null throughout."""
    df = bars.withColumn("session_bucket", session_bucket(F.col("ts_event")))
    if "position_in_va" in bars.columns:
        df = df.withColumn("value_area_bucket", value_area_bucket(F.col("position_in_va")))
    used = {f: v for f, v in families.items() if v[0] in bars.columns}
    if not used:
        return df
    # The threshold table has one row with a map of at most four entries: its size does not depend on the data.
    t = tercile_thresholds(bars, [c for c, _ in used.values()]).agg(F.map_from_entries(F.collect_list(
        F.struct("column_name", F.struct("lower", "upper")))).alias("_t"))
    df = df.withColumn("_k", F.lit(1)).join(F.broadcast(t.withColumn("_k", F.lit(1))), "_k").drop("_k")
    for fam, (col, (lo, mid, hi)) in used.items():
        x, cut = F.col(col).cast("double"), F.col("_t")[col]
        known = cut.isNotNull() & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        df = df.withColumn(fam, F.when(known, F.when(x <= cut["lower"], lo).when(x < cut["upper"], mid).otherwise(hi)))
    return df.drop("_t")


def slices_of(df: DataFrame, families: list[str]) -> DataFrame:
    """Each row once per slice it belongs to: global, its side and its label in every family."""
    parts = [F.struct(F.lit("global").alias("family"), F.lit("all").alias("label")),
             F.struct(F.lit("side").alias("family"), F.when(F.col("direction") > 0, "long").otherwise("short").alias("label"))]
    parts += [F.struct(F.lit(f).alias("family"), F.col(f).alias("label")) for f in families]
    return df.withColumn("_s", F.explode(F.array(*parts))).withColumns({"family": F.col("_s.family"), "label": F.col("_s.label")}).drop(
        "_s").filter(F.col("label").isNotNull())


def omitted_families(bars: DataFrame, families: dict = FAMILIES) -> DataFrame:
    """(family, reason, column) of the families that give no labels: their column is absent, or too few values differ."""
    spark = bars.sparkSession
    absent = [(f, "missing_column", c) for f, (c, _) in [*families.items(), ("value_area_bucket", ("position_in_va", ()))] if c not in bars.columns]
    out = spark.createDataFrame(absent, "family string, reason string, column string")
    used = [(f, "insufficient_variation", c) for f, (c, _) in families.items() if c in bars.columns]
    if not used:
        return out
    known = tercile_thresholds(bars, [c for _, _, c in used]).select(F.col("column_name").alias("column"))
    return out.unionByName(spark.createDataFrame(used, out.schema).join(known, "column", "left_anti"))


def edge_inputs(bars: DataFrame, keys: list[str], params: dict | None = None) -> DataFrame:
    """Staged bars with context labels and ``bar_cost``; of bars that share a time all have the last one's cost, as known then."""
    families = ["session_bucket", "value_area_bucket", *FAMILIES]
    df = with_bar_cost(with_buckets(bars), keys, params)
    df = df.withColumn("bar_cost", F.max_by("bar_cost", "seq").over(Window.partitionBy(*keys, "ts_event")))
    used = [*keys, "ts_event", "seq", "open", "close", "signal", *[c for c in families if c in df.columns], "bar_cost"]
    return stored(with_day(df.select(*used)), "edge_bars")


def edge_events(inputs: DataFrame, keys: list[str], next_open: bool = True, config: dict | None = None) -> DataFrame:
    """Staged entry events of ``edge_inputs`` with labels, the fill bar's cost and the bars that the horizons reach."""
    families = [c for c in inputs.columns if c.endswith("_bucket")]
    return stored(entry_events(inputs, keys, next_open, families, normalize_config(config)["horizons"], ["bar_cost"]), "edge_events")


def edge_slices(inputs: DataFrame, events: DataFrame, keys: list[str], config: dict | None = None) -> DataFrame:
    """(keys, family, label, base_event_count, enough): the whole and both sides of every key, and every label that an event has.

    Keys with fewer than ``min_events`` events have their whole alone, as no slice of them is scored.
    """
    c = normalize_config(config)
    families = [n for n in events.columns if n.endswith("_bucket")]
    counts = slices_of(events, families).groupBy(*keys, "family", "label").agg(F.count(F.lit(1)).alias("n"))
    fixed = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(v).alias("label")) for f, v in (("global", "all"), ("side", "long"), ("side", "short"))]))
    spine = inputs.select(*keys).distinct().select(*keys, fixed.alias("_s")).select(*keys, "_s.family", "_s.label", F.lit(0).cast("bigint").alias("n"))
    every = spine.unionByName(counts).groupBy(*keys, "family", "label").agg(F.sum("n").alias("base_event_count"))
    whole = F.max(F.when(F.col("family") == "global", F.col("base_event_count"))).over(Window.partitionBy(*keys))
    return every.withColumn("enough", whole >= c["min_events"]).filter((F.col("family") == "global") | F.col("enough"))


def edge_population(slices: DataFrame, events: DataFrame, keys: list[str], config: dict | None = None, params: dict | None = None) -> DataFrame:
    """Scores of each (slice, horizon) at adaptive costs and whether it passes; a horizon without trades has a row of zeros."""
    c = normalize_config(config)
    families = [n for n in events.columns if n.endswith("_bucket")]
    trades = event_trades(events, [*keys, *families, "bar_cost"]).withColumnRenamed("bar_cost", "adaptive_cost_rt")
    on = [*keys, "family", "label", "horizon_bars"]
    m = metrics(slices_of(trades, families), on, params=params)
    spine = slices.filter("enough").withColumn("horizon_bars", F.explode(F.array(*[F.lit(h) for h in c["horizons"]])))
    empty = {"trade_count": 0, "avg_trade_pnl": 0.0, "net_pnl": 0.0, "positive_day_fraction": 0.0, "max_day_concentration": 1.0}
    p = spine.join(m, on, "left").withColumn("sharpe_ratio", F.when(F.col("trade_count").isNull(), 0.0).otherwise(F.col("sharpe_ratio"))).na.fill(empty)
    need = F.when(F.col("family") == "global", c["min_events"]).otherwise(c["min_pocket_events"])
    ok = ((F.col("trade_count") >= need) & (F.col("avg_trade_pnl") > c["min_avg_trade_pnl"]) & (F.col("net_pnl") > 0)
          & (F.col("positive_day_fraction") >= c["min_positive_day_fraction"]) & (F.col("max_day_concentration") <= c["max_day_concentration"]))
    return p.select(*on, "trade_count", "avg_trade_pnl", "net_pnl", "sharpe_ratio", "positive_day_fraction",
                    "max_day_concentration", "long_avg_trade_pnl", "short_avg_trade_pnl", ok.alias("passed"))


def slice_summary(population: DataFrame, keys: list[str], config: dict | None = None) -> DataFrame:
    """Best horizon per slice and the slice verdict."""
    rank = Window.partitionBy(*keys, "family", "label").orderBy(
        F.col("passed").desc(), F.col("avg_trade_pnl").desc(), F.col("net_pnl").desc(), F.col("trade_count").desc(), "horizon_bars")
    p = population.withColumn("_r", F.row_number().over(rank))
    best = {c: F.max(F.when(F.col("_r") == 1, F.col(s))).alias(c) for c, s in (
        ("best_horizon_bars", "horizon_bars"), ("best_event_count", "trade_count"), ("best_avg_trade_pnl", "avg_trade_pnl"),
        ("best_positive_day_fraction", "positive_day_fraction"), ("best_max_day_concentration", "max_day_concentration"))}
    return p.groupBy(*keys, "family", "label").agg(F.count_if("passed").alias("positive_horizons"), *best.values()).withColumn(
        "passed", F.col("positive_horizons") >= normalize_config(config)["min_positive_horizons"])


def edge_surface(bars: DataFrame, keys: list[str], next_open: bool = True, config: dict | None = None, params: dict | None = None) -> DataFrame:
    """All slices of each key with event counts, best horizon and verdict."""
    inputs = edge_inputs(bars, keys, params)
    events = edge_events(inputs, keys, next_open, config)
    slices = stored(edge_slices(inputs, events, keys, config), "edge_slices")
    s = slice_summary(edge_population(slices, events, keys, config, params), keys, config)
    return slices.drop("enough").join(s, [*keys, "family", "label"], "left").withColumns({
        "positive_horizons": F.coalesce("positive_horizons", F.lit(0)), "passed": F.coalesce("passed", F.lit(False))})


def best_pockets(surface: DataFrame, keys: list[str], config: dict | None = None) -> DataFrame:
    """Passing context slices of each key, best first."""
    pockets = surface.filter(F.col("passed") & ~F.col("family").isin("global", "side"))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in ("best_avg_trade_pnl", "positive_horizons", "best_event_count", "family", "label")])
    return pockets.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= normalize_config(config)["max_best_pockets"])


def surface_status(surface: DataFrame, keys: list[str], config: dict | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(keys, event_count, status, passed, has_localized_edge); keys of ``wanted`` without bars have no data."""
    c, pocket = normalize_config(config), ~F.col("family").isin("global", "side")
    every = surface.select(*keys).distinct() if wanted is None else wanted.select(*keys).distinct()
    if not c["enabled"]:
        return every.withColumns({"event_count": F.lit(None).cast("bigint"), "status": F.lit("disabled"), "passed": F.lit(True), "has_localized_edge": F.lit(False)})
    g = surface.groupBy(*keys).agg(F.max(F.when(F.col("family") == "global", F.col("base_event_count"))).alias("event_count"),
                                   F.max(F.when(F.col("family") == "global", F.col("passed"))).alias("_g"),
                                   F.coalesce(F.max(F.when(pocket, F.col("passed"))), F.lit(False)).alias("has_localized_edge"))
    g = every.join(g, keys, "left")
    status = F.expr(f"""case when event_count is null then 'no_data' when event_count < {c['min_events']} then 'insufficient_events' when _g then 'global_edge'
        when has_localized_edge then 'localized_edge_only' else 'no_edge' end""")
    return g.withColumn("status", status).select(*keys, F.coalesce("event_count", F.lit(0)).alias("event_count"), "status", (F.col("status") == "global_edge").alias("passed"),
                                                 F.coalesce("has_localized_edge", F.lit(False)).alias("has_localized_edge"))
