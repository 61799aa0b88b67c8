"""Session, rolling and swing-anchored volume profiles per bar.

Each traded level of a bar is sent to the bars whose profile contains it.  A rolling profile has at
most 24 and a swing profile at most 31 owners per bar.  The expanding session profile carries one
running total per level, valid until that level trades again, so its size is bars x levels and not
bars squared.  Owners are spread by (symbol, session, bar), so a busy session is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import with_profile_stats
from ..functions.windows import bar_index, prior_n, rolling, running, session_window
from ..params import resolve

_KEYS = ["symbol", "session_date", "_idx"]
FLOAT_FEATURES = [
    "poc_price", "poc_distance", "poc_distance_raw", "va_high", "va_low", "va_width", "position_in_va", "vp_skew",
    "vp_kurtosis", "rolling_poc", "rolling_poc_distance", "poc_slope_6", "rolling_va_high", "rolling_va_low",
    "rolling_va_position", "vol_concentration", "rolling_vp_skew", "dist_nearest_hvn", "dist_nearest_lvn", "at_hvn",
    "at_lvn", "hvn_lvn_ratio", "swing_poc_dist", "swing_lvn_dist", "swing_hvn_dist", "swing_va_position",
    "breakout_direction", "bars_since_breakout",
]
COUNT_FEATURES = ["hvn_count", "rolling_hvn_count", "rolling_lvn_count"]


def swing_anchor(bars: DataFrame, params: dict | None = None) -> DataFrame:
    """Direction of the last channel breakout and the bars since it, restarting every session."""
    n, w = int(resolve(params)["swing_lookback"]), session_window()
    channel = prior_n(w, n)
    df = bars.withColumn("_idx", bar_index(w))
    broke = (F.when((F.col("_idx") >= n) & (F.col("close") > F.max("high").over(channel)), 1)
             .when((F.col("_idx") >= n) & (F.col("close") < F.min("low").over(channel)), -1))
    df = df.withColumn("_broke", broke).withColumn(
        "_dir", F.coalesce(F.last("_broke", ignorenulls=True).over(running(w)), F.lit(0)))
    falling = Window.partitionBy("symbol", "session_date").orderBy(F.col("ts_event").desc(), F.col("seq").desc())
    flips = F.col("_broke").isNotNull() & (F.col("_broke") != F.coalesce(F.lag("_dir").over(w), F.lit(0)))
    df = df.withColumn("_flip", F.when(flips, F.col("_idx")))
    return df.withColumns({
        "_anchor": F.last("_flip", ignorenulls=True).over(running(w)),
        "_next_flip": F.last("_flip", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, -1)),
        "_last_idx": F.max("_idx").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).withColumns({
        "breakout_direction": F.col("_dir").cast("double"),
        "bars_since_breakout": (F.col("_idx") - F.col("_anchor")).cast("double"),
    }).drop("_broke", "_dir", "_flip")


def _histograms(bars: DataFrame, p: dict) -> DataFrame:
    """(symbol, session, bar) -> three level arrays: session, rolling and swing profile."""
    tick, window, swing = float(p["tick_size"]), int(p["profile_window"]), int(p["swing_max_bars"])
    cells = bars.select(*_KEYS, "_anchor", "_next_flip", "_last_idx",
                        F.explode(F.arrays_zip("vap_prices", "vap_volumes")).alias("c")).select(
        *_KEYS, "_anchor", "_next_flip", "_last_idx", F.col("c.vap_volumes").cast("double").alias("vol"),
        F.col("c.vap_prices").alias("price"))
    cells = cells.filter("vol > 0 and not isnan(price) and abs(price) < double('Infinity')").withColumn(
        "level", F.round(F.col("price") / tick).cast("bigint"))
    by_level = Window.partitionBy("symbol", "session_date", "level").orderBy("_idx")
    through = F.coalesce(F.lead("_idx").over(by_level) - 1, F.col("_last_idx"))
    session = cells.groupBy(*_KEYS, "level").agg(F.sum("vol").alias("vol"), F.max("_last_idx").alias("_last_idx"))
    session = session.withColumns({"_through": through, "_cum": F.sum("vol").over(running(by_level))}).select(
        "symbol", "session_date", "level", F.lit("s").alias("kind"), F.col("_cum").alias("vol"),
        F.explode(F.sequence("_idx", "_through")).alias("_idx"))
    roll_end = F.least(F.col("_idx") + (window - 1), F.col("_last_idx"))
    rolling_ = cells.select("symbol", "session_date", "level", F.lit("r").alias("kind"), "vol",
                            F.explode(F.sequence("_idx", roll_end)).alias("_idx"))
    end = F.least(F.col("_anchor") + swing, F.coalesce(F.col("_next_flip") - 1, F.col("_last_idx")))
    swing_ = cells.filter(F.col("_anchor").isNotNull() & (F.col("_idx") <= F.col("_anchor") + swing)).select(
        "symbol", "session_date", "level", F.lit("w").alias("kind"), "vol",
        F.explode(F.sequence("_idx", end)).alias("_idx"))
    levels = session.unionByName(rolling_).unionByName(swing_).groupBy(*_KEYS, "kind", "level").agg(F.sum("vol").alias("vol"))
    # Evaluating profiles is CPU-bound on little data: a fixed partition count keeps AQE from merging it into few tasks.
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = levels.repartition(parts, *_KEYS)

    def profile(kind: str):
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("level", "vol")))).alias(f"_{kind}")

    return levels.groupBy(*_KEYS).agg(profile("s"), profile("r"), profile("w"))


def volume_profile(bars: DataFrame, params: dict | None = None) -> DataFrame:
    p = resolve(params)
    if "vap_prices" not in bars.columns or "vap_volumes" not in bars.columns:
        return bars.withColumns({**{c: F.lit(None).cast("double") for c in FLOAT_FEATURES},
                                 **{c: F.lit(0) for c in COUNT_FEATURES}})
    w, share, tick, near = session_window(), float(p["value_area_share"]), float(p["tick_size"]), float(p["proximity_atr"])
    prev = F.lag("close").over(w)
    marked = swing_anchor(bars, params)
    profiles = _histograms(marked, p)
    for kind in ("s", "r", "w"):
        profiles = with_profile_stats(profiles, f"_{kind}", f"_{kind}", share, tick)
    df = marked.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                                             F.abs(F.col("low") - prev)))
    df = df.withColumn("_atr", rolling(F.avg, F.col("_tr"), w, 14)).withColumn(
        "_atr", F.greatest(F.coalesce("_atr", F.lit(1e-9)), F.lit(1e-9)))
    df = df.join(profiles, _KEYS, "left")

    def position(lo: str, hi: str, missing: str) -> str:
        return f"case when {hi} is null then {missing} when {hi} - {lo} < 1e-9 then 0.5D else (close - {lo}) / ({hi} - {lo}) end"

    def nearest(nodes: str) -> str:
        return f"array_min(transform({nodes}, x -> abs(close - x))) / _atr"

    inside = f"aggregate(_r, 0D, (t, x) -> t + if(abs(x.level * {tick}D - _r_poc) <= {near}D * _atr, x.vol, 0D))"
    df = df.withColumns({k: F.expr(v) for k, v in {
        "poc_price": "_s_poc", "va_high": "_s_va_high", "va_low": "_s_va_low",
        "vp_skew": "_s_skew", "vp_kurtosis": "_s_kurt", "hvn_count": "coalesce(size(_s_hvn), 0)",
        "poc_distance_raw": "close - _s_poc", "poc_distance": "(close - _s_poc) / _atr",
        "va_width": "(_s_va_high - _s_va_low) / if(close = 0, 1e-9D, close)",
        "position_in_va": position("_s_va_low", "_s_va_high", "0.5D"),
        "rolling_poc": "_r_poc", "rolling_va_high": "_r_va_high", "rolling_va_low": "_r_va_low",
        "rolling_vp_skew": "_r_skew", "rolling_poc_distance": "(close - _r_poc) / _atr",
        "rolling_va_position": position("_r_va_low", "_r_va_high", "0.5D"),
        "rolling_hvn_count": "coalesce(size(_r_hvn), 0)", "rolling_lvn_count": "coalesce(size(_r_lvn), 0)",
        "hvn_lvn_ratio": "if(_r_poc is null, null, size(_r_hvn) / (size(_r_lvn) + 1))",
        "dist_nearest_hvn": nearest("_r_hvn"), "dist_nearest_lvn": nearest("_r_lvn"),
        "at_hvn": f"if({nearest('_r_hvn')} < {near}, 1D, 0D)", "at_lvn": f"if({nearest('_r_lvn')} < {near}, 1D, 0D)",
        "vol_concentration": f"{inside} / _r_total",
        "swing_poc_dist": "(close - _w_poc) / _atr", "swing_lvn_dist": nearest("_w_lvn"), "swing_hvn_dist": nearest("_w_hvn"),
        "swing_va_position": position("_w_va_low", "_w_va_high", "null"),
    }.items()})
    df = df.withColumn("poc_slope_6", (F.col("rolling_poc") - F.lag("rolling_poc", 6).over(w)) / F.col("_atr"))
    return df.drop(*[c for c in df.columns if c.startswith("_")])
