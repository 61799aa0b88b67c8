"""Shared window specs and rolling helpers.

Two scopes exist.  ``session_window`` restarts at every US/Eastern session; ``context_window`` runs
over a target day and the few days before it (see ``plans.context``).  All operators share them so
that Catalyst plans one exchange and one sort per scope however many columns are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EASTERN = "America/New_York"
CONTEXT_KEYS = ["symbol", "target_date"]
BAR_ORDER = ["ts_event", "seq"]


def session_window() -> WindowSpec:
    return Window.partitionBy("symbol", "session_date").orderBy(*BAR_ORDER)


def context_window() -> WindowSpec:
    return Window.partitionBy(*CONTEXT_KEYS).orderBy(*BAR_ORDER)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(int(n) - 1), 0)


def prior_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-int(n), -1)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def bar_index(w: WindowSpec) -> Column:
    """Zero-based position of the bar in its scope."""
    return F.row_number().over(w) - 1


def rolling(agg, value: Column, w: WindowSpec, n: int, min_rows: int = 1) -> Column:
    """``agg(value)`` over the last ``n`` rows, null until ``min_rows`` non-null values are in the frame."""
    frame = last_n(w, n)
    out = agg(value).over(frame)
    if min_rows <= 1:
        return out
    return F.when(F.count(value).over(frame) >= min_rows, out)


def rolling_corr(a: Column, b: Column, w: WindowSpec, n: int, min_rows: int) -> Column:
    """Pearson correlation of the pairs where both sides exist; undefined correlation is null."""
    both = a.isNotNull() & b.isNotNull()
    frame = last_n(w, n)
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)
    enough = F.count(x).over(frame) >= min_rows
    return F.when(enough & (spread > 0), F.covar_samp(x, y).over(frame) / spread)


def nearest_quantile(value: Column, frame: WindowSpec, q: float, min_rows: int = 1) -> Column:
    """Quantile that returns an existing element: index ``round(q * (n - 1))`` of the sorted frame."""
    ordered = F.sort_array(F.collect_list(value).over(frame))
    n = F.size(ordered)
    pick = F.element_at(ordered, (F.floor(F.lit(q) * (n - 1) + 0.5) + 1).cast("int"))
    return F.when(n >= max(min_rows, 1), pick)


def rolling_median(value: Column, w: WindowSpec, n: int) -> Column:
    return F.percentile(value, F.lit(0.5)).over(last_n(w, n))


def zscore(value: Column, w: WindowSpec, n: int, min_rows: int = 2, eps: float = 0.0,
           null_when_undefined: bool = False, mean_min_rows: int | None = None) -> Column:
    """Rolling z-score.  A flat window gives 0; a window that is too short gives 0 or, on request, null."""
    mean = rolling(F.avg, value, w, n, min_rows if mean_min_rows is None else mean_min_rows)
    std = rolling(F.stddev_samp, value, w, n, max(min_rows, 2))
    score = F.when(std > eps, (value - mean) / std)
    if null_when_undefined:
        return F.when(std.isNull(), None).otherwise(F.coalesce(score, F.when(std.isNotNull() & ~(std > eps), 0.0)))
    return F.when(std > eps, (value - mean) / std).otherwise(0.0)


def eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, EASTERN)


def eastern_date(ts: Column) -> Column:
    return F.to_date(eastern(ts))


def eastern_minute(ts: Column) -> Column:
    """Minute of the US/Eastern day, 0..1439."""
    et = eastern(ts)
    return F.hour(et) * 60 + F.minute(et)


def finite(value: Column) -> Column:
    """Null instead of NaN or an infinity."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


EWM_BLOCK = 256
#: Powers of ten that the weights of one block may span.
MOST_DECADES = 200


def with_ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]], keys: list[str], order: list[str],
             block: int = EWM_BLOCK) -> DataFrame:
    """Exponentially weighted means ``s = (1-a)*s + a*x`` seeded by the first non-null value.

    ``specs`` maps output name to ``(input column, alpha, min_rows)``; an input may have nulls only
    before its first value.  The recurrence is linear, so it is evaluated as a two-level scan: a
    running weighted sum inside blocks of ``block`` rows, plus the decayed ends of earlier blocks.
    Blocks are shorter for an ``a`` near 1, so weights stay in a range doubles can hold; the result is exact, and no row leaves the JVM.
    With ``a = 1`` the mean is the input itself.
    """
    if any(not 0 < a <= 1 for _, a, _ in specs.values()):
        raise ValueError("alpha must lie in (0, 1]")
    plain = {out: s for out, s in specs.items() if s[1] == 1}
    if plain:
        seen = running(Window.partitionBy(*keys).orderBy(*order))
        df = df.withColumns({out: F.when(F.count(F.col(c)).over(seen) >= need, F.col(c)) for out, (c, _, need) in plain.items()})
        specs = {out: s for out, s in specs.items() if s[1] != 1}
        if not specs:
            return df
    block = min([block, *[max(1, int(1 + MOST_DECADES * math.log(10) / -math.log1p(-a))) for _, a, _ in specs.values()]])
    w = Window.partitionBy(*keys).orderBy(*order)
    wb = Window.partitionBy(*keys, "_blk").orderBy(*order)
    inputs = dict.fromkeys(s[0] for s in specs.values())
    pos = F.row_number().over(w) - 1
    df = df.withColumns({
        "_blk": F.call_function("div", pos, F.lit(block)), "_off": pos % block,
        **{f"_seen_{c}": F.count(F.col(c)).over(running(w)) for c in inputs},
    })
    local = {}
    for out, (c, a, _) in specs.items():
        unit = F.expr(f"case when {c} is null then 0D when _seen_{c} = 1 then {c} else {c} * {a!r}D end")
        grow, shrink = F.expr(f"pow({1.0 - a!r}D, -_off)"), F.expr(f"pow({1.0 - a!r}D, _off)")
        local[f"_l_{out}"] = F.sum(unit * grow).over(running(wb)) * shrink
    df = df.withColumns(local)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        f"_e_{out}": F.collect_list(F.expr(f"if(_off = {block - 1}, _l_{out}, null)")).over(earlier) for out in specs})
    df = df.withColumns({out: F.expr(
        f"if(_seen_{c} >= {need}, _l_{out} + pow({1.0 - a!r}D, _off + 1) * "
        f"aggregate(_e_{out}, 0D, (t, e) -> t * {(1.0 - a) ** block!r}D + e), null)")
        for out, (c, a, need) in specs.items()})
    scratch = ["_blk", "_off"] + [f"_seen_{c}" for c in inputs] + [p + o for p in ("_l_", "_e_") for o in specs]
    return df.drop(*scratch)
