"""Volume-profile statistics as SQL over a level array.

A profile is ``array<struct<level bigint, vol double>>`` sorted by level.  Everything is built from
higher-order functions, so profiles are evaluated row by row inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_profile_stats(df: DataFrame, arr: str, prefix: str, share: float, tick: float) -> DataFrame:
    """Add ``<prefix>_{poc,va_high,va_low,skew,kurt,hvn,lvn}`` for the profile in column ``arr``.

    The value area grows from the point of control, each step taking the larger neighbour (the upper
    one on ties) until ``share`` of the volume is inside; hvn/lvn are arrays of strict local extremes.
    """
    a, n = arr, f"size({arr})"
    df = df.withColumns({f"{prefix}_total": F.expr(f"aggregate({a}, 0D, (t, x) -> t + x.vol)"),
                         f"{prefix}_vols": F.expr(f"transform({a}, x -> x.vol)")})
    df = df.withColumn(f"{prefix}_at", F.expr(f"cast(array_position({prefix}_vols, array_max({prefix}_vols)) as int)"))
    df = df.withColumn(f"{prefix}_pl", F.expr(f"element_at({a}, {prefix}_at).level"))
    # Raw moments about the point of control, which lies inside the profile, so central moments keep their digits.
    d = f"(x.level - {prefix}_pl)"
    df = df.withColumn(f"{prefix}_s", F.expr(
        f"if({prefix}_total > 0, aggregate({a}, named_struct('a', 0D, 'b', 0D, 'c', 0D, 'd', 0D), (t, x) -> named_struct("
        f"'a', t.a + x.vol * {d}, 'b', t.b + x.vol * {d} * {d}, 'c', t.c + x.vol * {d} * {d} * {d}, "
        f"'d', t.d + x.vol * {d} * {d} * {d} * {d})), null)"))
    df = df.withColumns({f"{prefix}_m{k}": F.expr(f"{prefix}_s.{n} / {prefix}_total") for k, n in enumerate("abcd", 1)})
    df = df.withColumn(f"{prefix}_var", F.expr(f"{prefix}_m2 - {prefix}_m1 * {prefix}_m1"))
    lo_vol = f"if(s.lo > 1, element_at({a}, s.lo - 1).vol, -1D)"
    hi_vol = f"if(s.hi < {n}, element_at({a}, s.hi + 1).vol, -1D)"
    step = f"""if(s.v >= {share}D * {prefix}_total, s, if({hi_vol} >= {lo_vol},
        named_struct('lo', s.lo, 'hi', s.hi + 1, 'v', s.v + {hi_vol}),
        named_struct('lo', s.lo - 1, 'hi', s.hi, 'v', s.v + {lo_vol})))"""
    start = f"named_struct('lo', {prefix}_at, 'hi', {prefix}_at, 'v', element_at({a}, {prefix}_at).vol)"
    m = [f"{prefix}_m{k}" for k in range(1, 5)]
    third = f"({m[2]} - 3 * {m[0]} * {m[1]} + 2 * pow({m[0]}, 3))"
    fourth = f"({m[3]} - 4 * {m[0]} * {m[2]} + 6 * {m[0]} * {m[0]} * {m[1]} - 3 * pow({m[0]}, 4))"

    def extremes(op: str) -> str:
        return (f"transform(filter({a}, (x, i) -> i > 0 and i < {n} - 1 and x.vol {op} element_at({a}, i).vol "
                f"and x.vol {op} element_at({a}, i + 2).vol), x -> x.level * {tick}D)")

    df = df.withColumn(f"{prefix}_va", F.expr(
        f"if({prefix}_total > 0, aggregate(slice({a}, 2, {n}), {start}, (s, x) -> {step}), null)"))
    return df.withColumns({
        f"{prefix}_poc": F.expr(f"if({prefix}_total > 0, element_at({a}, {prefix}_at).level * {tick}D, null)"),
        f"{prefix}_va_high": F.expr(f"if({prefix}_total > 0, element_at({a}, {prefix}_va.hi).level * {tick}D, null)"),
        f"{prefix}_va_low": F.expr(f"if({prefix}_total > 0, element_at({a}, {prefix}_va.lo).level * {tick}D, null)"),
        f"{prefix}_skew": F.expr(f"if({prefix}_total is null or {prefix}_total <= 0, null, "
                                 f"if({prefix}_var > 0, {third} / pow({prefix}_var, 1.5), 0D))"),
        f"{prefix}_kurt": F.expr(f"if({prefix}_total is null or {prefix}_total <= 0, null, "
                                 f"if({prefix}_var > 0, {fourth} / ({prefix}_var * {prefix}_var), 0D))"),
        f"{prefix}_hvn": F.expr(extremes(">")),
        f"{prefix}_lvn": F.expr(extremes("<")),
    }).drop(*[f"{prefix}_{c}" for c in ("vols", "at", "pl", "s", "m1", "m2", "m3", "m4", "var", "va")])
