"""Exact quantiles of unbounded groups.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer.  Here values are
first counted, then cut into ordered buckets; only bucket totals are accumulated per group and ranks
are resolved inside single buckets, so a group may be as large as the table.  Buckets are equally wide
in sign(z) * log1p(abs(z)), z being the distance from the middle in interquartile ranges (both from a
sketch): outliers do not press the other values into one bucket, and log1p is semi-monotonic, so
buckets keep the order of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import stored


def _flat(v: Column) -> Column:
    z = (v - F.col("_mid")) / F.col("_w")
    return F.signum(z) * F.log1p(F.abs(z))


def bucketed(df: DataFrame, keys: list[str], value: str, buckets: int = 1024) -> DataFrame:
    """(keys, _v, _n, _t, _b): finite values with their counts, the group's rows and an ordered bucket."""
    v = F.col(value).cast("double")
    ok = df.select(*keys, v.alias("_v")).filter(~F.isnan("_v") & (F.abs("_v") < float("inf")))
    counts = ok.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_t"),
                                     F.percentile_approx("_v", [0.25, 0.5, 0.75], 1000).alias("_q"))
    width = F.expr("case when _q[2] > _q[0] then _q[2] - _q[0] when _hi > _lo then _hi - _lo else 1D end")
    span = span.select(*keys, "_t", F.col("_q")[1].alias("_mid"), width.alias("_w"), "_lo", "_hi")
    span = span.withColumns({f"_u{n}": _flat(F.col(n)) for n in ("_lo", "_hi")}).drop("_lo", "_hi")
    if keys:
        cond = [counts[k].eqNullSafe(span[k]) for k in keys]
        c = counts.join(span, cond).select(counts["*"], "_t", "_mid", "_w", "_u_lo", "_u_hi")
    else:
        # Without keys the span is a single row, whatever the data.
        c = counts.withColumn("_one", F.lit(1)).join(
            F.broadcast(span.withColumn("_one", F.lit(1))), "_one").drop("_one")
    c = c.withColumn("_u", _flat(F.col("_v"))).withColumn(
        "_b", F.expr(f"if(_u_hi > _u_lo, least(floor((_u - _u_lo) / (_u_hi - _u_lo) * {buckets}), {buckets - 1}), 0)")).drop("_u", "_mid", "_w", "_u_lo", "_u_hi")
    return c


def _with_ends(c: DataFrame, keys: list[str]) -> DataFrame:
    """``c`` with ``_end``: how many values of its key lie at or before each counted value, from bucket totals and ranks inside buckets."""
    totals = c.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_bn").over(ahead), F.lit(0))).drop("_bn")
    cond = [c[k].eqNullSafe(totals[k]) for k in keys] + [c["_b"] == totals["_b"]]
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return c.join(totals, cond).select(c["*"], "_before").withColumn("_end", F.col("_before") + F.sum("_n").over(inside)).drop("_before")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int = 1024) -> DataFrame:
    """Linearly interpolated quantiles of the finite values per key; ``probs`` maps output name to probability."""
    c = bucketed(df, keys, value, buckets)
    r = _with_ends(c, keys)

    def at(rank: str):
        return F.max(F.expr(f"if(_end - _n <= {rank} and {rank} < _end, _v, null)"))

    cols = []
    for name, p in probs.items():
        h = f"({p!r}D * (_t - 1))"
        cols += [at(f"floor({h})").alias(f"_a_{name}"), at(f"ceil({h})").alias(f"_z_{name}")]
    g = r.groupBy(*keys).agg(F.max("_t").alias("_t"), *cols)
    return g.select(*keys, *[F.expr(f"_a_{n} + (_z_{n} - _a_{n}) * ({p!r}D * (_t - 1) - floor({p!r}D * (_t - 1)))").alias(n)
                             for n, p in probs.items()])


# --- many columns at once
def _finite(name: str) -> Column:
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]


def _aside(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k{n}" for n, k in enumerate(keys)})


def _block_summary(df: DataFrame, keys: list[str], columns: list[str], probs: dict[str, float], measures, accuracy: int, buckets: int) -> DataFrame:
    levels = list(probs.values())
    around = [min(max(p + d / accuracy, 0.0), 1.0) for p in levels for d in (-2, 2)]
    first = stored(df.groupBy(*keys).agg(*[F.struct(
        *[m.alias(n) for n, m in measures(F.col(f"`{c}`").cast("double"), _finite(c)).items()], F.count(_finite(c)).alias("_t"), F.min(_finite(c)).alias("_min"),
        F.max(_finite(c)).alias("_max"), F.percentile_approx(_finite(c), around, accuracy).alias("_q")).alias(f"_c{i}") for i, c in enumerate(columns)]), "column_sketches")

    # Second reading: how many values lie below each bracket and up to its end.  A bracket that misses its rank opens to the extreme.
    values = df.select(*keys, *[_finite(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    cells = [(i, j) for i in range(len(columns)) for j in range(len(levels))]
    edge = {(i, j): (F.col(f"_c{i}._q")[2 * j], F.col(f"_c{i}._q")[2 * j + 1]) for i, j in cells}
    counts = values.join(_aside(first, keys), _same(keys)).groupBy(*keys).agg(*[F.struct(
        F.count_if(F.col(f"_x{i}") < edge[i, j][0]).alias("below"), F.count_if(F.col(f"_x{i}") <= edge[i, j][1]).alias("upto")).alias(f"_n{i}_{j}") for i, j in cells])

    def bracket(i: int, j: int) -> Column:
        c, n, h = f"_c{i}", f"_n{i}_{j}", f"({levels[j]!r}D * (_c{i}._t - 1))"
        return F.expr(f"""named_struct('t', {c}._t, 'h', {h}, 'lo', if({n}.below <= floor({h}), {c}._q[{2 * j}], {c}._min), 'hi', if({n}.upto > ceil({h}), {c}._q[{2 * j + 1}], {c}._max),
            'before', if({n}.below <= floor({h}), {n}.below, 0L))""").alias(f"_e{i}_{j}")
    second = stored(counts.join(_aside(first, keys), _same(keys)).select(*keys, *[bracket(i, j) for i, j in cells]), "column_brackets")

    # Third reading: only values inside open brackets leave their row, and equal ones are counted before the shuffle.
    def inside(i: int, j: int) -> Column:
        e, x = f"_e{i}_{j}", F.col(f"_x{i}")
        return F.when((F.col(f"{e}.lo") < F.col(f"{e}.hi")) & x.between(F.col(f"{e}.lo"), F.col(f"{e}.hi")), F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), x.alias("_v")))
    picked = values.join(_aside(second, keys), _same(keys)).select(*keys, F.inline(F.array_compact(F.array(*[inside(i, j) for i, j in cells]))))
    cell = [*keys, "_i", "_j"]
    long = second.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"_e{i}_{j}").alias("_e")) for i, j in cells]))).where("_e.t > 0")
    c = picked.groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_n")).join(_aside(long, cell), _same(cell)).select(*cell, "_v", "_n", "_e")
    c = c.withColumn("_b", F.expr(f"least(floor((_v - _e.lo) / (_e.hi - _e.lo) * {buckets}), {buckets - 1})"))
    end = F.col("_e.before") + F.col("_end")

    def at(rank: str) -> Column:
        return F.max(F.when((end - F.col("_n") <= F.expr(rank)) & (F.expr(rank) < end), F.col("_v")))
    found = _with_ends(c, cell).groupBy(*cell).agg(F.first("_e.h").alias("_h"), at("floor(_e.h)").alias("_a"), at("ceil(_e.h)").alias("_z"))
    single = long.where("_e.lo = _e.hi").select(*cell, F.col("_e.h").alias("_h"), F.col("_e.lo").alias("_a"), F.col("_e.lo").alias("_z"))
    value = F.expr("_a + (_z - _a) * (_h - floor(_h))")
    found = found.unionByName(single).groupBy(*keys, "_i").agg(*[F.max(F.when(F.col("_j") == j, value)).alias(n) for j, n in enumerate(probs)])

    names = list(measures(F.lit(None), F.lit(None)))
    head = first.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(c).alias("column_name"), *[F.col(f"_c{i}.{n}").alias(n) for n in names])
                                                  for i, c in enumerate(columns)])))
    cell = [*keys, "_i"]
    return head.join(_aside(found, cell), _same(cell), "left").select(*keys, "column_name", *names, *probs)


def column_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: dict[str, float], measures=None, accuracy: int = 10000,
                     buckets: int = 1024, width: int = 32) -> DataFrame:
    """(keys, column_name, measures, probs): exact quantiles of the finite values of many columns, one row a key and column.

    ``df`` is read three times, so it should be a staged table; each reading covers ``width`` columns.  Sketches of all columns give
    a bracket around every wanted rank, exact counts tell how many values lie below it, and only the values inside brackets
    (about 4 / ``accuracy`` of a column) are shuffled, ranked in ``buckets`` ordered parts.  ``measures(value, finite)`` names further
    aggregates of each column, taken in the first reading.
    """
    measures = measures or (lambda value, finite: {})
    if not keys:
        one = column_quantiles(df.withColumn("_one", F.lit(1)), ["_one"], columns, probs, measures, accuracy, buckets, width)
        return one.drop("_one")
    blocks = [_block_summary(df, keys, columns[i:i + width], probs, measures, accuracy, buckets) for i in range(0, len(columns), width)]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out
