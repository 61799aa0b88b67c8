"""Partitioned stores of bars and feature matrices, reuse by signature, result sinks and day samples."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import BAR_COLUMNS

PARTITIONS = ["session", "bar_config", "sig", "date"]
#: The manifest stands beside the store's folder, so that a scan of the store holds bars only.
NOTES = "_manifest"


def signature(version: str, params: dict) -> str:
    """Identity of the code version and parameters a stored partition was built with."""
    return hashlib.sha256(f"{version}|{json.dumps(params, sort_keys=True)}".encode()).hexdigest()[:16]


MANIFEST = "session string, bar_config string, sig string, date date, columns string, row_count bigint, build string"


def write_partitions(df: DataFrame, path: str, session: str, bar_config: str, sig: str, required: list[str] = (), days: list | None = None) -> None:
    """Store one (session, config, signature) slice by day; a day that is rebuilt replaces itself only.

    The manifest beside the store gets one row per day only after its rows are written: columns, number of rows, and the build's id.  A day without a
    manifest row is not stored, whatever files there are.  ``days`` names the days that were built; those without rows are noted as empty.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df.withColumns({"session": F.lit(session), "bar_config": F.lit(bar_config), "sig": F.lit(sig), "date": F.col("session_date")})
    (out.repartition("date", "symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path))
    commit_days(df.sparkSession, path, session, bar_config, sig, [c for c in df.columns if c != "session_date"], days)


def commit_days(spark: SparkSession, path: str, session: str, bar_config: str, sig: str, columns: list[str], days: list | None = None) -> None:
    """Note the stored days of a slice with their rows as read back, and ``days`` without rows as empty; later notes of a day count."""
    rows = _files(spark, path)
    slice_ = F.lit(True) if rows is None else (F.col("session") == session) & (F.col("bar_config") == bar_config) & (F.col("sig") == sig)
    found = spark.createDataFrame([], "date date, row_count bigint") if rows is None else rows.filter(slice_).groupBy("date").agg(F.count(F.lit(1)).alias("row_count"))
    if days is not None:
        wanted = spark.createDataFrame([(d,) for d in days], "date date")
        found = wanted.join(found, "date", "left").select("date", F.coalesce("row_count", F.lit(0)).alias("row_count"))
    build = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    note = found.select(F.lit(session).alias("session"), F.lit(bar_config).alias("bar_config"), F.lit(sig).alias("sig"), "date",
                        F.lit(",".join(sorted(columns))).alias("columns"), F.col("row_count").cast("bigint").alias("row_count"), F.lit(build).alias("build"))
    note.coalesce(1).write.mode("append").parquet(f"{path}{NOTES}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last note of each (session, bar_config, sig, date) of a store."""
    try:
        notes = spark.read.schema(MANIFEST).parquet(f"{path}{NOTES}")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    last = notes.groupBy(*PARTITIONS).agg(F.max(F.struct("build", "columns", "row_count")).alias("n"))
    return last.select(*PARTITIONS, "n.columns", "n.row_count", "n.build")


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_bars(bars: DataFrame, path: str, session: str, bar_config: str, sig: str) -> None:
    """Store exactly the bar schema."""
    keep = ["symbol", "session_date", "seq", *BAR_COLUMNS]
    write_partitions(bars.select(*[c for c in keep if c in bars.columns]), path, session, bar_config, sig, BAR_COLUMNS)


def read_partitions(spark: SparkSession, path: str, session: str, bar_config: str, sig: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).filter((F.col("session") == session) & (F.col("bar_config") == bar_config) & (F.col("sig") == sig))


def missing_partitions(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Requested (session, bar_config, sig, date) rows that are not stored yet."""
    return wanted.join(present.select(*PARTITIONS).distinct(), PARTITIONS, "left_anti")


def stored_partitions(spark: SparkSession, path: str, required: list[str] = (), check_rows: bool = False) -> DataFrame:
    """(session, bar_config, sig, date, row_count) of the days that a store holds whole: noted in the manifest, with all ``required`` columns.

    With ``check_rows`` the rows of each day are counted too, and a day that has lost or gained rows since its note is not whole.
    """
    noted = manifest(spark, path)
    if required:
        noted = noted.filter(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.split("columns", ","))) == 0)
    noted = noted.select(*PARTITIONS, "row_count")
    rows = _files(spark, path) if check_rows else None
    if rows is None:
        return noted.filter("row_count = 0") if check_rows else noted
    seen = rows.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("_n"))
    return noted.join(seen, PARTITIONS, "left").filter("row_count = coalesce(_n, 0)").drop("_n")


def load_or_build(spark: SparkSession, path: str, wanted: DataFrame, build: Callable[[list, str, str], DataFrame], sig: str, required: list[str] = (),
                  check_rows: bool = False) -> DataFrame:
    """Build the wanted (session, bar_config, date) rows that are not stored whole under ``sig`` yet; gives the report of what was built.

    ``build(days, session, bar_config)`` returns rows with ``session_date``; only the missing days of its result are kept, and days without rows
    are noted as empty, so they are built once and are no error.  A day that lacks a ``required`` column, or whose writing did not reach its
    note, is built again.  The days of one slice (a calendar) are all that the driver sees.
    """
    want = wanted.withColumn("sig", F.lit(sig)).select(*PARTITIONS).distinct()
    missing = missing_partitions(want, stored_partitions(spark, path, required, check_rows)).groupBy("session", "bar_config").agg(F.array_sort(F.collect_set("date")).alias("days")).collect()
    for r in missing:
        rows = build(list(r.days), r.session, r.bar_config).filter(F.col("session_date").isin(list(r.days)))
        write_partitions(rows, path, r.session, r.bar_config, sig, required, list(r.days))
    built = spark.createDataFrame([(r.session, r.bar_config, sig, d) for r in missing for d in r.days], "session string, bar_config string, sig string, date date")
    return build_report(built.select(*PARTITIONS), stored_partitions(spark, path, required, check_rows), ["session", "bar_config"])


def build_report(wanted: DataFrame, built: DataFrame, keys: list[str]) -> DataFrame:
    """Requested, completed and failed partitions of a bulk build per key, and how many of the completed ones are empty."""
    rows = F.col("row_count") if "row_count" in built.columns else F.lit(1).cast("bigint")
    done = built.select(*PARTITIONS, rows.alias("_rows")).groupBy(*PARTITIONS).agg(F.max("_rows").alias("_rows"))
    return wanted.join(done, PARTITIONS, "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count("_rows").alias("completed"), F.count_if(F.col("_rows").isNull()).alias("errors"), F.count_if(F.col("_rows") == 0).alias("empty"))


def write_results(signals: DataFrame, trades: DataFrame, summary: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").parquet(f"{path}/signals")
    trades.write.mode("overwrite").parquet(f"{path}/trades")
    summary.write.mode("overwrite").json(f"{path}/summary")


def sample_days(df: DataFrame, n_days: int, max_rows: int, key: str = "symbol") -> DataFrame:
    """The first ``max_rows`` rows of ``n_days`` evenly spaced days per key (places are truncated): the sampling operator of feasibility checks."""
    days = df.select(key, "session_date").distinct()
    w = Window.partitionBy(key)
    days = days.withColumns({"_i": F.row_number().over(w.orderBy("session_date")) - 1, "_n": F.count(F.lit(1)).over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(int(n_days)), F.col("_n").cast("int")) - 1), lambda k: F.when(
        F.lit(int(n_days)) == 1, 0).otherwise(F.floor(k * (F.col("_n") - 1) / F.greatest(F.least(F.lit(int(n_days)), F.col("_n").cast("int")) - 1, F.lit(1)))))
    chosen = days.filter(F.array_contains(picks.cast("array<int>"), F.col("_i").cast("int"))).select(key, "session_date")
    rank = Window.partitionBy(key, "session_date").orderBy("ts_event", "seq")
    return df.join(chosen, [key, "session_date"]).withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= int(max_rows)).drop("_r")


def lockbox_split(days: DataFrame, months: int) -> DataFrame:
    """Mark the days of the last ``months`` distinct months as ``lockbox``, the others as ``research``.

    At least one month must remain for research.
    """
    if int(months) < 0:
        raise ValueError("months must not be negative")
    if int(months) and days.select(F.date_trunc("month", F.col("date"))).distinct().limit(int(months) + 1).count() <= int(months):
        raise ValueError("no days remain for research after the lockbox split")
    m = days.select(F.date_trunc("month", F.col("date")).alias("_m")).distinct().withColumn(
        "_r", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_m").desc())))
    return days.withColumn("_m", F.date_trunc("month", F.col("date"))).join(m, "_m").withColumn(
        "part", F.when(F.col("_r") <= int(months), "lockbox").otherwise("research")).drop("_m", "_r")
