"""Experiment-log source: JSON lines, idempotent append, and a log derived from an events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICT = T.StructType([T.StructField("verdict", T.StringType())])
METRICS = T.StructType([T.StructField("sharpe_ratio", T.DoubleType()), T.StructField("net_pnl", T.DoubleType()),
                        T.StructField("trade_count", T.LongType())])
RESULT = T.StructType([
    T.StructField("verdict", T.StringType()), T.StructField("metrics", METRICS),
    T.StructField("gauntlet", T.MapType(T.StringType(), VERDICT)), T.StructField("failed_gates", T.ArrayType(T.StringType())),
    T.StructField("failure_code", T.StringType()), T.StructField("edge_status", T.StringType()), T.StructField("edge_passed", T.BooleanType())])
LOG = T.StructType([T.StructField(n, T.StringType()) for n in (
    "event_id", "event", "run_id", "task_id", "request_id", "strategy_id", "strategy_name", "params", "theme_tag", "setup_key", "setup_label",
    "bar_config", "verdict")] + [T.StructField("search_result", RESULT), T.StructField("selection_result", RESULT),
                                T.StructField("pass_count", T.LongType()), T.StructField("selection_attempted", T.BooleanType()),
                                T.StructField("selection_passed", T.BooleanType()), T.StructField("timestamp", T.TimestampType())])


def read_log(spark: SparkSession, path: str, events: list[str] | None = None) -> DataFrame:
    """Well-formed rows of JSON-lines files, optionally of some event kinds; broken lines are skipped."""
    schema = T.StructType(LOG.fields + [T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    return df if events is None else df.filter(F.col("event").isin(*events))


def parse_lines(lines: DataFrame, column: str, schema: str, events: list[str]) -> DataFrame:
    """The same rule for JSON text already in a column."""
    row = F.from_json(F.col(column), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = lines.withColumn("_r", row).filter(F.col("_r").isNotNull() & F.col("_r._corrupt").isNull()).select("_r.*").drop("_corrupt")
    return df.filter(F.col("event").isin(*events))


def with_event_id(df: DataFrame) -> DataFrame:
    """Fill a missing id with the SHA-256 of the record's canonical JSON (fields in name order)."""
    body = F.to_json(F.struct(*sorted(c for c in df.columns if c != "event_id")))
    given = F.col("event_id") if "event_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("event_id", F.coalesce(F.nullif(given, F.lit("")), F.sha2(body, 256)))


def new_records(batch: DataFrame, existing: DataFrame, recent: int | None = None) -> DataFrame:
    """Rows of ``batch`` to append: one per id, none whose id is already among the last ``recent`` logged rows."""
    seen = existing.select("event_id", "timestamp")
    if recent is not None:
        seen = seen.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(int(recent))
    once = batch.groupBy("event_id").agg(F.min_by(F.struct(*batch.columns), F.struct("timestamp", "event_id")).alias("r")).select("r.*")
    return once.join(seen.select("event_id").distinct(), "event_id", "left_anti")


def append_log(batch: DataFrame, path: str, existing: DataFrame, recent: int | None = None) -> None:
    """Append the rows whose id is not logged yet; ``recent`` limits the rows that are looked at, only if asked."""
    new_records(with_event_id(batch), existing, recent).write.mode("append").json(path)


def log_from_events(events: DataFrame) -> DataFrame:
    """An experiment log derived deterministically from an ``events`` table."""
    eid, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    sharpe = F.col("value") / 50 - 0.5

    def check(n: int):
        return F.struct(F.when(eid % n == 0, "FAIL").otherwise("PASS").alias("verdict"))

    def result(score, verdict):
        return F.struct(
            verdict.alias("verdict"), F.struct(score.alias("sharpe_ratio"), (F.col("value") * 10 - 300).alias("net_pnl"),
                                               (eid % 90).alias("trade_count")).alias("metrics"),
            F.create_map(F.lit("shuffle"), check(3), F.lit("regime"), check(2), F.lit("decay"), check(5)).alias("gauntlet"),
            F.when(eid % 7 == 0, F.array(F.lit("deflated_sharpe"))).otherwise(F.array().cast("array<string>")).alias("failed_gates"),
            F.when(eid % 11 == 0, "no_trades").alias("failure_code"),
            F.when(eid % 4 == 0, "no_edge").otherwise("global_edge").alias("edge_status"), (eid % 4 != 0).alias("edge_passed"))

    passed = sharpe > 0.5
    return events.select(
        F.sha2(F.concat_ws(":", F.lit("run"), eid.cast("string")), 256).alias("event_id"), eid.alias("seq"),
        F.when(k % 10 == 0, "task_error").when(k % 10 == 1, "validation_handoff_completed").when(k % 10 == 2, "").otherwise("task_result").alias("event"),
        F.lit("run").alias("run_id"), eid.cast("string").alias("task_id"), (F.col("user_id") % 50).cast("string").alias("request_id"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("id"), F.col("user_id") % 40)).alias("strategy_id"),
        F.concat(F.lit("strat_"), F.col("user_id") % 20).alias("strategy_name"), F.col("props").alias("params"),
        F.concat(F.lit("Theme-"), F.col("user_id") % 7, F.lit(" Big Move Of The Day")).alias("theme_tag"),
        F.concat(F.lit("setup"), F.col("user_id") % 9).alias("setup_key"), F.col("event_type").alias("bar_config"),
        F.when(passed, "PASS").otherwise("FAIL").alias("verdict"),
        result(sharpe, F.when(passed, "PASS").otherwise("FAIL")).alias("search_result"),
        F.when(passed, result(sharpe - 0.2, F.when(eid % 2 == 0, "PASS").otherwise("FAIL"))).alias("selection_result"),
        (eid % 3).alias("pass_count"), (eid % 2 == 0).alias("selection_attempted"), (eid % 4 == 0).alias("selection_passed"),
        F.col("ts").cast("timestamp").alias("timestamp"))
