"""Typed readers for usage logs, and the adapter that gives the driver's tables that shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE_LINE = (
    "type string, timestamp string, requestId string, costUSD double, sessionId string, uuid string, parentUuid string, cwd string, gitBranch string, "
    "isSidechain boolean, isMeta boolean, message struct<id string, model string, stop_reason string, usage struct<input_tokens bigint, output_tokens bigint, "
    "cache_creation_input_tokens bigint, cache_read_input_tokens bigint, speed string, cache_creation struct<ephemeral_1h_input_tokens bigint, ephemeral_5m_input_tokens bigint>>, content string>"
)
SYNTHETIC = "<synthetic>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, line) of JSONL files; ``path`` may hold wildcards."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("line"))


def _count(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("long")


def classify_usage_lines(lines: DataFrame) -> DataFrame:
    """Typed usage entries of (source_path, line), with ``skip_reason`` null on good rows.

    The first gate that a line fails names the reason: malformed, type, timestamp, usage, model, synthetic, bad_timestamp.
    """
    j = F.from_json("line", USAGE_LINE, {"mode": "PERMISSIVE"})
    r = lines.withColumn("j", j)
    ts = F.try_to_timestamp(F.col("j.timestamp"))
    reason = (
        F.when(F.col("j").isNull() | ~F.trim("line").startswith("{"), "malformed")
        .when(F.coalesce(F.col("j.type"), F.lit("")) != "assistant", "type")
        .when(F.coalesce(F.col("j.timestamp"), F.lit("")) == "", "timestamp")
        .when(F.col("j.message.usage").isNull(), "usage")
        .when(F.coalesce(F.col("j.message.model"), F.lit("")) == "", "model")
        .when(F.col("j.message.model") == SYNTHETIC, "synthetic")
        .when(ts.isNull(), "bad_timestamp")
    )
    u = F.col("j.message.usage")
    return r.select(
        "source_path", reason.alias("skip_reason"), ts.alias("ts"), F.col("j.message.model").alias("model"), F.col("j.sessionId").alias("session_id"),
        F.col("j.cwd").alias("project"), F.col("j.message.id").alias("msg_id"), F.col("j.requestId").alias("req_id"), F.col("j.costUSD").alias("cost_usd_raw"),
        u.speed.alias("speed"), _count(u.input_tokens).alias("input_tokens"), _count(u.output_tokens).alias("output_tokens"),
        _count(u.cache_creation_input_tokens).alias("cache_create_tokens"), _count(u.cache_read_input_tokens).alias("cache_read_tokens"),
        u.cache_creation.ephemeral_1h_input_tokens.alias("cache_1h_tokens"))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Good usage entries of JSONL files."""
    return classify_usage_lines(read_lines(spark, path)).where("skip_reason is null").drop("skip_reason")


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` as usage entries. Times are cast once to ``timestamp``; the session's zone must be UTC."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.select(
        F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), F.col("event_type").alias("model"),
        (F.col("user_id") % 7).alias("project"), (F.col("user_id") % 3).alias("account"), "k", "value",
        (F.col("k") * 4000).alias("input_tokens"), (F.col("k") * 50).alias("output_tokens"), (F.col("k") * 20).alias("cache_create_tokens"), (F.col("k") * 200).alias("cache_read_tokens"),
        F.when(F.col("event_id") % 3 == 0, F.col("k") * 8).alias("cache_1h_tokens"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("cost_usd_raw"), F.when(F.col("event_id") % 5 == 0, "fast").alias("speed"))
