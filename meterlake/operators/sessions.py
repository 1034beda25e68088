"""Sessions and projects behind entries: files, resumed sessions, keyed sessions, cache use by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import hit_percent, nano
from ..functions.sizes import broadcast_if_small
from ..functions.text import stem
from ..functions.timekit import moment
from .rollups import rollup


def attach_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """``entries`` (path, ...) with session and project_path of their file (path, session_id, project_path). A file that isn't listed or
    names no session counts as the session that its name tells."""
    f = files.select("path", F.col("session_id").cast("string").alias("_s"), "project_path")
    return entries.join(broadcast_if_small(f), "path", "left").withColumn("session", F.coalesce("_s", stem(F.col("path")))).drop("_s")


def merged_sessions(entries: DataFrame) -> DataFrame:
    """One row per session (session, path, ts, entry_id, project_path, cost), whatever the number of files that it was resumed in: bounds,
    totals, files, and the project of the latest entry that has one, the last of several at one time."""
    latest = F.max_by("project_path", F.when(F.col("project_path").isNotNull(), moment("ts", "entry_id")))
    return rollup(entries, ["session"], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("path").alias("files"), latest.alias("project_path"))


def keyed_sessions(entries: DataFrame) -> DataFrame:
    """Sessions of a provider that keeps several roots: one per root and relative path, as equal paths under two roots are two."""
    return rollup(entries, ["root", "path"], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("model").alias("models"))


def cache_sums(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Token sums, whole billionths saved and wasted, and the hit percentage of the sums, by key; ``rows`` have saved and wasted."""
    g = rows.groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("cache_create_tokens").alias("create_tokens"), F.sum("cache_read_tokens").alias("read_tokens"), F.sum(nano(F.col("saved"))).alias("saved"), F.sum(nano(F.col("wasted"))).alias("wasted"))
    return g.withColumn("net", F.col("saved") - F.col("wasted")).withColumn("hit_pct", hit_percent(F.col("input_tokens"), F.col("create_tokens"), F.col("read_tokens")))


def cache_tree(rows: DataFrame, key: str, child: str) -> DataFrame:
    """``cache_sums`` of every key and, below it, of its children; ``child`` is null in a key's own row. One pass: a key's row is summed
    up from its children's."""
    parts = cache_sums(rows, [key, child])
    own = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("input_tokens", "create_tokens", "read_tokens", "saved", "wasted", "net")])
    own = own.withColumn("hit_pct", hit_percent(F.col("input_tokens"), F.col("create_tokens"), F.col("read_tokens"))).withColumn(child, F.lit(None).cast(parts.schema[child].dataType))
    return own.unionByName(parts)


def cache_breakdown(sums: DataFrame, key: str, n: int, other: str = "(other)") -> DataFrame:
    """The ``n`` keys whose net is largest in absolute value, ties by key, and the rest as one, whose hit percentage is that of its summed
    tokens. ``key`` is a text."""
    from .rollups import top_and_other

    g = top_and_other(sums, key, "net", n, ["input_tokens", "create_tokens", "read_tokens", "net"], other)
    return g.select(key, "net", hit_percent(F.col("input_tokens"), F.col("create_tokens"), F.col("read_tokens")).alias("hit_pct"))
