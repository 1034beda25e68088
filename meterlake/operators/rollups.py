"""Bucketed rollups of usage entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import stable_sum
from ..functions.timekit import moment

TOKENS = ("input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens")


def token_sums() -> list[Column]:
    return [F.sum(t).alias(t) for t in TOKENS]


def real_entries(entries: DataFrame, synthetic: str) -> DataFrame:
    """Without rows of the synthetic model class."""
    return entries.where(F.col("model") != synthetic)


def rollup(entries: DataFrame, keys: list[Column | str], *more: Column) -> DataFrame:
    """Token sums, cost and entries by key; ``entries`` has a ``cost`` column. One shuffle, combined before it."""
    return entries.groupBy(*keys).agg(*token_sums(), stable_sum(F.col("cost")).alias("cost_usd"), F.count("*").alias("entries"), *more)


def model_breakdown(entries: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, total, models): a bucket's models, dearest first, as an ordered array. Two levels of aggregation, so that what
    is gathered in a bucket is one row per model. Fast entries are shown as models of their own."""
    shown = F.when(F.col("speed") == "fast", F.concat("model", F.lit("-fast"))).otherwise(F.col("model"))
    by_model = entries.groupBy(bucket.alias("bucket"), shown.alias("model")).agg(stable_sum(F.col("cost")).alias("cost_usd"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("cost_usd")).alias("o"), "model")))
    return by_model.groupBy("bucket").agg((F.sum(F.floor(F.col("cost_usd") * 1e9 + 0.5).cast("long")) / F.lit(1e9)).alias("cost_usd"), F.sum("n").alias("entries"), F.array_join(F.transform(ordered, lambda m: m.model), ",").alias("models"))


def sessions(entries: DataFrame) -> DataFrame:
    """One row per session: bounds, totals, models, and the project of its latest entry that has one."""
    latest = F.max_by("project", F.when(F.col("project").isNotNull(), moment("ts", "entry_id")))
    return rollup(entries, ["session_id"], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("model").alias("models"), latest.alias("project"))


def top_and_other(totals: DataFrame, key: str, value: str, n: int, sums: list[str], other: str = "(other)") -> DataFrame:
    """The ``n`` largest rows by absolute value, ties by key, and all the rest folded into one. ``totals`` has a row per key;
    it is ranked by a top-n, so no task sorts all of it."""
    best = totals.orderBy(F.abs(F.col(value)).desc(), F.col(key)).limit(n).select(F.col(key).alias("_top"))
    named = totals.join(F.broadcast(best), F.col(key) == F.col("_top"), "left").withColumn(key, F.coalesce("_top", F.lit(other))).drop("_top")
    return named.groupBy(key).agg(*[F.sum(s).alias(s) for s in sums])


def ranked_groups(totals: DataFrame, group: str, value: str) -> DataFrame:
    """Adds each group's total and its rank, largest first, ties by group."""
    by_group = totals.groupBy(group).agg(F.sum(value).alias("group_total"))
    ranked = by_group.withColumn("group_rank", F.row_number().over(Window.orderBy(F.desc("group_total"), group)))
    return totals.join(ranked, group)


def crosstab(entries: DataFrame, row: Column, column: str, top: list, value: Column) -> DataFrame:
    """One row per ``row``, one column per member of ``top`` and ``other``, the row's total less those."""
    picked = [F.sum(F.when(F.col(column) == m, value)).alias(f"c{i + 1}") for i, m in enumerate(top)]
    return entries.groupBy(row.alias("row")).agg(*picked, F.sum(value).alias("total"))
