"""Subscription weeks from snapshots, resets applied to them, floored maxima, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def generate(anchors: DataFrame, by: list[str], until: int, reach: float = 10.5) -> DataFrame:
    """(*by, start, end) in epoch seconds from week anchors (*by, anchor): a week starts at each anchor; from there seven-day steps
    lead on until the next anchor is at most ``reach`` days ahead, which then starts the next week; after the last, until ``until``.

    How many steps lie between two anchors follows from their distance, so weeks are exploded and not walked.
    """
    w = Window.partitionBy(*by).orderBy("anchor")
    a = anchors.select(*by, "anchor").distinct().withColumn("nxt", F.lead("anchor").over(w))
    steps = F.greatest(F.lit(0), F.ceil((F.col("nxt") - F.col("anchor") - reach * DAY) / (7 * DAY))).cast("long")
    last = F.greatest(F.lit(0), F.ceil((F.lit(until) - F.col("anchor")) / (7.0 * DAY)) - 1).cast("long")
    starts = a.select(*by, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.when(F.col("nxt").isNull(), last).otherwise(steps)), lambda k: F.col("anchor") + k * (7 * DAY))).alias("start"))
    nxt = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
    return starts.withColumn("end", F.coalesce(F.least(nxt, F.col("start") + 7 * DAY), F.col("start") + 7 * DAY))


def with_fallbacks(keys: DataFrame, usage: DataFrame, costs: DataFrame, by: list[str], first: int, start_day: int = 0) -> DataFrame:
    """Anchors (*by, anchor) for every row of ``keys``: those of ``usage``, else those of ``costs``, else the calendar week that holds the
    second ``first``, from ``start_day`` (0 is Monday)."""
    only = lambda df, others: df.select(*by, "anchor").join(others.select(*by).distinct(), by, "left_anti")
    second = only(costs, usage)
    calendar = (first // DAY - (first // DAY + 3 - start_day) % 7) * DAY
    rest = keys.select(*by).distinct().join(usage.select(*by).unionByName(costs.select(*by)).distinct(), by, "left_anti")
    return usage.select(*by, "anchor").unionByName(second).unionByName(rest.withColumn("anchor", F.lit(calendar).cast("long")))


def apply_resets(weeks: DataFrame, resets: DataFrame, by: list[str]) -> DataFrame:
    """``resets`` (*by, old_end, new_end, effective): the week that ended at old_end ends at effective, and the one that ends at
    new_end starts there; a reset within one week (old_end = new_end) splits it in two."""
    split = resets.where("old_end = new_end").select(*by, F.col("old_end").alias("end"), F.col("effective").alias("cut"))
    pre = resets.where("old_end <> new_end").select(*by, F.col("old_end").alias("end"), F.col("effective").alias("early"))
    post = resets.where("old_end <> new_end").select(*by, F.col("new_end").alias("end"), F.col("effective").alias("late"))
    one = lambda df, c: df.groupBy(*by, "end").agg(F.max(c).alias(c))
    j = weeks.join(one(pre, "early"), [*by, "end"], "left").join(one(post, "late"), [*by, "end"], "left").join(one(split, "cut"), [*by, "end"], "left")
    start, end = F.coalesce("late", "start"), F.coalesce("early", "end")
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    halves = F.array(F.struct(start.alias("start"), F.col("cut").alias("end")), F.struct(F.col("cut").alias("start"), end.alias("end")))
    inside = (F.col("cut") > start) & (F.col("cut") < end)
    parts = j.select(*by, F.explode(F.when(inside, halves).otherwise(whole)).alias("w"))
    return parts.select(*by, "w.start", "w.end").where(F.col("start") < F.col("end"))


def floored_max(samples: DataFrame, floors: DataFrame, by: list[str]) -> DataFrame:
    """The highest percent per key among samples (*by, ts, percent) at or after the key's latest floor (*by, floor). A key all of whose
    samples are earlier is absent; samples without a time count, those without a percent don't."""
    f = floors.where("floor is not null").groupBy(*by).agg(F.max("floor").alias("floor"))
    j = samples.where("percent is not null").join(f, by, "left")
    kept = j.where(F.col("floor").isNull() | F.col("ts").isNull() | (F.col("ts") >= F.col("floor")))
    return kept.groupBy(*by).agg(F.max("percent").alias("percent"))


def cycles(resets: DataFrame, by: list[str], jitter: int = 600) -> DataFrame:
    """(*by, start, end) of quota cycles (*by, start, reset): resets that follow within ``jitter`` seconds are one, its first start and
    last reset count; a cycle ends where the next starts, the last at its reset; empty ones go."""
    # few resets are distinct, whatever the number of samples
    resets = resets.groupBy(*by, "reset").agg(F.min("start").alias("start"))
    w = Window.partitionBy(*by).orderBy("reset", "start")
    jump = F.coalesce((F.col("reset") - F.lag("reset").over(w) > jitter).cast("int"), F.lit(0))
    c = resets.withColumn("_j", jump).withColumn("_c", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = c.groupBy(*by, "_c").agg(F.min("start").alias("start"), F.max("reset").alias("reset"))
    nxt = F.lead("start").over(Window.partitionBy(*by).orderBy("start", "reset"))
    return g.select(*by, "start", F.least("reset", F.coalesce(nxt, "reset")).alias("end")).where(F.col("start") < F.col("end"))


def canonical_keys(samples: DataFrame, by: list[str], order: list[str], tolerance: int = 600, unit: int = DAY) -> DataFrame:
    """Adds ``window_key``: the reset time to ten minutes, taken over from the sample before as long as two that follow each other
    differ by less than ``tolerance``. ``order`` begins with a time in seconds.

    Samples are walked in stretches of ``unit`` seconds, and what a stretch takes over from those before it is told by one row for
    each stretch, so that no task sees all samples of a key.
    """
    s = samples.withColumn("_u", F.floor(F.col(order[0]) / unit))
    inside = Window.partitionBy(*by, "_u").orderBy(*order)
    far = lambda a, b: F.abs(a - b) >= tolerance
    jump = F.coalesce(far(F.col("reset"), F.lag("reset").over(inside)).cast("int"), F.lit(0))
    s = s.withColumn("_j", jump).withColumn("_g", F.sum("_j").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_own", F.when(F.col("_g") > 0, F.first("reset").over(Window.partitionBy(*by, "_u", "_g").orderBy(*order))))
    at = F.struct(*order)
    stretches = s.groupBy(*by, "_u").agg(F.min_by("reset", at).alias("_first"), F.max_by("reset", at).alias("_last"), F.max_by("_own", at).alias("_tail"))
    along = Window.partitionBy(*by).orderBy("_u")
    begins = F.coalesce(far(F.col("_first"), F.lag("_last").over(along)), F.lit(True))
    stretches = stretches.withColumn("_begins", begins).withColumn("_open", F.coalesce("_tail", F.when(F.col("_begins"), F.col("_first"))))
    carried = F.last("_open", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    stretches = stretches.withColumn("_start", F.when(F.col("_begins"), F.col("_first")).otherwise(carried)).select(*by, "_u", "_start")
    j = s.join(stretches, [*by, "_u"])
    return j.withColumn("window_key", (F.floor(F.coalesce("_own", "_start") / 600) * 600).cast("long")).drop("_u", "_j", "_g", "_own", "_start")
