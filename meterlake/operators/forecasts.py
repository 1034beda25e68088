"""Weekly forecasts and candidate arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_source(percent: Column, this_week: Column, median: Column) -> Column:
    """struct(rate, source): dollars per percent of this week once ten percent are used, else the median of four weeks, else this week's
    sparse one."""
    of = lambda rate, source: F.struct(rate.alias("rate"), F.lit(source).alias("source"))
    return F.when((percent >= 10) & this_week.isNotNull(), of(this_week, "this_week")).when(median.isNotNull(), of(median, "median")).otherwise(of(this_week, "sparse"))


def weekly_forecast(state: DataFrame, targets: list[int]) -> DataFrame:
    """``state``: key columns with percent, percent_24h (a day ago or null), hours_24h, elapsed, remaining (hours) and usd_per_pct. Adds
    both rates, the band of the percent at the week's end, hours to the cap, and dollars a day per target. No rate, no figure."""
    now, left = F.col("percent"), F.col("remaining")
    avg = F.when(F.col("elapsed") > 0, now / F.col("elapsed")).otherwise(0.0)
    recent = F.when(F.col("percent_24h").isNotNull() & (F.col("hours_24h") > 0), F.greatest(F.lit(0.0), (now - F.col("percent_24h")) / F.col("hours_24h")))
    by_avg, by_recent = now + avg * left, now + F.coalesce(recent, avg) * left
    worst = F.greatest(avg, F.coalesce(recent, F.lit(0.0)))
    low, high, capped = F.least(by_avg, by_recent), F.greatest(by_avg, by_recent), now >= 100
    hours = (100.0 - now) / worst
    daily = [F.when(~capped & (F.lit(float(t)) > now) & (left > 0), (t - now) * F.col("usd_per_pct") / (left / 24)).alias(f"usd_per_day_{t}") for t in sorted(targets, reverse=True)]
    return state.select("*", avg.alias("rate_avg"), recent.alias("rate_recent"), low.alias("final_low"), high.alias("final_high"), (capped | (high >= 100)).alias("reaches_cap"),
                        F.when(~capped & (high >= 100) & (worst > 0) & (hours < left), hours).alias("hours_to_cap"), *daily)


def confidence_triggers(elapsed: Column, percent: Column, snapshots: Column, has_day_old: Column) -> Column:
    """Codes of everything that makes a forecast unsure."""
    return F.array_compact(F.array(F.when(elapsed < 24, "elapsed_hours<24"), F.when(percent < 2, "percent<2"), F.when(snapshots < 3, "snapshots<3"), F.when(~has_day_old, "no_sample_ge_24h")))


def arbitrate(candidates: DataFrame, published: DataFrame, axis: str) -> DataFrame:
    """``candidates`` (axis, source, window_key, percent), the latest of each source, against ``published`` (axis, window_key, percent):
    the newest window and its highest percent; published if the window is newer or the percent higher, ignored if the window is
    older, pending if every source of the window is lower than what is published, else nothing."""
    newest = candidates.groupBy(axis).agg(F.max(F.struct("window_key", "percent")).alias("top"), F.count("*").alias("sources"))
    j = newest.join(published.select(axis, F.col("window_key").alias("db_key"), F.col("percent").alias("db_percent")), axis, "left")
    key, pct = F.col("top.window_key"), F.col("top.percent")
    action = (F.when(F.col("db_key").isNull() | (key > F.col("db_key")), "publish").when(key < F.col("db_key"), "ignore")
              .when(pct > F.col("db_percent"), "publish").when(pct == F.col("db_percent"), "none").otherwise("pending"))
    return j.select(axis, key.alias("window_key"), pct.alias("percent"), "sources", action.alias("action"))


def segments(turns: DataFrame, by: list[str], position: str, cost: str, budget: int) -> DataFrame:
    """Adds ``segment``: turns in order, a new segment where the running cost would pass ``budget``; a turn that alone does so is a segment.
    A fold over each key's costs, one number per turn."""
    rows = turns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(cost).alias("c")))).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc.used > 0) & (acc.used + x.c > budget)
        n = F.when(over, acc.n + 1).otherwise(acc.n)
        return F.struct(F.when(over, x.c).otherwise(acc.used + x.c).cast("long").alias("used"), n.alias("n"), F.array_append(acc.out, n).alias("out"))

    folded = rows.select(*by, F.col("t"), F.aggregate("t", start, step, lambda a: a.out).alias("s"))
    z = folded.select(*by, F.explode(F.arrays_zip("t", "s")).alias("z"))
    return z.select(*by, F.col("z.t.p").alias(position), F.col("z.t.c").alias(cost), F.col("z.s").alias("segment"))


def cache_rebuilds(turns: DataFrame, by: list[str], order: list[str], share: float = 0.5) -> DataFrame:
    """Turns at which the cache was written anew: reads fall to nothing although an earlier turn of the key read, and at least ``share`` of
    that is written. Adds prev_cached and tokens_recreated."""
    high = F.max("cache_read_tokens").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    t = turns.withColumn("prev_cached", high).where((F.col("prev_cached") > 0) & (F.col("cache_read_tokens") == 0) & (F.col("cache_create_tokens") >= share * F.col("prev_cached")))
    return t.withColumn("tokens_recreated", F.least("prev_cached", "cache_create_tokens"))
