"""Fixed-length activity blocks, their gaps, burn rates, and recorded windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def _runs(rows: DataFrame, by: list[str], at: str, length: int) -> DataFrame:
    """Adds ``_run``: rows of a key that follow each other by less than ``length``. What lies further apart can't share a block or
    overlap, so runs are folded one by one, however long a key's history is."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) >= length).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fixed_blocks(entries: DataFrame, by: list[str], hours: int = 5) -> DataFrame:
    """(*by, start, end, first_ts, last_ts, entries): a block starts at the full hour of its first entry and lasts ``hours``; the
    first entry at or after its end opens the next one. Blocks follow from each other, so a key's entries are folded in order.

    What is folded is one number per key and active hour: a new block can begin within an hour
    only at a later hour's start plus the length, which is a full hour again, so an hour never straddles two blocks. After
    ``hours`` idle hours a block begins in any case, so each run of activity is folded by itself, and only block starts come out of
    the fold; a block then meets its own hours by an equality.
    """
    hour = F.floor(F.unix_micros("ts") / HOUR)
    hourly = entries.groupBy(*by, hour.alias("hour")).agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("z"), F.count("*").alias("n"))
    folded = _runs(hourly.select(*by, "hour"), by, "hour", hours).groupBy(*by, "_run").agg(F.array_sort(F.collect_list("hour")).alias("hours"))
    starts = F.aggregate(
        "hours", F.array().cast("array<bigint>"),
        lambda acc, h: F.when((F.size(acc) == 0) | (h >= F.try_element_at(acc, F.lit(-1)) + hours), F.array_append(acc, h)).otherwise(acc))
    # outer, as an inner one would have Spark fold twice, once to see whether the array is empty; it never is
    blocks = folded.select(*by, starts.alias("starts")).select(*by, F.explode_outer("starts").alias("s"))
    inside = blocks.select(*by, "s", F.explode(F.sequence(F.col("s"), F.col("s") + (hours - 1))).alias("hour"))
    at = F.timestamp_micros
    b = inside.join(hourly, [*by, "hour"]).groupBy(*by, "s").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("entries"))
    return b.select(*by, at(F.col("s") * HOUR).alias("start"), at((F.col("s") + hours) * HOUR).alias("end"), at("a").alias("first_ts"), at("z").alias("last_ts"), "entries")


def gaps(blocks: DataFrame, by: list[str], least_seconds: int = 60) -> DataFrame:
    """Idle times between blocks: from the last entry of one to the first of the next. None if the blocks touch or less than
    ``least_seconds`` lie between."""
    w = Window.partitionBy(*by).orderBy("start")
    g = blocks.select(*by, "start", F.lag("end").over(w).alias("prev_end"), F.lag("last_ts").over(w).alias("gap_start"), F.col("first_ts").alias("gap_end"))
    long = F.unix_micros("gap_end") - F.unix_micros("gap_start") >= least_seconds * 1_000_000
    return g.where((F.col("prev_end") < F.col("start")) & long).select(*by, "gap_start", "gap_end")


def burn(blocks: DataFrame, now: Column, hours: int = 5) -> DataFrame:
    """Adds is_active and, for active blocks, tokens per minute, cost per hour and their projections to the block's end."""
    active = now < F.col("end")
    minutes = (F.unix_micros(now) - F.unix_micros("start")) / 60e6
    going = active & (minutes > 0)
    rate, cost = F.col("total_tokens") / minutes, F.col("cost_usd") / minutes * 60
    return blocks.select(
        "*", active.alias("is_active"), F.when(going, rate).alias("tokens_per_minute"), F.when(going, cost).alias("cost_per_hour"),
        F.when(going, (rate * (hours * 60)).cast("long")).alias("projected_tokens"),
        F.when(going, F.floor((F.unix_micros("end") - F.unix_micros(now)) / 60e6).cast("long")).alias("remaining_minutes"))


def recent(blocks: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """Blocks that began within ``days`` or are active."""
    return blocks.where((F.col("start") >= now - F.expr(f"interval {days} days")) | ((F.col("start") <= now) & (now < F.col("end"))))


def token_limit(raw: str | None, blocks: DataFrame, now: Column) -> DataFrame:
    """Adds ``token_limit`` and ``limit_pct``: the number that ``raw`` begins with; none, empty or max means the most tokens of a block that
    has ended. A limit of 0 or less has no percent."""
    if raw is None or raw in ("", "max"):
        b = blocks.withColumn("token_limit", blocks.where(F.col("end") <= now).select(F.max("total_tokens")).scalar())
    else:
        m = re.match(r"\s*([+-]?\d+)", raw)
        b = blocks.withColumn("token_limit", F.lit(int(m[1]) if m else None).cast("long"))
    return b.withColumn("limit_pct", F.when(F.col("token_limit") > 0, F.col("total_tokens") / F.col("token_limit") * 100))


CANONICAL_WEIGHT = 1000


def recorded_windows(samples: DataFrame, by: list[str], canonical: DataFrame | None = None, credits: DataFrame | None = None, hours: int = 5) -> DataFrame:
    """(*by, window_start, window_end, support) of quota samples (*by, resets_at): reset times to ten minutes, and how often each was
    seen. A window that ``canonical`` (*by, window_end) names as well weighs ``CANONICAL_WEIGHT`` more, seen or not. A window in which a
    credit (*by, credited_at) falls ends there, at the first of several."""
    end = F.timestamp_seconds(F.floor(F.unix_seconds("resets_at") / 600) * 600)
    seen = samples.select(*by, end.alias("window_end"), F.lit(1).alias("weight"))
    if canonical is not None:
        seen = seen.unionByName(canonical.select(*by, "window_end").distinct().withColumn("weight", F.lit(CANONICAL_WEIGHT)))
    w = seen.groupBy(*by, "window_end").agg(F.sum("weight").alias("support")).withColumn("window_start", F.col("window_end") - F.expr(f"interval {hours} hours"))
    if credits is None:
        return w.select(*by, "window_start", "window_end", "support")
    unit = hours * 3600
    u = lambda c: F.floor(F.unix_seconds(c) / unit)
    spread = w.withColumn("_u", F.explode(F.sequence(u("window_start"), u("window_end"))))
    c = credits.select(*by, "credited_at", u("credited_at").alias("_u"))
    met = spread.join(c, [*by, "_u"]).where("credited_at > window_start and credited_at < window_end")
    first = met.groupBy(*by, "window_end").agg(F.min("credited_at").alias("_cut"))
    return w.join(first, [*by, "window_end"], "left").select(*by, "window_start", F.coalesce("_cut", "window_end").alias("window_end"), "support")


def schedule(windows: DataFrame, by: list[str], length: int) -> DataFrame:
    """Of windows (x, weight) of equal ``length``, the set without overlaps that has the most weight; of equal ones, the later
    window is taken. A fold over the windows of a run, in order, keeps the best weight so far and the choice that gives it; a step
    looks back at the last ``length`` windows, among which is the latest one that it may follow, as their starts are whole numbers."""
    merged = windows.groupBy(*by, "x").agg(F.sum("weight").alias("weight"))
    rows = _runs(merged, by, "x", length).groupBy(*by, "_run").agg(F.array_sort(F.collect_list(F.struct("x", "weight"))).alias("w"))
    empty = F.array().cast("array<struct<x:bigint,best:bigint,take:boolean>>")

    def before(acc: Column, x: Column) -> Column:
        near = F.slice(acc, F.greatest(F.lit(1), F.size(acc) - length), F.lit(length + 1))
        fits = F.filter(near, lambda s: s.x <= x - length)
        return F.coalesce(F.try_element_at(fits, F.lit(-1))["best"], F.lit(0))

    def step(acc: Column, w: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["best"], F.lit(0))
        with_w = before(acc, w.x) + w.weight
        return F.array_append(acc, F.struct(w.x.cast("bigint").alias("x"), F.greatest(last, with_w).cast("bigint").alias("best"), (with_w >= last).alias("take")))

    table = F.aggregate("w", empty, step)
    # back from the last: a window is chosen if its choice was to take it and it ends before the one chosen after it
    picked = F.aggregate(F.reverse("t"), F.array().cast("array<bigint>"), lambda acc, s: F.when(s.take & ((F.size(acc) == 0) | (s.x + length <= F.try_element_at(acc, F.lit(-1)))), F.array_append(acc, s.x)).otherwise(acc))
    return rows.select(*by, table.alias("t")).select(*by, F.explode(picked).alias("x"))


def anchored_blocks(entries: DataFrame, windows: DataFrame, by: list[str], hours: int = 5) -> DataFrame:
    """Blocks of ``entries`` (*by, ts) with recorded ``windows`` (*by, start, end), which must not overlap: entries inside a window
    make its block, all others make fixed-length blocks, whose end is moved to the start of the next recorded window if that
    lies inside. (*by, start, end, first_ts, last_ts, entries, anchor)."""
    unit = hours * 3600
    u = lambda c: F.floor(F.unix_seconds(c) / unit)
    spread = windows.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(u(F.col("start")), u(F.col("end")))).alias("_u"))
    e = entries.select(*by, "ts", u(F.col("ts")).alias("_u"))
    same = [e[c] == spread[c] for c in by]
    j = e.join(spread, [*same, e["_u"] == spread["_u"], e["ts"] >= spread["_s"], e["ts"] < spread["_e"]], "left").select(*[e[c] for c in by], e["ts"], "_s", "_e")
    recorded = j.where("_s is not null").groupBy(*by, F.col("_s").alias("start"), F.col("_e").alias("end")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("entries")).withColumn("anchor", F.lit("recorded"))
    free = fixed_blocks(j.where("_s is null"), by, hours).withColumn("anchor", F.lit("heuristic"))
    marks = windows.select(*by, F.col("start").alias("_at"), F.lit(None).cast("struct<start:timestamp,end:timestamp,first_ts:timestamp,last_ts:timestamp,entries:bigint,anchor:string>").alias("_b"), F.col("start").alias("_w"))
    blocks = free.select(*by, F.col("start").alias("_at"), F.struct("start", "end", "first_ts", "last_ts", "entries", "anchor").alias("_b"), F.lit(None).cast("timestamp").alias("_w"))
    # from the latest on, so that the frame only grows
    after = Window.partitionBy(*by).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    nxt = F.min("_w").over(after)
    numbered = marks.unionByName(blocks).withColumn("_at", F.unix_micros("_at"))
    clamped = numbered.withColumn("_n", nxt).where("_b is not null")
    end = F.when(F.col("_n") < F.col("_b.end"), F.col("_n")).otherwise(F.col("_b.end"))
    return recorded.unionByName(clamped.select(*by, "_b.start", end.alias("end"), "_b.first_ts", "_b.last_ts", "_b.entries", "_b.anchor"))
