"""Interval tables and joins: weeks, as-of picks, overlaps, nearest anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timekit import moment


def clamp_overlaps(intervals: DataFrame, start: str = "start", end: str = "end", by: list[str] | None = None) -> DataFrame:
    """Ends an interval where the next one starts, if that lies strictly inside; afterwards none overlap."""
    w = Window.partitionBy(*(by or [])).orderBy(start)
    nxt = F.lead(start).over(w)
    return intervals.withColumn(end, F.when((nxt > F.col(start)) & (nxt < F.col(end)), nxt).otherwise(F.col(end)))


def weeks_between(bounds: DataFrame, days: int = 7) -> DataFrame:
    """``bounds`` (start, stop) -> (week, start, end): intervals of ``days`` days from start until stop is covered."""
    step = F.expr(f"interval {days} days")
    return bounds.select(F.posexplode(F.sequence("start", "stop", step)).alias("week", "start")).withColumn("end", F.col("start") + step)


def assign(points: DataFrame, intervals: DataFrame, ts: str, unit_seconds: int, keep: str = "inner", by: list[str] | None = None) -> DataFrame:
    """Joins each point to the interval [start, end) that holds it, of those with its ``by``; ``intervals`` of one ``by`` must not overlap (``clamp_overlaps``).

    Intervals are spread over the units of time that they touch and points are joined on their unit, an equality
    that hashes and shuffles like any other, with the exact bounds as a residual. Pick a unit about as long as a
    typical interval: each is then copied two or three times and no point meets more than a few.
    """
    unit = lambda c: F.floor(F.unix_seconds(c) / unit_seconds)
    spread = intervals.withColumn("_unit", F.explode(F.sequence(unit(F.col("start")), unit(F.col("end")))))
    p = points.withColumn("_unit", unit(F.col(ts)))
    inside = (p._unit == spread._unit) & (p[ts] >= spread["start"]) & (p[ts] < spread["end"])
    for c in by or []:
        inside = (p[c] == spread[c]) & inside
    out = p.join(spread, inside, keep).drop("_unit")
    for c in by or []:
        out = out.drop(spread[c])
    return out


def overlapping(a: DataFrame, b: DataFrame, unit_seconds: int) -> DataFrame:
    """Pairs of intervals (a_start, a_end, ...) and (b_start, b_end, ...) that share an instant, each once: they are met on the
    unit in which the later of the two starts lies."""
    unit = lambda c: F.floor(F.unix_seconds(c) / unit_seconds)
    sa = a.withColumn("_unit", F.explode(F.sequence(unit(F.col("a_start")), unit(F.col("a_end")))))
    sb = b.withColumn("_ub", F.explode(F.sequence(unit(F.col("b_start")), unit(F.col("b_end")))))
    first = F.col("_unit") == unit(F.greatest("a_start", "b_start"))
    return sa.join(sb, F.col("_unit") == F.col("_ub")).where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & first).drop("_unit", "_ub")


def as_of(rows: DataFrame, by: list[str], ts: str, tie: str, until: Column) -> DataFrame:
    """The latest row per key at or before an instant, the higher ``tie`` of two at one time; one partial aggregate, no sort."""
    names = [c for c in rows.columns if c not in by]
    at = moment(ts, tie)
    return rows.where(until).groupBy(*by).agg(*[F.max_by(c, at).alias(c) for c in names])


def nearest(points: DataFrame, anchors: DataFrame, tolerance: int, by: list[str]) -> DataFrame:
    """Each point (x, whole seconds) with the nearest anchor within ``tolerance`` of it, the earlier of two as near; null if none.

    Anchors and points are cut in units of the tolerance and a point looks at its own and both neighbouring units.
    """
    a = anchors.select(*by, F.col("anchor"), F.floor(F.col("anchor") / tolerance).alias("_unit"))
    p = points.withColumn("_unit", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("x") / tolerance) + d)))
    near = p.join(a, [*by, "_unit"], "left").withColumn("_d", F.abs(F.col("x") - F.col("anchor")))
    ok = F.when(F.col("_d") <= tolerance, F.struct("_d", "anchor"))
    keys = [c for c in points.columns]
    return near.groupBy(*keys).agg(F.min(ok).alias("_best")).select(*keys, F.col("_best.anchor").alias("anchor"))


def clusters(points: DataFrame, by: list[str], x: str, gap: int, tie: str) -> DataFrame:
    """Adds ``cluster``, a number per key that grows where the distance to the point before exceeds ``gap``."""
    w = Window.partitionBy(*by).orderBy(x, tie)
    jump = (F.col(x) - F.lag(x).over(w) > gap).cast("int")
    return points.withColumn("_jump", F.coalesce(jump, F.lit(0))).withColumn("cluster", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")
