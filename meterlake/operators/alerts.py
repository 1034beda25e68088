"""When alerts of a root are evaluated: on new observations, changed rules, an opened gate, and at instants that observations name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a change: ``kind`` gate (value open or closed), rule (value: thresholds with commas) or observation (percent, capture_at).
CHANGE = "root long, at timestamp, seq long, kind string, value string, percent double, capture_at timestamp"


def reached(rule: Column, percent: Column) -> Column:
    """How many thresholds of a rule a percent has reached."""
    met = F.filter(F.split(rule, ","), lambda t: t.cast("double") <= percent)
    return F.coalesce(F.size(met), F.lit(0)).cast("int")


def evaluations(changes: DataFrame, until: Column) -> DataFrame:
    """(root, at, reason, percent, crossed) of ``changes`` (``CHANGE``) up to an instant.

    Observations that were captured in the future count from that instant on, which is a boundary: the root is evaluated there, once,
    if its gate is open then (a gate that closes disarms boundaries and one that opens arms those still ahead again, so only its state at the
    instant matters). A change of rule and an observation are evaluated if the gate is open, a gate when it opens; a gate that closes is
    told as gate_disabled. The percent is that of the latest capture that counts. Ties are taken by ``seq``, boundaries last.

    One ordered pass a root over changes and boundaries, with frames that only grow."""
    rows = changes.where((F.col("at") <= until) & F.col("root").isNotNull())
    ahead = (F.col("kind") == "observation") & (F.col("capture_at") > F.col("at"))
    seen = F.when(F.col("kind") == "observation", F.struct(F.unix_micros("capture_at").alias("captured"), F.unix_micros("at").alias("told"), "seq", "percent"))
    own = rows.select("root", F.unix_micros("at").alias("t"), F.lit(0).alias("late"), "seq", "kind", "value", F.when(~F.coalesce(ahead, F.lit(False)), seen).alias("seen"))
    bounds = rows.where(ahead & (F.col("capture_at") <= until)).groupBy("root", F.unix_micros("capture_at").alias("t")).agg(F.max(seen).alias("seen"))
    bounds = bounds.select("root", "t", F.lit(1).alias("late"), F.lit(0).cast("long").alias("seq"), F.lit("boundary").alias("kind"), F.lit(None).cast("string").alias("value"), "seen")
    w = Window.partitionBy("root").orderBy("t", "late", "seq")
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    line = own.unionByName(bounds).select(
        "*", F.coalesce(F.last(of("gate"), True).over(so_far), F.lit("closed")).alias("gate"), F.coalesce(F.last(of("gate"), True).over(earlier), F.lit("closed")).alias("gate_before"),
        F.last(of("rule"), True).over(so_far).alias("rule"), F.last(of("rule"), True).over(earlier).alias("rule_before"), F.max("seen").over(so_far)["percent"].alias("percent"))
    open_ = F.col("gate") == "open"
    reason = (
        F.when((F.col("kind") == "gate") & open_ & (F.col("gate_before") != "open"), "gate_enabled").when((F.col("kind") == "gate") & ~open_ & (F.col("gate_before") == "open"), "gate_disabled")
        .when((F.col("kind") == "rule") & open_ & ~F.col("rule").eqNullSafe(F.col("rule_before")), "rule_changed").when((F.col("kind") == "observation") & open_, "window_dirty")
        .when((F.col("kind") == "boundary") & open_, "scheduled"))
    told = line.withColumn("reason", reason).where("reason is not null")
    evaluated = F.col("reason") != "gate_disabled"
    return told.select("root", F.timestamp_micros("t").alias("at"), "reason", F.when(evaluated, F.col("percent")).alias("percent"), F.when(evaluated, reached(F.col("rule"), F.col("percent"))).alias("crossed"))
