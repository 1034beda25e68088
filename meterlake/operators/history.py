"""Milestone history: physical cycles, what falls in each, and checks of stored milestones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import assign

DAY = 86_400


def logical_cycles(retained: DataFrame, resets: DataFrame) -> DataFrame:
    """(account, key, start, end) of ``retained`` bounds (account, key, start, end), whole seconds: the outermost of each key, cut at the ``resets`` (account, key, at) strictly inside. Bounds that are
    null or empty don't count, nor does a key without others."""
    outer = retained.where(F.col("end") > F.col("start")).groupBy("account", "key").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = outer.join(resets.select("account", "key", "at").distinct(), ["account", "key"]).where((F.col("at") > F.col("start")) & (F.col("at") < F.col("end"))).select("account", "key", F.col("at").alias("start"), "end")
    w = Window.partitionBy("account", "key").orderBy("start")
    return outer.unionByName(cuts).withColumn("end", F.coalesce(F.lead("start").over(w), "end"))


def physical_cycles(cycles: DataFrame, unit: int = 7 * DAY) -> DataFrame:
    """(account, key, start, end, piece, piece_end): of logical ``cycles`` that overlap, the stretches in which each is the one that counts: the one that began last, of
    several the one that ends last, then the larger key. A sweep over all starts and ends: each stretch between two of them is met, by
    units of time, by the cycles over it only; neighbouring stretches of one cycle are one piece. A cycle that never counts has no row."""
    bound = lambda c: cycles.select("account", F.col(c).alias("at"))
    w = Window.partitionBy("account").orderBy("at")
    stretches = bound("start").union(bound("end")).distinct().withColumn("stop", F.lead("at").over(w)).where("stop is not null").withColumn("_u", F.floor(F.col("at") / unit))
    spread = cycles.withColumn("_u", F.explode(F.sequence(F.floor(F.col("start") / unit), F.floor((F.col("end") - 1) / unit))))
    over = stretches.join(spread, ["account", "_u"]).where("start <= at and at < end")
    chosen = over.groupBy("account", "at", "stop").agg(F.max(F.struct("start", "end", "key")).alias("c")).select("account", "at", "stop", "c.*")
    new = ~((F.lag("key").over(w).eqNullSafe(F.col("key"))) & (F.lag("start").over(w) == F.col("start")) & (F.lag("end").over(w) == F.col("end")) & (F.lag("stop").over(w) == F.col("at")))
    run = chosen.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("account", "key", "start", "end", "_run").agg(F.min("at").alias("piece"), F.max("stop").alias("piece_end")).drop("_run")


def cycle_detail(pieces: DataFrame, milestones: DataFrame, unit: int = 7 * DAY) -> DataFrame:
    """``milestones`` (account, at, percent, cumulative, marginal) with the ``key`` and ``start`` of the cycle that counts at their instant; those outside all pieces are left out. Costs to four places."""
    at = F.timestamp_seconds
    p = pieces.select("account", "key", F.col("start").alias("cycle"), at("piece").alias("start"), at("piece_end").alias("end"))
    m = assign(milestones.withColumn("_ts", at("at")), p, "_ts", unit, by=["account"])
    return m.select("account", "key", F.col("cycle").alias("start"), "at", "percent", F.round("cumulative", 4).alias("cumulative"), F.round("marginal", 4).alias("marginal"))


def cycle_index(pieces: DataFrame, detail: DataFrame, blocks: DataFrame, unit: int = 7 * DAY) -> DataFrame:
    """(account, key, start, end, milestones, blocks, is_current, place, stamp): one row a cycle, newest first. A block (account, start, end) counts in every cycle of which it touches a
    piece; ``is_current`` is the newest of an account; ``stamp`` changes with what the detail shows."""
    cycles = pieces.select("account", "key", "start", "end").distinct()
    m = detail.groupBy("account", "key", "start").agg(F.count("*").alias("milestones"), F.max("at").alias("latest"))
    u = lambda c: F.floor(c / unit)
    a = pieces.select("account", "key", F.col("start").alias("cycle"), "piece", "piece_end", F.explode(F.sequence(u(F.col("piece")), u(F.col("piece_end") - 1))).alias("_u"))
    b = blocks.select("account", F.col("start").alias("b0"), F.col("end").alias("b1")).distinct().withColumn("_u", F.explode(F.sequence(u(F.col("b0")), u(F.col("b1") - 1))))
    touched = a.join(b, ["account", "_u"]).where("b0 < piece_end and b1 > piece").select("account", "key", F.col("cycle").alias("start"), "b0").distinct().groupBy("account", "key", "start").agg(F.count("*").alias("blocks"))
    key = ["account", "key", "start"]
    w = Window.partitionBy("account").orderBy(F.desc("start"), F.desc("end"), F.desc("key"))
    full = cycles.join(m, key, "left").join(touched, key, "left").select(*key, "end", F.coalesce("milestones", F.lit(0)).alias("milestones"), F.coalesce("blocks", F.lit(0)).alias("blocks"), "latest").withColumn("place", F.row_number().over(w))
    stamp = F.md5(F.concat_ws("|", "account", "key", "start", "milestones", "blocks", F.coalesce(F.col("latest").cast("string"), F.lit("-"))))
    return full.select(*key, "end", "milestones", "blocks", (F.col("place") == 1).alias("is_current"), F.col("place").cast("long").alias("place"), stamp.alias("stamp"))


def running(rows: DataFrame, by: list[str], order: list[str], at: str, value: str, name: str, unit: int = DAY) -> DataFrame:
    """Adds the running total of a whole number per key in order, a row's own included. Sums of stretches of time are added up first, so no task sees
    all rows of a key."""
    u = F.floor(F.col(at) / unit).alias("_u")
    whole = rows.groupBy(*by, u).agg(F.sum(value).alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.partitionBy(*by).orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy(*by, "_u").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_u", u).withColumn("_i", inside).join(whole.select(*by, "_u", before.alias("_b")), [*by, "_u"]).withColumn(name, F.col("_b") + F.col("_i")).drop("_u", "_i", "_b")


def milestone_violations(stored: DataFrame, resets: DataFrame, costs: DataFrame, unit: int = 7 * DAY) -> DataFrame:
    """(id, kind): what is wrong with ``stored`` milestones (account, id, at, nano, reset_id), given ``resets`` (account, reset_id, at), one an instant, and ``costs`` (account, at, nano), times in microseconds. A milestone lies in the
    segment of the latest reset at or before it, number 0 before any; what it says must be the cost from there up to its instant, both included.

    kinds: unknown_reset, a number that the account has no reset of; segment, another reset than the one that counts; cost, another sum."""
    mark = lambda df, kind, extra: df.select("account", "at", F.lit(kind).alias("k"), (F.col("nano") if kind == 1 else F.lit(0)).cast("long").alias("v"), *extra)
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    # at one instant a reset comes first, then costs, then milestones
    line = mark(resets, 0, [*none("id", "nano"), F.col("reset_id")]).unionByName(mark(costs, 1, none("id", "nano", "reset_id"))).unionByName(mark(stored, 2, [F.col("id"), F.col("nano"), F.col("reset_id")]))
    line = running(line, ["account"], ["at", "k"], "at", "v", "total", DAY * 1_000_000).where("k <> 1")
    ends = line.where("k = 2").groupBy("account").agg(F.max("at").alias("_last"))
    w = Window.partitionBy("account").orderBy("at")
    segments = line.where("k = 0").join(ends, "account").select("account", F.col("reset_id").alias("_ref"), F.col("total").alias("_base"), "at", F.coalesce(F.lead("at").over(w), F.greatest("_last", "at") + 1).alias("_end"))
    segments = segments.select("account", "_ref", "_base", F.timestamp_micros("at").alias("start"), F.timestamp_micros("_end").alias("end"))
    m = assign(line.where("k = 2").withColumn("_ts", F.timestamp_micros("at")), segments, "_ts", unit, "left", by=["account"])
    known = resets.select("account", F.col("reset_id"), F.lit(True).alias("_known")).distinct()
    m = m.join(known, ["account", "reset_id"], "left")
    ref, base = F.coalesce("_ref", F.lit(0)), F.coalesce("_base", F.lit(0))
    stated = F.coalesce("reset_id", F.lit(0))
    kinds = F.array_compact(F.array(F.when((stated != 0) & F.col("_known").isNull(), "unknown_reset"), F.when((stated != ref) & ((stated == 0) | F.col("_known").isNotNull()), "segment"), F.when(~F.col("nano").eqNullSafe(F.col("total") - base), "cost")))
    return m.select("id", F.explode(kinds).alias("kind"))
