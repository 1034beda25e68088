"""Quota observations: history, milestones, resets, forecasts, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import whole_percent
from ..functions.timekit import moment


def _ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def run_length(samples: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Drops a row that repeats the values of the one before it; nulls are values."""
    w = _ordered(by, order)
    state = F.struct(*values)
    before = F.lag(F.struct(F.lit(True).alias("there"), state.alias("state"))).over(w)
    return samples.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col("_b.state").eqNullSafe(state)).drop("_b")


def milestones(samples: DataFrame, by: list[str], order: list[str], percent: str = "percent") -> DataFrame:
    """A row for each whole percent that a sample passes first, after the first sample of its key: (*by, *order, percent)."""
    w = _ordered(by, order)
    p = whole_percent(F.col(percent)).cast("int")
    high = F.max("_p").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = samples.withColumn("_p", p).withColumn("_h", high).where("_h is not null and _p > _h")
    return s.select(*by, *order, F.explode(F.sequence(F.col("_h") + 1, F.col("_p"))).alias("percent"))


def marginal_costs(crossings: DataFrame, by: list[str]) -> DataFrame:
    """``crossings`` (*by, ts, percent, cumulative): adds the cost since the crossing before; of thresholds passed by one sample the
    lowest bears it all and the others 0."""
    w = Window.partitionBy(*by).orderBy("ts", "percent")
    first = F.row_number().over(Window.partitionBy(*by, "ts").orderBy("percent")) == 1
    before = F.coalesce(F.lag("cumulative").over(w), F.lit(0.0))
    return crossings.withColumn("marginal", F.when(first, F.col("cumulative") - before).otherwise(0.0))


def resets(samples: DataFrame, by: list[str], order: list[str], drop: float = 25.0, floor: float = 1.0, floor_drop: float = 3.0) -> DataFrame:
    """Samples at which the percent falls by ``drop`` or more, or to ``floor`` or less by ``floor_drop`` or more; never across keys."""
    w = _ordered(by, order)
    s = samples.withColumn("prev_percent", F.lag("percent").over(w))
    fell = F.col("prev_percent") - F.col("percent")
    return s.where((fell >= drop) | ((F.col("percent") <= floor) & (fell >= floor_drop)))


def week_resets_seen(samples: DataFrame, by: list[str], order: list[str], live: bool = False) -> DataFrame:
    """Samples (*by, *order, ts, percent, week_end) at which a week was reset: the percent falls as ``resets`` says while the week of the
    sample before is still open and the end named is that week's or a later one. A fall to nothing that is less than the large one counts
    only ``live``, where a state confirms it; a scan of history takes it for a blip."""
    w = _ordered(by, order)
    s = samples.withColumn("_end", F.lag("week_end").over(w))
    floor_drop = 3.0 if live else 25.0
    fell = resets(s, by, order, floor_drop=floor_drop)
    return fell.where((F.col("_end") > F.col("ts")) & (F.col("week_end") >= F.col("_end"))).drop("_end")


def clamp_high_water(samples: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``clamped``: the percent, or the highest before it, to a tenth."""
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("clamped", F.max(F.floor(F.col("percent") * 10 + 0.5) / 10).over(w))


def forecast(samples: DataFrame, by: list[str], as_of: Column, window_hours: float, reset: Column, order: list[str]) -> DataFrame:
    """Per key: the current percent, its rate since the cycle began, the projection to the reset, samples that rose, confidence,
    status. Missing is null, never 0."""
    w = _ordered(by, order)
    s = samples.where(F.col("ts") <= as_of)
    rose = (F.col("percent") > F.lag("percent").over(w)) & (F.col("ts") > F.lag("ts").over(w))
    s = s.withColumn("_rose", F.coalesce(rose.cast("int"), F.lit(0)))
    g = s.groupBy(*by).agg(F.max_by("percent", moment(*order)).alias("current"), F.sum("_rose").alias("rises"), F.max("ts").alias("last_ts"))
    end, elapsed = reset, None
    elapsed = F.least(F.lit(float(window_hours)), F.greatest(F.lit(0.0), window_hours - (F.unix_micros(end) - F.unix_micros(as_of)) / 3.6e9))
    left = F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(as_of)) / 1e6))
    known = (F.col("rises") > 0) & (elapsed > 0)
    rate = F.col("current") / elapsed
    share = elapsed / window_hours
    confidence = F.when((F.col("rises") >= 4) & (share >= 0.25), "high").when((F.col("rises") >= 2) & (share >= 0.10), "medium").otherwise("low")
    stale = max(900, min(int(window_hours * 3600) // 10, 3600))
    age = (F.unix_micros(as_of) - F.unix_micros("last_ts")) / 1e6
    return g.select(
        *by, "current", "rises", F.when(known, rate).alias("rate_per_hour"),
        F.when(known, F.least(F.lit(100.0), F.greatest(F.col("current"), F.col("current") + rate * (left / 3600)))).alias("projected"),
        F.when(known, confidence).alias("confidence"), F.when(age > stale, "stale").when(F.col("rises") == 0, "insufficient-history").otherwise("ok").alias("status"))


def budget_status(spend: DataFrame, target: Column, elapsed_share: Column, thresholds: list[float]) -> DataFrame:
    """``spend`` (key columns, spent): consumption in percent, pace against the share of time gone, verdict, thresholds crossed."""
    used = F.col("spent") / target * 100
    crossed = F.filter(F.array(*map(F.lit, thresholds)), lambda t: used + 1e-9 >= t)
    projected = used / elapsed_share
    verdict = F.when(used >= 100, "over").when(projected >= 100, "warn").otherwise("ok")
    return spend.select("*", used.alias("consumption"), projected.alias("projected"), verdict.alias("verdict"), F.size(crossed).cast("long").alias("crossed"))


def crossings(spend: DataFrame, thresholds: list[int], latched: DataFrame, keys: list[str]) -> DataFrame:
    """Thresholds reached (percent + 1e-9 >= threshold) and not latched before; each fires once."""
    reached = spend.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("percent") + 1e-9 >= t)))
    return reached.join(latched, [*keys, "threshold"], "left_anti")


def claims(windows: DataFrame, thresholds: list[int], keys: list[str]) -> DataFrame:
    """(*keys, threshold, kind) of quota windows (*keys, percent, projected): thresholds that the percent has reached are actual, those that
    only the projection reaches are projected; an actual claim leaves no projected one at its threshold."""
    t = windows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    kind = F.when(F.col("percent") >= F.col("threshold"), "actual").when(F.col("projected") >= F.col("threshold"), "projected")
    return t.select(*keys, "threshold", kind.alias("kind")).where("kind is not null")


def single_vote(rows: DataFrame, group: list[str], vote: str, out: str) -> DataFrame:
    """A row without ``vote`` adopts the one that its group agrees on; none, if there is no or more than one."""
    v = rows.groupBy(*group).agg(F.min(vote).alias("_lo"), F.max(vote).alias("_hi"))
    joined = rows.join(v, group)
    return joined.withColumn(out, F.coalesce(F.col(vote), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))).drop("_lo", "_hi")


def quota_blocks(samples: DataFrame, by: list[str], reset: str, order: list[str]) -> DataFrame:
    """One row per key and canonical reset: first and last observation, the current and the highest percent, samples."""
    at = moment(*order)
    return samples.groupBy(*by, reset).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("percent", at).alias("current"), F.max("percent").alias("highest"), F.count("*").alias("samples"))


def credits(samples: DataFrame, by: list[str], order: list[str], drop: float = 5.0) -> DataFrame:
    """Falls of ``drop`` or more while the reset of the sample before is still ahead."""
    w = _ordered(by, order)
    s = samples.withColumn("prev_percent", F.lag("percent").over(w)).withColumn("_r", F.lag("resets_at").over(w))
    return s.where((F.col("_r") > F.col("ts")) & (F.col("prev_percent") - F.col("percent") >= drop)).drop("_r")


def plausible(epoch: Column, now: Column, past: int = 300, ahead: int = 8 * 86_400) -> Column:
    """Whether a reset time lies in a believable band around now."""
    return epoch.between(now - past, now + ahead)


def validate_thresholds(values: list[float]) -> list[float]:
    """Positive, ascending and distinct, or an error."""
    if not values or any(v <= 0 for v in values) or any(b <= a for a, b in zip(values, values[1:])):
        raise ValueError(f"thresholds must be positive and ascending: {values!r}")
    return list(values)
