"""Cache reports, comparisons of two windows, trends, attribution and client-side shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_median(rows: DataFrame, by: list[str], n: str, value: str, window: int, least: int) -> DataFrame:
    """Adds ``baseline``, the median of ``value`` over the ``window`` whole steps of ``n`` before a row, itself left out, and
    ``samples``; null if there are fewer than ``least``. One sort per key."""
    w = Window.partitionBy(*by).orderBy(n).rangeBetween(-window, -1)
    s = rows.withColumn("samples", F.count(value).over(w))
    return s.withColumn("baseline", F.when(F.col("samples") >= least, F.percentile(value, F.lit(0.5)).over(w)))


def anomalies(rows: DataFrame, drop_points: float) -> DataFrame:
    """Flags of rows (hit, baseline, net): net_negative, cache_drop; without a baseline a drop is unevaluated, not absent."""
    drop = F.when(F.col("baseline") - F.col("hit") >= drop_points, "cache_drop")
    flags = F.array_compact(F.array(F.when(F.col("net") < 0, "net_negative"), drop))
    return rows.withColumn("flags", F.array_join(flags, ",")).withColumn("unevaluated", F.col("baseline").isNull())


def verdict(rows: DataFrame) -> DataFrame:
    """Adds ``verdict`` to rows with flags and unevaluated: anomaly if there is a flag, else unevaluated if a test could not be made, else
    ok; without any rows a report says no_data, which a left join from the keys that were asked for gives."""
    flagged = F.coalesce("flags", F.lit("")) != ""
    return rows.withColumn("verdict", F.when(F.col("unevaluated").isNull(), "no_data").when(flagged, "anomaly").when(F.col("unevaluated"), "unevaluated").otherwise("ok"))


def of_account(account: object, column: str = "account") -> Column:
    """Rows of one account; no account means all of them, merged."""
    return F.lit(True) if account is None else F.col(column) == account


def row_contains(columns: list[str], text: str) -> Column:
    """Whether a row's visible columns, written one after the other, hold a text, ignoring case."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lit(text.lower()))


#: Columns that a comparison's sections show.
SECTION_COLUMNS = {"overall": ["cost_usd", "entries"], "models": ["model", "cost_usd", "entries", "hit_pct"], "cache": ["hit_pct", "read_tokens"]}


def per_day(rows: DataFrame, a_days: float, b_days: float, costs: dict[str, float], tolerance: float = 0.01) -> DataFrame:
    """Costs (column -> days of its window) divided by days if two windows differ in length by more than ``tolerance`` days; counts of
    tokens and percentages stay."""
    if abs(a_days - b_days) <= tolerance:
        return rows
    return rows.withColumns({c: F.col(c) / d for c, d in costs.items() if d > 0})


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two windows side by side by key: new, dropped or changed; the change, and in percent where the base isn't 0."""
    x, y = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    j = x.join(y, key, "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "dropped").otherwise("changed")
    delta = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    return j.select(key, "a", "b", status.alias("status"), delta.alias("delta"), F.when(F.col("a") != 0, F.try_divide(delta, "a") * 100).alias("delta_pct"))


def quiet(rows: DataFrame, least_delta: float, least_pct: float, top: int) -> DataFrame:
    """Hides changed rows that moved little in both measures and changed rows past the ``top`` largest, which get their rank ``rn``; new
    and dropped ones stay, unranked. The largest are cut by a top-n, so nothing but ``top`` rows meets in one task."""
    small = (F.abs("delta") < least_delta) & (F.abs(F.coalesce("delta_pct", F.lit(0.0))) < least_pct)
    order = [F.abs("delta").desc(), F.col(rows.columns[0])]
    best = rows.where((F.col("status") == "changed") & ~small).orderBy(*order).limit(top).withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    return best.unionByName(rows.where("status <> 'changed'").withColumn("rn", F.lit(None).cast("int")))


def hidden(rows: DataFrame, least_delta: float, least_pct: float, top: int) -> DataFrame:
    """How many rows ``quiet`` hides: (noise, past_top)."""
    small = (F.abs("delta") < least_delta) & (F.abs(F.coalesce("delta_pct", F.lit(0.0))) < least_pct)
    g = rows.where("status = 'changed'").agg(F.count(F.when(small, 1)).alias("noise"), F.count(F.when(~small, 1)).alias("_n"))
    return g.select("noise", F.greatest(F.lit(0).cast("long"), F.col("_n") - top).alias("past_top"))


#: Orders of a comparison's rows, ties by key: (name, columns).
DIFF_ORDERS = {"delta": ["-abs(delta)"], "cost-a": ["-coalesce(a, 0)"], "cost-b": ["-coalesce(b, 0)"], "name": [], "status": ["case status when 'dropped' then 0 when 'changed' then 1 else 2 end", "-abs(delta)"]}
#: Orders of rows of a cache report (at, key, net, hit_pct, cost, anomaly), ties by time and key; anomalies come first, then by time.
CACHE_ORDERS = {"date": [], "net": ["net"], "cache": ["hit_pct"], "recent": ["-at"], "cost": ["-cost"], "anomaly": ["if(anomaly, 0, 1)"]}
#: Orders of sessions (cost, minutes, model, project, started).
SESSION_ORDERS = {"cost desc": ["-coalesce(cost, 0)"], "duration desc": ["-coalesce(minutes, 0)"], "model asc": ["coalesce(model, '')"], "project asc": ["coalesce(project, '')"], "started desc": ["-coalesce(started, 0)"]}
#: Orders of projects (cost, used, name, last_seen): unknown use is less than none; ties by name without case, ascending in either direction.
PROJECT_ORDERS = {f"{k} {d}": [f"{'-' if d == 'desc' else ''}{x}"] for k, x in (("cost", "cost"), ("used", "coalesce(used, -1)"), ("last-seen", "last_seen")) for d in ("asc", "desc")} | {"name asc": ["lower(name)"], "name desc": ["desc lower(name)"]}


def first_in_order(rows: DataFrame, orders: dict[str, list[str]], ties: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in each of several orders, one top-n each: (sort, place, *)."""
    out = None
    for name, by in orders.items():
        order = [F.expr(x[5:]).desc() if x.startswith("desc ") else F.expr(x) for x in [*by, *ties]]
        part = rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("sort", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def last_periods(rows: DataFrame, period: str, n: int) -> DataFrame:
    """The rows of the ``n`` latest periods that there are."""
    latest = rows.select(period).distinct().orderBy(F.desc(period)).limit(n)
    return rows.join(F.broadcast(latest), period)


def displayed_span(rows: DataFrame, start: str, end: str) -> DataFrame:
    """From the first start to the last end."""
    return rows.agg(F.min(start).alias("start"), F.max(end).alias("end"))


def dominant(rows: DataFrame, period: str, key: str, value: str, share: float = 0.60) -> DataFrame:
    """The key that holds ``share`` of a period or more, if one does."""
    g = rows.groupBy(period).agg(F.sum(value).alias("whole"), F.max_by(key, value).alias(key), F.max(value).alias("most"))
    return g.where(F.col("most") >= share * F.col("whole")).select(period, key, F.try_divide("most", "whole").alias("share"))


def attribute(costs: DataFrame, period: str, key: str, percents: DataFrame) -> DataFrame:
    """``costs`` (period, key, cost) and ``percents`` (period, percent): each key's cost and its share of every period's percent. The
    denominator is the whole period, taken before any filter; null if no period has a percent."""
    total = costs.groupBy(period).agg(F.sum("cost").alias("whole"))
    j = costs.join(total, period).join(percents, period, "left")
    return j.groupBy(key).agg(F.sum("cost").alias("cost"), F.sum(F.try_divide("cost", "whole") * F.col("percent")).alias("used_pct"))


def trend(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds the change against the row before and against the last known value."""
    w = Window.partitionBy(*by).orderBy(order)
    known = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("delta_prev", F.col(value) - F.lag(value).over(w)).withColumn("delta_known", F.col(value) - known)


def spark_heights(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``height``, 1 to 8, between the key's least and largest value; halves go to the even number. A constant is 1."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    h = F.bround((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 7) + 1
    return rows.withColumn("height", F.coalesce(F.least(F.lit(8.0), F.greatest(F.lit(1.0), h)), F.lit(1.0)).cast("int"))


def fill_days(rows: DataFrame, day: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Every day from the first to the last of each key, with 0 where ``rows`` has none."""
    by = by or []
    spine = rows.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null").select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))
    return spine.join(rows, [*by, day], "left").select(*by, day, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def intensity(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``level``: 0 if the value isn't positive, else its fifth among positive ones, 1 to 5, equal values at the lowest rank.

    Ranks come from counts: of distinct values within 64 classes to a doubling, and of the classes, of which there are a few
    thousand at most, whatever the number of rows."""
    pos = rows.where(F.col(value) > 0)
    counts = pos.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_c", F.floor(F.log2(F.col(value)) * 64))
    classes = counts.groupBy("_c").agg(F.sum("_n").alias("_m"))
    below = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select("_c", below("_m", Window.orderBy("_c")).alias("_before"), F.sum("_m").over(Window.partitionBy()).alias("_all"))
    ranked = counts.withColumn("_inside", below("_n", Window.partitionBy("_c").orderBy(value))).join(classes, "_c")
    level = F.greatest(F.lit(1), F.least(F.lit(5), F.ceil((F.col("_before") + F.col("_inside") + 1) / F.col("_all") * 5)))
    levels = ranked.select(value, level.cast("int").alias("level"))
    return rows.join(levels, value, "left").withColumn("level", F.coalesce("level", F.lit(0))).select(*rows.columns, "level")


def cost_share(rows: DataFrame, value: str) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy())
    return rows.withColumn("pct", F.when(total > 0, F.col(value) / total * 100))


def page_after(rows: DataFrame, key: str, cursor: Column | None, size: int) -> DataFrame:
    """The next ``size`` rows by key past a cursor: a pushed filter and a top-n, never an offset."""
    return page(rows, key, size, after=cursor)


def page(rows: DataFrame, key: str, size: int, after: Column | None = None, before: Column | None = None, tail: bool = False) -> DataFrame:
    """A page of at most ``size`` rows in order of key: those next past ``after``, those last ahead of ``before``, or with ``tail`` the
    last of all; no two of them go together. A cursor whose row is gone gives an empty page."""
    if (after is not None) + (before is not None) + tail > 1:
        raise ValueError("after, before and tail exclude each other")
    if after is None and before is None and not tail:
        return rows.orderBy(key).limit(size)
    cursor = after if after is not None else before
    if cursor is not None:
        there = rows.where(F.col(key) == cursor).exists()
        rows = rows.where(there).where(F.col(key) > cursor if after is not None else F.col(key) < cursor)
    return rows.orderBy(key if after is not None else F.desc(key)).limit(size).orderBy(key)


def any_contains(columns: list[str], patterns: list[str]) -> Column:
    """Whether any column holds any of the patterns, ignoring case; no patterns hold everywhere."""
    if not patterns:
        return F.lit(True)
    hay = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    out = F.lit(False)
    for h in hay:
        for p in patterns:
            out = out | F.contains(h, F.lit(p.lower()))
    return out


def merge_partials(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Sums by key over stored partial sums, a day's or a batch's each; adding a part never reads the entries of others again."""
    out = parts[0].select(*keys, *sums)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys, *sums))
    return out.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def mean_of_enough(rows: DataFrame, by: list[str], value: str, least: int = 3) -> DataFrame:
    """The mean per key of known values; null if there are fewer than ``least``."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("_m")).select(*by, "n", F.when(F.col("n") >= least, F.col("_m")).alias("mean"))


def footer_legs(rows: DataFrame, source: str, value: str, sources: DataFrame) -> DataFrame:
    """Count and sum per source, zero for those of the fixed list that have no rows."""
    g = rows.groupBy(source).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sources.join(g, source, "left").select(source, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


def ranked_trend(rows: DataFrame, period: str, key: str, value: str, n: int) -> DataFrame:
    """Per period the values of the ``n`` keys that are largest in all, and the rest as (other); ``share``: the key's part of the period."""
    best = rows.groupBy(key).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), key).limit(n).select(F.col(key).alias("_k"))
    named = rows.join(F.broadcast(best), F.col(key) == F.col("_k"), "left").withColumn("name", F.coalesce(F.col("_k").cast("string"), F.lit("(other)")))
    g = named.groupBy(period, "name").agg(F.sum(value).alias("value"))
    return g.withColumn("share", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy(period))))


def zoom(rows: DataFrame, by: list[str], value: str, pad: float = 0.1) -> DataFrame:
    """Bounds of a chart: least and largest value with a margin, not below 0."""
    g = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.select(*by, F.greatest(F.lit(0.0), F.col("lo") - (F.col("hi") - F.col("lo")) * pad).alias("low"), (F.col("hi") + (F.col("hi") - F.col("lo")) * pad).alias("high"))


def sorted_by(rows: DataFrame, column: str, label: str, descending: bool = True) -> DataFrame:
    """Nulls last in either direction, ties by label without case, ascending."""
    first = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return rows.orderBy(first, F.lower(F.col(label).cast("string")), label)


def combine_providers(legs: list[tuple[str, DataFrame | None]], key: str, sums: list[str]) -> DataFrame:
    """Sums of providers that are there; one that isn't contributes nothing, and if none is there is nothing to combine."""
    there = [(n, d) for n, d in legs if d is not None]
    if not there:
        raise ValueError("no provider is available")
    out = None
    for n, d in there:
        d = d.select(key, *sums, F.lit(n).alias("provider"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy(key).agg(*[F.sum(s).alias(s) for s in sums], F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
