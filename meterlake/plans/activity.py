"""Weeks, blocks, quota and budget queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import hit_percent, nano, stable_sum
from ..functions.timekit import local_date
from ..operators import blocks, intervals, quota, reports
from ..operators.events import effective_events, insert_absent, prunable, rederivation_plan
from ..sources.tables import table
from .registry import USAGE_SQL, nano_sql, priced, priced_sql, query, sum_sql, usage

WEEK = 7 * 86_400
WEEKS_SQL = "weeks AS (SELECT row_number() OVER (ORDER BY s) - 1 AS week, s AS start, s + INTERVAL 7 DAY AS \"end\" FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-28 09:00:00', TIMESTAMP '2024-02-01 09:00:00', INTERVAL 7 DAY)) AS s))"


def sample_weeks(spark: SparkSession) -> DataFrame:
    """Subscription weeks from a Thursday, 09:00."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bounds = spark.range(1).select(F.expr("timestamp'2023-12-28 09:00:00'").alias("start"), F.expr("timestamp'2024-02-01 09:00:00'").alias("stop"))
    return intervals.weeks_between(bounds).withColumn("week", F.col("week").cast("long"))


@query(f"{priced_sql()}, {WEEKS_SQL} SELECT week, epoch_us(start) AS start_us, {sum_sql()} AS cost_usd, count(*) AS entries FROM e JOIN weeks ON ts >= start AND ts < \"end\" GROUP BY ALL")
def week_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = intervals.assign(priced(spark, sf_dir), sample_weeks(spark), "ts", WEEK)
    return e.groupBy("week", F.unix_micros("start").alias("start_us")).agg(stable_sum(F.col("cost")).alias("cost_usd"), F.count("*").alias("entries"))


@query("""WITH w AS (SELECT o_orderkey AS id, o_custkey AS cust, epoch(o_orderdate)::BIGINT AS start, epoch(o_orderdate)::BIGINT + 86400 * (5 + o_orderkey % 400) AS "end" FROM orders),
n AS (SELECT *, lead(start) OVER (PARTITION BY cust ORDER BY start) AS nxt FROM (SELECT cust, start, max("end") AS "end" FROM w GROUP BY ALL))
SELECT cust, start, CASE WHEN nxt > start AND nxt < "end" THEN nxt ELSE "end" END AS "end" FROM n""")
def week_overlap_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), start.alias("start"), (start + 86400 * (5 + F.col("o_orderkey") % 400)).alias("end"))
    return intervals.clamp_overlaps(o.groupBy("cust", "start").agg(F.max("end").alias("end")), by=["cust"])


@query(f"""{priced_sql()}, {WEEKS_SQL}, c AS (SELECT week, account, sum({nano_sql('cost')})::BIGINT AS nano FROM e JOIN weeks ON ts >= start AND ts < "end" GROUP BY ALL),
p AS (SELECT week, account, arg_max(least(100.0::DOUBLE, value), (ts, entry_id)) AS percent FROM u JOIN weeks ON ts >= start AND ts < "end" WHERE ts <= TIMESTAMP '2024-01-24 12:00:00' GROUP BY ALL),
d AS (SELECT c.week, c.account, c.nano, p.percent, CASE WHEN percent > 0 THEN nano / 1e9 / percent END AS usd_per_pct FROM c LEFT JOIN p USING (week, account))
SELECT week, account, nano, percent, usd_per_pct, (nano - lag(nano) OVER w) / 1e9 AS delta_usd, usd_per_pct - last_value(usd_per_pct IGNORE NULLS) OVER (PARTITION BY account ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta_rate
FROM d WINDOW w AS (PARTITION BY account ORDER BY week)""")
def weekly_dollars_per_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = sample_weeks(spark)
    c = intervals.assign(priced(spark, sf_dir), weeks, "ts", WEEK).groupBy("week", "account").agg(F.sum(nano(F.col("cost"))).alias("nano"))
    s = intervals.assign(usage(spark, sf_dir).withColumn("percent", F.least(F.lit(100.0), "value")), weeks, "ts", WEEK)
    p = intervals.as_of(s.select("week", "account", "ts", "entry_id", "percent"), ["week", "account"], "ts", "entry_id", F.col("ts") <= F.expr("timestamp'2024-01-24 12:00:00'"))
    d = c.join(p.select("week", "account", "percent"), ["week", "account"], "left").withColumn("usd_per_pct", F.when(F.col("percent") > 0, F.col("nano") / 1e9 / F.col("percent")))
    t = reports.trend(d, ["account"], "week", "usd_per_pct").withColumnRenamed("delta_known", "delta_rate").drop("delta_prev")
    from pyspark.sql import Window

    w = Window.partitionBy("account").orderBy("week")
    return t.withColumn("delta_usd", (F.col("nano") - F.lag("nano").over(w)) / 1e9)


_ORDERED = "(PARTITION BY session_id ORDER BY ts, entry_id)"

BLOCKS_SQL = f"""h AS (SELECT session_id, date_trunc('hour', ts) AS hour, min(ts) AS a, max(ts) AS z, count(*) AS n FROM u GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hour) AS rn FROM h),
b AS (SELECT session_id, rn, hour AS start FROM o WHERE rn = 1 UNION ALL
  SELECT o.session_id, o.rn, CASE WHEN o.hour >= b.start + INTERVAL 5 HOUR THEN o.hour ELSE b.start END FROM b JOIN o ON o.session_id = b.session_id AND o.rn = b.rn + 1),
k AS (SELECT b.session_id, b.start, b.start + INTERVAL 5 HOUR AS "end", min(a) AS first_ts, max(z) AS last_ts, sum(n)::BIGINT AS entries FROM b JOIN o USING (session_id, rn) GROUP BY ALL)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.fixed_blocks(usage(spark, sf_dir), ["session_id"])


def _us(df: DataFrame, **names: str) -> DataFrame:
    """Instants as microseconds, under new names."""
    return df.select(*[F.unix_micros(c).alias(f"{c}_us") if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query(f"WITH RECURSIVE {USAGE_SQL}, {BLOCKS_SQL} SELECT session_id, epoch_us(start) AS start_us, epoch_us(\"end\") AS end_us, epoch_us(first_ts) AS first_ts_us, epoch_us(last_ts) AS last_ts_us, entries FROM k")
def fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(_blocks(spark, sf_dir))


@query(f"""WITH RECURSIVE {USAGE_SQL}, {BLOCKS_SQL}, g AS (SELECT session_id, start, lag("end") OVER w AS prev_end, lag(last_ts) OVER w AS gap_start, first_ts AS gap_end FROM k WINDOW w AS (PARTITION BY session_id ORDER BY start))
SELECT session_id, epoch_us(gap_start) AS gap_start_us, epoch_us(gap_end) AS gap_end_us FROM g WHERE prev_end < start AND epoch_us(gap_end) - epoch_us(gap_start) >= 60000000""")
def block_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(blocks.gaps(_blocks(spark, sf_dir), ["session_id"]))


_NOW = "TIMESTAMP '2024-01-20 12:30:00'"


@query(f"""WITH RECURSIVE {USAGE_SQL}, {BLOCKS_SQL}, t AS (SELECT k.session_id, k.start, k."end", sum(input_tokens + output_tokens)::BIGINT AS total_tokens, {sum_sql('value')} AS cost_usd
  FROM k JOIN u ON u.session_id = k.session_id AND u.ts >= k.start AND u.ts < k."end" WHERE k.start <= {_NOW} AND k."end" > {_NOW} AND u.ts <= {_NOW} GROUP BY ALL),
m AS (SELECT *, (epoch_us({_NOW}) - epoch_us(start)) / 60e6 AS minutes FROM t)
SELECT session_id, epoch_us(start) AS start_us, total_tokens, cost_usd, CASE WHEN minutes > 0 THEN total_tokens / minutes END AS tokens_per_minute, CASE WHEN minutes > 0 THEN cost_usd / minutes * 60 END AS cost_per_hour,
CASE WHEN minutes > 0 THEN trunc(total_tokens / minutes * 300)::BIGINT END AS projected_tokens, CASE WHEN minutes > 0 THEN floor((epoch_us("end") - epoch_us({_NOW})) / 60e6)::BIGINT END AS remaining_minutes FROM m""")
def block_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are active at a fixed instant."""
    now = F.expr("timestamp'2024-01-20 12:30:00'")
    u = usage(spark, sf_dir)
    active = _blocks(spark, sf_dir).where((F.col("start") <= now) & (F.col("end") > now)).select("session_id", "start", "end")
    e = u.where(u.ts <= now).join(active, "session_id").where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    t = e.groupBy("session_id", "start", "end").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), stable_sum(F.col("value")).alias("cost_usd"))
    return _us(blocks.burn(t, now)).drop("end_us", "is_active")


@query(f"""WITH {USAGE_SQL}, s AS (SELECT *, ((epoch_us(ts) // 1000000 + 18000) // 600 * 600)::BIGINT AS e FROM u),
w AS (SELECT account, e, sum(n)::BIGINT AS support FROM (SELECT account, e, 1 AS n FROM s UNION ALL SELECT DISTINCT account, e, 1000 FROM s WHERE model = 'signup') GROUP BY ALL),
c AS (SELECT account, epoch_us(ts) AS at FROM u WHERE model = 'error' AND k = 50)
SELECT w.account, (e - 18000) * 1000000 AS window_start_us, coalesce(min(c.at), e * 1000000) AS window_end_us, support FROM w LEFT JOIN c ON c.account = w.account AND c.at > (e - 18000) * 1000000 AND c.at < e * 1000000 GROUP BY w.account, e, support""")
def recorded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = usage(spark, sf_dir).withColumn("resets_at", F.col("ts") + F.expr("interval 5 hours"))
    canonical = s.where("model = 'signup'").select("account", F.timestamp_seconds(F.floor(F.unix_seconds("resets_at") / 600) * 600).alias("window_end"))
    credits = s.where("model = 'error' and k = 50").select("account", F.col("ts").alias("credited_at"))
    return _us(blocks.recorded_windows(s, ["account"], canonical, credits))


@query(f"""WITH RECURSIVE {USAGE_SQL}, w AS (SELECT session_id, (epoch_us(ts) // 600000000)::BIGINT AS x, count(*) AS weight FROM u GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY x) AS n, count(*) OVER (PARTITION BY session_id ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING) AS p FROM w),
b AS (SELECT session_id, 0::BIGINT AS n, [0::BIGINT] AS best, [false] AS take FROM (SELECT DISTINCT session_id FROM o) UNION ALL
  SELECT o.session_id, o.n, list_append(best, greatest(best[o.n], best[o.p + 1] + weight)), list_append(take, best[o.p + 1] + weight >= best[o.n]) FROM b JOIN o ON o.session_id = b.session_id AND o.n = b.n + 1),
t AS (SELECT session_id, max(n) AS n, arg_max(take, n) AS take FROM b GROUP BY 1),
k AS (SELECT session_id, n, take FROM t UNION ALL SELECT k.session_id, CASE WHEN take[k.n + 1] THEN o.p ELSE k.n - 1 END, take FROM k JOIN o ON o.session_id = k.session_id AND o.n = k.n WHERE k.n > 0)
SELECT k.session_id, x FROM k JOIN o ON o.session_id = k.session_id AND o.n = k.n WHERE take[k.n + 1]""")
def interval_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-hour windows without overlaps that most samples support, per session."""
    s = usage(spark, sf_dir).select("session_id", (F.floor(F.unix_seconds("ts") / 600)).alias("x"), F.lit(1).cast("long").alias("weight"))
    return blocks.schedule(s, ["session_id"], 30)


_PCT = f"{USAGE_SQL}, s AS (SELECT session_id, ts, entry_id, least(100.0::DOUBLE, value) AS percent FROM u)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).select("session_id", "ts", "entry_id", F.least(F.lit(100.0), "value").alias("percent"))


@query(f"""WITH {_PCT}, h AS (SELECT *, floor(percent + 1e-9)::INTEGER AS p, max(floor(percent + 1e-9)::INTEGER) OVER (PARTITION BY session_id ORDER BY ts, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM s)
SELECT session_id, epoch_us(ts) AS ts_us, entry_id, unnest(generate_series(h + 1, p))::INTEGER AS percent FROM h WHERE h IS NOT NULL AND p > h""")
def percent_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(quota.milestones(_samples(spark, sf_dir), ["session_id"], ["ts", "entry_id"]))


@query(f"""WITH {_PCT}, v AS (SELECT u.session_id, u.ts, u.entry_id, sum({nano_sql('value')}) OVER (PARTITION BY u.session_id ORDER BY u.ts, u.entry_id)::BIGINT AS nano FROM u),
h AS (SELECT *, floor(percent + 1e-9)::INTEGER AS p, max(floor(percent + 1e-9)::INTEGER) OVER (PARTITION BY session_id ORDER BY ts, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM s),
c AS (SELECT session_id, ts, entry_id, unnest(generate_series(h + 1, p))::INTEGER AS percent FROM h WHERE h IS NOT NULL AND p > h),
j AS (SELECT c.*, v.nano / 1e9 AS cumulative FROM c JOIN v USING (session_id, ts, entry_id))
SELECT session_id, epoch_us(ts) AS ts_us, percent, cumulative, CASE WHEN row_number() OVER (PARTITION BY session_id, ts ORDER BY percent) = 1 THEN cumulative - coalesce(lag(cumulative) OVER (PARTITION BY session_id ORDER BY ts, percent), 0) ELSE 0 END AS marginal FROM j""")
def marginal_cost_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    u = usage(spark, sf_dir)
    running = F.sum(nano(F.col("value"))).over(Window.partitionBy("session_id").orderBy("ts", "entry_id").rowsBetween(Window.unboundedPreceding, 0))
    v = u.select("session_id", "ts", "entry_id", (running / 1e9).alias("cumulative"))
    c = quota.milestones(_samples(spark, sf_dir), ["session_id"], ["ts", "entry_id"]).join(v, ["session_id", "ts", "entry_id"])
    return _us(quota.marginal_costs(c, ["session_id"]).drop("entry_id"))


@query(f"""WITH {USAGE_SQL}, c AS (SELECT session_id, entry_id, epoch_us(ts) // 1000000 AS x FROM u), j AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY session_id ORDER BY x, entry_id) > 7200 THEN 1 ELSE 0 END AS jump FROM c),
k AS (SELECT *, sum(jump) OVER (PARTITION BY session_id ORDER BY x, entry_id ROWS UNBOUNDED PRECEDING) AS cluster FROM j)
SELECT session_id, cluster::BIGINT AS cluster, arg_min(x, entry_id) AS anchor, min(x) AS low, max(x) AS high, count(*) AS n FROM k GROUP BY ALL""")
def jitter_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that follow each other within two hours are one; its anchor is the one seen first."""
    c = usage(spark, sf_dir).select("session_id", "entry_id", F.unix_seconds("ts").alias("x"))
    return intervals.clusters(c, ["session_id"], "x", 7200, "entry_id").groupBy("session_id", "cluster").agg(F.min_by("x", "entry_id").alias("anchor"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))


@query(f"""WITH {USAGE_SQL}, p AS (SELECT DISTINCT account, epoch_us(ts) // 1000000 AS x FROM u WHERE model = 'click'), a AS (SELECT DISTINCT account, epoch_us(ts) // 1000000 AS anchor FROM u WHERE model = 'purchase'),
n AS (SELECT p.account, x, anchor, row_number() OVER (PARTITION BY p.account, x ORDER BY abs(x - anchor), anchor) AS rn FROM p LEFT JOIN a ON a.account = p.account AND abs(x - anchor) <= 600)
SELECT account, x, anchor FROM n WHERE rn = 1""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).withColumn("x", F.unix_seconds("ts"))
    points = u.where("model = 'click'").select("account", "x").distinct()
    anchors = u.where("model = 'purchase'").select("account", F.col("x").alias("anchor")).distinct()
    return intervals.nearest(points, anchors, 600, ["account"])


@query(f"""WITH {_PCT}, l AS (SELECT *, lag(percent) OVER {_ORDERED} AS prev_percent FROM s)
SELECT session_id, epoch_us(ts) AS ts_us, entry_id, percent, prev_percent FROM l WHERE prev_percent - percent >= 25 OR (percent <= 1 AND prev_percent - percent >= 3)""")
def reset_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(quota.resets(_samples(spark, sf_dir), ["session_id"], ["ts", "entry_id"]))


@query(f"WITH {_PCT} SELECT session_id, entry_id, percent, max(floor(percent * 10 + 0.5::DOUBLE) / 10) OVER (PARTITION BY session_id ORDER BY ts, entry_id ROWS UNBOUNDED PRECEDING) AS clamped FROM s")
def high_water_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.clamp_high_water(_samples(spark, sf_dir), ["session_id"], ["ts", "entry_id"]).select("session_id", "entry_id", "percent", "clamped")


@query(f"""WITH {USAGE_SQL}, l AS (SELECT session_id, entry_id, model, account, lag(model) OVER {_ORDERED} AS pm FROM u) SELECT session_id, entry_id, model FROM l WHERE pm IS NULL OR pm <> model""")
def run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.run_length(usage(spark, sf_dir), ["session_id"], ["ts", "entry_id"], ["model"]).select("session_id", "entry_id", "model")


@query(f"""WITH {_PCT}, b AS (SELECT s.*, TIMESTAMP '2024-01-21 00:00:00' AS now, TIMESTAMP '2024-01-23 00:00:00' AS reset FROM s WHERE ts <= TIMESTAMP '2024-01-21 00:00:00'),
r AS (SELECT *, CASE WHEN percent > lag(percent) OVER {_ORDERED} AND ts > lag(ts) OVER {_ORDERED} THEN 1 ELSE 0 END AS rose FROM b),
g AS (SELECT session_id, arg_max(percent, (ts, entry_id)) AS current, sum(rose)::BIGINT AS rises, max(ts) AS last_ts FROM r GROUP BY 1)
SELECT session_id, current, rises, CASE WHEN rises > 0 THEN current / 120.0::DOUBLE END AS rate_per_hour,
CASE WHEN rises > 0 THEN least(100.0::DOUBLE, greatest(current, current + (current / 120.0::DOUBLE) * (172800 / 3600.0::DOUBLE))) END AS projected,
CASE WHEN rises > 0 THEN CASE WHEN rises >= 4 THEN 'high' WHEN rises >= 2 THEN 'medium' ELSE 'low' END END AS confidence,
CASE WHEN (epoch_us(TIMESTAMP '2024-01-21 00:00:00') - epoch_us(last_ts)) / 1e6 > 3600 THEN 'stale' WHEN rises = 0 THEN 'insufficient-history' ELSE 'ok' END AS status FROM g""")
def quota_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.forecast(_samples(spark, sf_dir), ["session_id"], F.expr("timestamp'2024-01-21 00:00:00'"), 168, F.expr("timestamp'2024-01-23 00:00:00'"), ["ts", "entry_id"])


@query(f"""{priced_sql()}, s AS (SELECT account, {sum_sql()} AS spent FROM e WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), c AS (SELECT *, spent / 400.0::DOUBLE * 100 AS consumption FROM s)
SELECT account, spent, consumption, consumption / 0.5::DOUBLE AS projected, CASE WHEN consumption >= 100 THEN 'over' WHEN consumption / 0.5::DOUBLE >= 100 THEN 'warn' ELSE 'ok' END AS verdict,
((consumption + 1e-9 >= 50)::INTEGER + (consumption + 1e-9 >= 80)::INTEGER + (consumption + 1e-9 >= 100)::INTEGER)::BIGINT AS crossed FROM c""")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = priced(spark, sf_dir).where("ts < timestamp'2024-01-16'").groupBy("account").agg(stable_sum(F.col("cost")).alias("spent"))
    return quota.budget_status(spent, F.lit(400.0), F.lit(0.5), [50.0, 80.0, 100.0])


@query(f"""WITH {USAGE_SQL}, s AS (SELECT session_id, max(least(100.0::DOUBLE, value)) AS percent FROM u GROUP BY 1), t(threshold) AS (VALUES (50), (80), (90), (100)),
l AS (SELECT session_id, 50 AS threshold FROM s WHERE session_id % 2 = 0)
SELECT session_id, percent, threshold, CASE WHEN threshold >= 100 THEN 'critical' WHEN threshold >= 90 THEN 'warn' ELSE 'info' END AS severity FROM s JOIN t ON percent + 1e-9 >= threshold WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.session_id = s.session_id AND l.threshold = t.threshold)""")
def threshold_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.money import severity

    s = _samples(spark, sf_dir).groupBy("session_id").agg(F.max("percent").alias("percent"))
    latched = s.where("session_id % 2 = 0").select("session_id", F.lit(50).alias("threshold"))
    return quota.crossings(s, [50, 80, 90, 100], latched, ["session_id"]).withColumn("severity", severity(F.col("threshold")))


@query(f"""WITH {USAGE_SQL}, o AS (SELECT entry_id, k, project, CASE WHEN entry_id % 4 = 0 THEN NULL ELSE account END AS account FROM u), v AS (SELECT k, project, min(account) AS lo, max(account) AS hi FROM o GROUP BY ALL)
SELECT o.entry_id, o.account, coalesce(o.account, CASE WHEN lo = hi THEN lo END) AS adopted FROM o JOIN v USING (k, project)""")
def account_adoption_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = usage(spark, sf_dir).select("entry_id", "k", "project", F.when(F.col("entry_id") % 4 != 0, F.col("account")).alias("account"))
    return quota.single_vote(o, ["k", "project"], "account", "adopted").select("entry_id", "account", "adopted")


@query(f"""WITH {USAGE_SQL}, d AS (SELECT DISTINCT session_id, ts::DATE AS day FROM u), s AS (SELECT session_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT session_id FROM u))
SELECT session_id, day FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.session_id = s.session_id AND d.day = s.day)""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the month on which a session has no entry."""
    seen = usage(spark, sf_dir).select("session_id", local_date(F.col("ts")).alias("day")).distinct()
    spine = seen.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))).alias("day"))
    return spine.join(seen, ["session_id", "day"], "left_anti")


@query(f"""WITH {USAGE_SQL} SELECT entry_id, EXISTS (SELECT 1 FROM u r WHERE r.session_id = u.session_id AND r.model = 'error' AND r.ts > u.ts AND r.ts <= u.ts + INTERVAL 6 HOUR) AS followed FROM u""")
def exists_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an error follows within six hours: one ordered window instead of a join."""
    from pyspark.sql import Window

    # the next error's time, from the latest entry on, so that the frame only grows
    at = F.unix_micros("ts")
    w = Window.partitionBy("session_id").orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1)
    nxt = F.min(F.when(F.col("model") == "error", at)).over(w)
    return usage(spark, sf_dir).select("entry_id", F.coalesce(nxt - at <= 6 * 3_600_000_000, F.lit(False)).alias("followed"))


@query(f"""WITH RECURSIVE {USAGE_SQL}, {BLOCKS_SQL}, {WEEKS_SQL} SELECT session_id, epoch_us(k.start) AS a_start_us, week FROM k JOIN weeks w ON k.start < w."end" AND w.start < k."end" """)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the weeks that they touch, two if a boundary lies inside."""
    a = _blocks(spark, sf_dir).select("session_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = sample_weeks(spark).select("week", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return intervals.overlapping(a, b, WEEK).select("session_id", F.unix_micros("a_start").alias("a_start_us"), "week")


_RECORDS = f"{USAGE_SQL}, r AS (SELECT session_id * 1000 + k AS id, entry_id % 3 AS rev, entry_id AS seq, CASE WHEN model = 'error' THEN 'tombstone' ELSE 'active' END AS status, model || coalesce(speed, '') AS digest FROM u)"
_EFFECTIVE = "w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rev DESC, seq) AS rn, min(digest) OVER (PARTITION BY id, rev) <> max(digest) OVER (PARTITION BY id, rev) AS conflict FROM r), eff AS (SELECT id, rev, seq, digest, conflict FROM w WHERE rn = 1 AND status = 'active')"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).select(
        (F.col("session_id") * 1000 + F.col("k")).alias("id"), (F.col("entry_id") % 3).alias("rev"), F.col("entry_id").alias("seq"),
        F.when(F.col("model") == "error", "tombstone").otherwise("active").alias("status"), F.concat("model", F.coalesce("speed", F.lit(""))).alias("digest"))


@query(f"WITH {_RECORDS}, {_EFFECTIVE} SELECT * FROM eff")
def effective_event_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective_events(_records(spark, sf_dir))


@query(f"""WITH {_RECORDS}, {_EFFECTIVE}, d AS (SELECT id, min(digest) AS digest FROM r WHERE id % 5 <> 0 GROUP BY 1)
SELECT id, CASE WHEN eff.digest IS NULL THEN 'insert' WHEN d.digest IS NULL THEN 'tombstone' ELSE 'update' END AS action FROM d FULL JOIN eff USING (id) WHERE eff.digest IS NULL OR d.digest IS NULL OR d.digest <> eff.digest""")
def rederivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return rederivation_plan(r.where("id % 5 <> 0").groupBy("id").agg(F.min("digest").alias("digest")), effective_events(r))


@query(f"WITH {USAGE_SQL}, t AS (SELECT session_id, model, count(*) AS n FROM u WHERE ts < TIMESTAMP '2024-01-03' GROUP BY ALL), r AS (SELECT session_id, model, count(*) AS n FROM u WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY ALL) SELECT * FROM t UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = r.session_id AND t.model = r.model)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    count = lambda x: x.groupBy("session_id", "model").agg(F.count("*").alias("n"))
    return insert_absent(count(u.where("ts < timestamp'2024-01-03'")), count(u.where("ts >= timestamp'2024-01-03'")), ["session_id", "model"])


@query(f"WITH {USAGE_SQL} SELECT session_id, epoch_us(max(ts)) AS last_ts_us FROM u GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
def retention_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(prunable(usage(spark, sf_dir), "session_id", "ts", F.expr("timestamp'2024-01-30 12:00:00'")))


@query("""SELECT l_orderkey AS orderkey, sum(l_quantity)::DOUBLE AS quantity, count(*) AS items FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY GROUP BY 1""")
def quota_block_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that fall in the 30 days of their order: an equality with a range as residual."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_quantity", "l_shipdate")
    j = li.join(o, (li.orderkey == o.orderkey) & (li.l_shipdate >= o.o_orderdate) & (li.l_shipdate < o.o_orderdate + F.expr("interval 30 days"))).select(li.orderkey, "l_quantity")
    return j.groupBy("orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("items"))


@query(f"{priced_sql()} SELECT session_id, CASE WHEN sum(input_tokens + cache_create_tokens + cache_read_tokens) = 0 THEN 0.0 ELSE sum(cache_read_tokens)::BIGINT / sum(input_tokens + cache_create_tokens + cache_read_tokens)::BIGINT * 100 END AS hit_pct, count(*) AS entries FROM e GROUP BY 1")
def cache_hit_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = priced(spark, sf_dir).groupBy("session_id").agg(F.sum("input_tokens").alias("i"), F.sum("cache_create_tokens").alias("c"), F.sum("cache_read_tokens").alias("r"), F.count("*").alias("entries"))
    return g.select("session_id", hit_percent(F.col("i"), F.col("c"), F.col("r")).alias("hit_pct"), "entries")
