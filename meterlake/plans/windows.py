"""Weeks, cycles, attribution, forecasts and arbitration over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timekit import moment
from ..operators import attribution, forecasts, weeks
from ..sources.tables import table
from .registry import USAGE_SQL, query, usage

_ANCHORS = f"{USAGE_SQL}, a AS (SELECT account, min(epoch_us(ts) // 1000000)::BIGINT AS anchor FROM u GROUP BY account, (epoch_us(ts) // 1000000 + account * 100000) // 777600)"
UNTIL = 1_708_000_000


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each account in every nine days."""
    at = F.unix_seconds("ts")
    return usage(spark, sf_dir).groupBy("account", F.floor((at + F.col("account") * 100_000) / 777_600).alias("n")).agg(F.min(at).alias("anchor")).drop("n")


@query(f"""WITH RECURSIVE {_ANCHORS}, d AS (SELECT DISTINCT account, anchor FROM a), n AS (SELECT *, lead(anchor) OVER (PARTITION BY account ORDER BY anchor) AS nxt FROM d),
w AS (SELECT account, anchor AS start, nxt FROM n UNION ALL SELECT account, start + 604800, nxt FROM w WHERE CASE WHEN nxt IS NULL THEN start + 604800 < {UNTIL} ELSE nxt > start + 10.5::DOUBLE * 86400 END),
l AS (SELECT account, start, lead(start) OVER (PARTITION BY account ORDER BY start) AS nxt FROM w)
SELECT account, start, coalesce(least(nxt, start + 604800), start + 604800) AS "end" FROM l""")
def week_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weeks.generate(_anchors(spark, sf_dir), ["account"], UNTIL)


_ORDER_WEEKS = "w AS (SELECT o_custkey AS cust, s AS start, s + 604800 AS \"end\" FROM (SELECT DISTINCT o_custkey, (epoch(o_orderdate)::BIGINT // 604800) * 604800 AS s FROM orders))"


def _order_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    start = (F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 604800) * 604800).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), start.alias("start")).distinct().withColumn("end", F.col("start") + 604800)


@query(f"""WITH {_ORDER_WEEKS}, r AS (SELECT cust, "end", CASE WHEN cust % 3 = 0 THEN 'split' WHEN cust % 3 = 1 THEN 'early' ELSE 'late' END AS kind FROM w WHERE start % 5 = 0)
SELECT cust, start, CASE WHEN kind = 'early' THEN "end" - 86400 WHEN kind = 'split' THEN "end" - 172800 ELSE "end" END AS "end" FROM w LEFT JOIN r USING (cust, "end") WHERE kind IS NULL OR kind <> 'late'
UNION ALL SELECT cust, start + 86400, "end" FROM w JOIN r USING (cust, "end") WHERE kind = 'late' UNION ALL SELECT cust, "end" - 172800, "end" FROM w JOIN r USING (cust, "end") WHERE kind = 'split'""")
def week_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _order_weeks(spark, sf_dir)
    hit, kind = w.where("start % 5 = 0"), F.col("cust") % 3
    cut = hit.where(kind == 0).select("cust", F.col("end").alias("old_end"), F.col("end").alias("new_end"), (F.col("end") - 172800).alias("effective"))
    early = hit.where(kind == 1).select("cust", F.col("end").alias("old_end"), F.lit(-1).cast("long").alias("new_end"), (F.col("end") - 86400).alias("effective"))
    late = hit.where(kind == 2).select("cust", F.lit(-1).cast("long").alias("old_end"), F.col("end").alias("new_end"), (F.col("start") + 86400).alias("effective"))
    return weeks.apply_resets(w, cut.unionByName(early).unionByName(late), ["cust"])


@query(f"""WITH {USAGE_SQL}, f AS (SELECT session_id, max(ts) AS floor FROM u WHERE model = 'error' AND entry_id % 11 = 0 GROUP BY 1)
SELECT u.session_id, max(value) AS percent FROM u LEFT JOIN f USING (session_id) WHERE floor IS NULL OR ts >= floor GROUP BY 1""")
def floored_week_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).select("session_id", "ts", "model", "entry_id", F.col("value").alias("percent"))
    return weeks.floored_max(u, u.where("model = 'error' and entry_id % 11 = 0").select("session_id", F.col("ts").alias("floor")), ["session_id"])


_RESETS = f"{USAGE_SQL}, r AS (SELECT account, (epoch_us(ts) // 1000000)::BIGINT AS start, ((epoch_us(ts) // 1000000) // 18000 * 18000 + 18000 + k)::BIGINT AS reset FROM u)"


@query(f"""WITH {_RESETS}, j AS (SELECT *, CASE WHEN reset - lag(reset) OVER (PARTITION BY account ORDER BY reset, start) > 600 THEN 1 ELSE 0 END AS j FROM r),
c AS (SELECT *, sum(j) OVER (PARTITION BY account ORDER BY reset, start ROWS UNBOUNDED PRECEDING) AS c FROM j), g AS (SELECT account, c, min(start) AS start, max(reset) AS reset FROM c GROUP BY ALL),
n AS (SELECT account, start, least(reset, coalesce(lead(start) OVER (PARTITION BY account ORDER BY start, reset), reset)) AS "end" FROM g) SELECT * FROM n WHERE start < "end" """)
def quota_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_seconds("ts")
    r = usage(spark, sf_dir).select("account", at.alias("start"), ((F.floor(at / 18000) * 18000 + 18000 + F.col("k")).cast("long")).alias("reset"))
    return weeks.cycles(r, ["account"])


@query(f"""WITH {_RESETS}, o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY start, reset) AS n FROM r), x AS (SELECT *, CASE WHEN abs(reset - lag(reset) OVER (PARTITION BY account ORDER BY n)) < 600 THEN 0 ELSE 1 END AS new FROM o),
g AS (SELECT *, sum(new) OVER (PARTITION BY account ORDER BY n ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT account, start, reset, (first_value(reset) OVER (PARTITION BY account, g ORDER BY n) // 600 * 600)::BIGINT AS window_key FROM g""")
def canonical_window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_seconds("ts")
    r = usage(spark, sf_dir).select("account", at.alias("start"), ((F.floor(at / 18000) * 18000 + 18000 + F.col("k")).cast("long")).alias("reset"))
    return weeks.canonical_keys(r, ["account"], ["start", "reset"])


@query(f"""WITH {USAGE_SQL}, e AS (SELECT entry_id, project AS root, epoch_us(ts) // 1000000 AS ts FROM u),
w AS (SELECT project AS root, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + k * 6 AS "end", CASE WHEN account < 2 AND k < 50 THEN account END AS account FROM u)
SELECT entry_id, min(account) AS account FROM e JOIN w USING (root) WHERE e.ts >= start AND e.ts < "end" AND account IS NOT NULL GROUP BY 1 HAVING count(DISTINCT account) = 1""")
def spend_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).withColumn("at", F.unix_seconds("ts"))
    e = u.select("entry_id", F.col("project").alias("root"), F.col("at").alias("ts"))
    w = u.select(F.col("project").alias("root"), F.col("at").alias("start"), (F.col("at") + F.col("k") * 6).alias("end"), F.when((F.col("account") < 2) & (F.col("k") < 50), F.col("account")).alias("account"))
    return attribution.adopt_spend(e, w, 3600)


_ASSERT = f"{USAGE_SQL}, a AS (SELECT entry_id AS op_id, project AS axes, k, (entry_id % 2)::BIGINT AS account FROM u), g AS (SELECT min(entry_id) AS group_id, project AS axes, session_id, list(DISTINCT k) AS ks, bool_and(model <> 'view' OR k > 5) AS in_scope, max(CASE WHEN model = 'signup' AND k = 3 THEN account END) AS native FROM u GROUP BY project, session_id)"


@query(f"""WITH {_ASSERT}, h AS (SELECT op_id, min(group_id) AS lo, max(group_id) AS hi, bool_and(in_scope) AS in_scope, max(native) AS native FROM a JOIN g ON a.axes = g.axes AND list_contains(g.ks, a.k) GROUP BY 1),
j AS (SELECT a.op_id, a.account, lo, CASE WHEN lo IS NULL THEN 'dormant' WHEN lo <> hi THEN 'split' WHEN NOT in_scope THEN 'model_scoped' WHEN native IS NOT NULL THEN 'native' ELSE 'resolved' END AS outcome FROM a LEFT JOIN h USING (op_id)),
k AS (SELECT op_id, account, outcome, CASE WHEN outcome NOT IN ('dormant', 'split') THEN lo END AS group_id FROM j), c AS (SELECT group_id, min(account) <> max(account) AS clash FROM k WHERE outcome = 'resolved' GROUP BY 1)
SELECT op_id, account, CASE WHEN outcome = 'resolved' AND clash THEN 'conflict' ELSE outcome END AS outcome, group_id FROM k LEFT JOIN c USING (group_id)""")
def assertion_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    a = u.select(F.col("entry_id").alias("op_id"), F.col("project").alias("axes"), F.array("k").alias("resets"), (F.col("entry_id") % 2).alias("account"))
    g = u.groupBy(F.col("project").alias("axes"), "session_id").agg(
        F.min("entry_id").alias("group_id"), F.collect_set("k").alias("resets"), F.bool_and((F.col("model") != "view") | (F.col("k") > 5)).alias("in_scope"), F.max(F.when((F.col("model") == "signup") & (F.col("k") == 3), F.col("account"))).alias("native"))
    return attribution.resolve_assertions(a, g.drop("session_id"))


@query(f"""WITH {USAGE_SQL}, l AS (SELECT session_id * 100 + k AS task, entry_id AS placeholder FROM u WHERE model = 'click'), r AS (SELECT session_id * 100 + k AS task, entry_id AS notice FROM u WHERE model = 'view')
SELECT task, placeholder, notice FROM l JOIN r USING (task) WHERE task IN (SELECT task FROM l GROUP BY 1 HAVING count(*) = 1) AND task IN (SELECT task FROM r GROUP BY 1 HAVING count(*) = 1)""")
def unambiguous_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).withColumn("task", F.col("session_id") * 100 + F.col("k"))
    return attribution.unambiguous(u.where("model = 'click'").select("task", F.col("entry_id").alias("placeholder")), u.where("model = 'view'").select("task", F.col("entry_id").alias("notice")), "task")


@query(f"WITH {USAGE_SQL} SELECT session_id, k AS call, min(entry_id) AS owner, count(*) - 1 AS results FROM u GROUP BY ALL")
def fold_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.fold_owners(usage(spark, sf_dir).withColumnRenamed("k", "call"), ["session_id"], "call", "entry_id")


@query("WITH i AS (SELECT c_custkey AS identity, c_mktsegment AS label FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY identity) AS n FROM i) SELECT identity, label, CASE WHEN n = 1 THEN label ELSE label || ' (' || n || ')' END AS shown FROM n")
def collision_safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.collision_safe_labels(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"), F.col("c_mktsegment").alias("label")))


_STATE = f"""{USAGE_SQL}, s AS (SELECT session_id, arg_max(least(99.0::DOUBLE, value), (ts, entry_id)) AS percent, arg_max(least(99.0::DOUBLE, value), (ts, entry_id)) FILTER (WHERE ts <= TIMESTAMP '2024-01-19 12:00:00') AS percent_24h,
(epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-19 12:00:00'))) / 3.6e9 AS hours_24h, count(*) AS snapshots FROM u WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1),
t AS (SELECT *, 60.0::DOUBLE AS elapsed, 108.0::DOUBLE AS remaining, CASE WHEN percent > 0 THEN snapshots / percent END AS usd_per_pct FROM s)"""


@query(f"""WITH {_STATE}, r AS (SELECT *, percent / elapsed AS rate_avg, CASE WHEN percent_24h IS NOT NULL AND hours_24h > 0 THEN greatest(0.0::DOUBLE, (percent - percent_24h) / hours_24h) END AS rate_recent FROM t),
f AS (SELECT *, least(percent + rate_avg * remaining, percent + coalesce(rate_recent, rate_avg) * remaining) AS final_low, greatest(percent + rate_avg * remaining, percent + coalesce(rate_recent, rate_avg) * remaining) AS final_high, greatest(rate_avg, coalesce(rate_recent, 0)) AS worst FROM r)
SELECT session_id, percent, rate_avg, rate_recent, final_low, final_high, percent >= 100 OR final_high >= 100 AS reaches_cap, CASE WHEN percent < 100 AND final_high >= 100 AND worst > 0 AND (100 - percent) / worst < remaining THEN (100 - percent) / worst END AS hours_to_cap,
CASE WHEN percent < 90 THEN (90 - percent) * usd_per_pct / (remaining / 24) END AS usd_per_day_90, CASE WHEN percent < 100 THEN (100 - percent) * usd_per_pct / (remaining / 24) END AS usd_per_day_100,
concat_ws(',', CASE WHEN elapsed < 24 THEN 'elapsed_hours<24' END, CASE WHEN percent < 2 THEN 'percent<2' END, CASE WHEN snapshots < 3 THEN 'snapshots<3' END, CASE WHEN percent_24h IS NULL THEN 'no_sample_ge_24h' END) AS triggers FROM f""")
def weekly_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, day = F.expr("timestamp'2024-01-20 12:00:00'"), F.expr("timestamp'2024-01-19 12:00:00'")
    u = usage(spark, sf_dir).where(F.col("ts").between(F.expr("timestamp'2024-01-18 00:00:00'"), now)).withColumn("p", F.least(F.lit(99.0), "value"))
    old = F.col("ts") <= day
    s = u.groupBy("session_id").agg(
        F.max_by("p", moment("ts", "entry_id")).alias("percent"), F.max_by("p", F.when(old, moment("ts", "entry_id"))).alias("percent_24h"),
        ((F.unix_micros(now) - F.unix_micros(F.max(F.when(old, F.col("ts"))))) / 3.6e9).alias("hours_24h"), F.count("*").alias("snapshots"))
    s = s.withColumn("elapsed", F.lit(60.0)).withColumn("remaining", F.lit(108.0)).withColumn("usd_per_pct", F.when(F.col("percent") > 0, F.col("snapshots") / F.col("percent")))
    codes = F.array_join(forecasts.confidence_triggers(F.col("elapsed"), F.col("percent"), F.col("snapshots"), F.col("percent_24h").isNotNull()), ",")
    out = forecasts.weekly_forecast(s, [90, 100]).withColumn("triggers", codes)
    return out.select("session_id", "percent", "rate_avg", "rate_recent", "final_low", "final_high", "reaches_cap", "hours_to_cap", "usd_per_day_90", "usd_per_day_100", "triggers")


@query(f"""WITH {USAGE_SQL}, c AS (SELECT project, session_id, arg_max(k // 10, (ts, entry_id)) AS window_key, arg_max(least(100.0::DOUBLE, value), (ts, entry_id)) AS percent FROM u GROUP BY ALL), p AS (SELECT project, max(k // 10) - project % 2 AS window_key, avg(k)::DOUBLE AS percent FROM u GROUP BY 1),
n AS (SELECT project, arg_max(window_key, (window_key, percent)) AS window_key, arg_max(percent, (window_key, percent)) AS percent, count(*) AS sources FROM c GROUP BY 1)
SELECT n.project, n.window_key, n.percent, sources, CASE WHEN n.window_key > p.window_key THEN 'publish' WHEN n.window_key < p.window_key THEN 'ignore' WHEN n.percent > p.percent THEN 'publish' WHEN n.percent = p.percent THEN 'none' ELSE 'pending' END AS action FROM n JOIN p USING (project)""")
def candidate_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).withColumn("key", F.floor(F.col("k") / 10))
    at = moment("ts", "entry_id")
    c = u.groupBy("project", F.col("session_id").alias("source")).agg(F.max_by("key", at).alias("window_key"), F.max_by(F.least(F.lit(100.0), "value"), at).alias("percent"))
    p = u.groupBy("project").agg((F.max("key") - F.col("project") % 2).alias("window_key"), F.avg("k").alias("percent"))
    return forecasts.arbitrate(c, p, "project")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text)::BIGINT AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
s AS (SELECT conv_id, turn, chars, n, chars AS used, 0 AS segment FROM t WHERE n = 1 UNION ALL
SELECT t.conv_id, t.turn, t.chars, t.n, CASE WHEN s.used > 0 AND s.used + t.chars > 2000 THEN t.chars ELSE s.used + t.chars END, CASE WHEN s.used > 0 AND s.used + t.chars > 2000 THEN s.segment + 1 ELSE s.segment END FROM s JOIN t ON t.conv_id = s.conv_id AND t.n = s.n + 1)
SELECT conv_id, turn, chars, segment FROM s""")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return forecasts.segments(c, ["conv_id"], "turn", "chars", 2000)


@query(f"""WITH {USAGE_SQL}, t AS (SELECT session_id, ts, entry_id, CASE WHEN model = 'error' THEN 0 ELSE cache_read_tokens END AS cache_read_tokens, k * 150 AS cache_create_tokens FROM u),
h AS (SELECT *, max(cache_read_tokens) OVER (PARTITION BY session_id ORDER BY ts, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_cached FROM t)
SELECT entry_id, session_id, prev_cached, least(prev_cached, cache_create_tokens) AS tokens_recreated FROM h WHERE prev_cached > 0 AND cache_read_tokens = 0 AND cache_create_tokens >= 0.5 * prev_cached""")
def cache_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).withColumn("cache_read_tokens", F.when(F.col("model") == "error", 0).otherwise(F.col("cache_read_tokens"))).withColumn("cache_create_tokens", F.col("k") * 150)
    return forecasts.cache_rebuilds(u, ["session_id"], ["ts", "entry_id"]).select("entry_id", "session_id", "prev_cached", "tokens_recreated")


@query(f"WITH {USAGE_SQL}, p AS (SELECT 'a' AS source, ts::DATE AS day, count(*) AS n FROM u WHERE account = 0 GROUP BY 2 UNION ALL SELECT 'b', ts::DATE, count(*) FROM u WHERE account = 1 GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn, n - lead(n) OVER (PARTITION BY source ORDER BY day DESC) AS delta FROM p) SELECT source, day, n, delta FROM r WHERE rn <= CASE WHEN source = 'a' THEN 12 ELSE 8 END")
def provider_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of two providers side by side, never added up: the latest 12 and 8, each with the change on the one before."""
    u = usage(spark, sf_dir).withColumn("day", F.to_date("ts"))
    of = lambda a, s: u.where(F.col("account") == a).groupBy("day").agg(F.count("*").alias("n")).withColumn("source", F.lit(s))
    w = Window.partitionBy("source").orderBy(F.desc("day"))
    r = of(0, "a").unionByName(of(1, "b")).withColumn("rn", F.row_number().over(w)).withColumn("delta", F.col("n") - F.lead("n").over(w))
    return r.where(F.col("rn") <= F.when(F.col("source") == "a", 12).otherwise(8)).select("source", "day", "n", "delta")
