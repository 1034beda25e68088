"""Sessions, price fallbacks, cache use by session, and the orders in which reports list them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cache_dollars, cumulative_entry_cost, entry_cost, hit_percent, nano, sample_prices, stable_sum, with_prices_or_fallback
from ..operators import reports, sessions
from .analysis import _CACHE, _two, _windows
from .registry import PRICES_SQL, ROLLUP_SQL, USAGE_SQL, calculated_sql, nano_sql, priced, priced_sql, query, sum_sql, tier_sql, usage

# Entries stand in three files a session; one file in three isn't known to belong to a session.
_PATH = "'p' || project || '/' || session_id || '-' || entry_id % 3 || '.jsonl'"
_FILES_SQL = f"""p AS (SELECT *, {_PATH} AS path FROM e),
f AS (SELECT DISTINCT path, CASE WHEN entry_id % 3 < 2 THEN session_id::VARCHAR END AS file_session, CASE WHEN entry_id % 3 = 1 THEN 'p' || project END AS project_path FROM p),
j AS (SELECT p.*, coalesce(file_session, regexp_extract(path, '([^/]*)\\.jsonl$', 1)) AS session, project_path FROM p LEFT JOIN f USING (path))"""


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("entry_id") % 3
    e = priced(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), "project", F.lit("/"), "session_id", F.lit("-"), part, F.lit(".jsonl")))
    files = e.select("path", F.when(part < 2, F.col("session_id")).alias("session_id"), F.when(part == 1, F.concat(F.lit("p"), "project")).alias("project_path")).distinct()
    return sessions.attach_files(e, files)


@query(f"{priced_sql()}, {_FILES_SQL} SELECT entry_id, path, session, project_path FROM j")
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir).select("entry_id", "path", "session", "project_path")


@query(f"{priced_sql()}, {_FILES_SQL} SELECT session, {ROLLUP_SQL}, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(DISTINCT path) AS files, arg_max(project_path, (ts, entry_id)) FILTER (WHERE project_path IS NOT NULL) AS project_path FROM j GROUP BY 1")
def merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions resumed in several files are one."""
    s = sessions.merged_sessions(_filed(spark, sf_dir))
    return s.withColumn("first_us", F.unix_micros("first_ts")).withColumn("last_us", F.unix_micros("last_ts")).drop("first_ts", "last_ts")


@query(f"{priced_sql()} SELECT account AS root, 'p' || project AS path, {ROLLUP_SQL}, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(DISTINCT model) AS models FROM e GROUP BY 1, 2")
def keyed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = priced(spark, sf_dir).withColumn("root", F.col("account")).withColumn("path", F.concat(F.lit("p"), "project"))
    s = sessions.keyed_sessions(e)
    return s.withColumn("first_us", F.unix_micros("first_ts")).withColumn("last_us", F.unix_micros("last_ts")).drop("first_ts", "last_ts")


# Models by names that the price list knows, with a vendor prefix, by an alias, and not at all.
_NAMES_SQL = "CASE entry_id % 4 WHEN 0 THEN model WHEN 1 THEN 'openai/' || model WHEN 2 THEN model || '-latest' ELSE 'x' || model END"
_FALLBACK_SQL = f"""{PRICES_SQL}, l AS (SELECT * FROM prices WHERE model <> 'signup'), al(alias, target) AS (VALUES ('click-latest', 'click'), ('error-latest', 'error'), ('view-latest', 'signup')),
n AS (SELECT u.* EXCLUDE (model), {_NAMES_SQL} AS model FROM u), b AS (SELECT n.*, regexp_replace(model, '^openai/', '') AS bare FROM n),
k AS (SELECT b.*, CASE WHEN model IN (SELECT model FROM l) THEN model WHEN bare IN (SELECT model FROM l) THEN bare WHEN (SELECT target FROM al WHERE alias = bare) IN (SELECT model FROM l) THEN (SELECT target FROM al WHERE alias = bare) END AS found FROM b),
c AS (SELECT k.*, coalesce(found, 'view') AS price_key, found IS NULL AS is_fallback, l.* EXCLUDE (model) FROM k JOIN l ON l.model = coalesce(found, 'view'))"""


def _with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = F.col("entry_id") % 4, F.col("model")
    named = usage(spark, sf_dir).withColumn("model", F.when(r == 0, m).when(r == 1, F.concat(F.lit("openai/"), m)).when(r == 2, F.concat(m, F.lit("-latest"))).otherwise(F.concat(F.lit("x"), m)))
    aliases = spark.sql("select * from values ('click-latest', 'click'), ('error-latest', 'error'), ('view-latest', 'signup') as t(alias, model)")
    return with_prices_or_fallback(named, sample_prices(spark).where("model <> 'signup'"), aliases, "view")


@query(f"WITH {USAGE_SQL}, {_FALLBACK_SQL} SELECT model, price_key, is_fallback, count(*) AS entries, {sum_sql(calculated_sql())} AS cost_usd FROM c GROUP BY ALL")
def price_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_fallback(spark, sf_dir).withColumn("cost", entry_cost("calculate", False))
    return e.groupBy("model", "price_key", "is_fallback").agg(F.count("*").alias("entries"), stable_sum(F.col("cost")).alias("cost_usd"))


_IN = "greatest(0, input_tokens - cache_read_tokens)"
_CUMULATIVE = f"(({tier_sql(_IN, 'input_rate', 'input_hi', 272000)}) + ({tier_sql('cache_read_tokens', 'read_rate', 'read_hi', 272000)}) + ({tier_sql('output_tokens', 'output_rate', 'output_hi', 272000)})) * CASE WHEN speed = 'fast' THEN coalesce(fast_factor, 2.0::DOUBLE) ELSE 1.0::DOUBLE END"


@query(f"WITH {USAGE_SQL}, {_FALLBACK_SQL} SELECT ts::DATE AS bucket, model, sum(input_tokens + output_tokens)::BIGINT AS total_tokens, {sum_sql(_CUMULATIVE)} AS cost_usd, bool_or(is_fallback) AS is_fallback FROM c GROUP BY ALL")
def cumulative_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and models of a provider whose input holds the cached tokens; a total is input and output."""
    cost = cumulative_entry_cost(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("output_tokens"))
    e = _with_fallback(spark, sf_dir).withColumn("cost", cost)
    return e.groupBy(F.to_date("ts").alias("bucket"), "model").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), stable_sum(F.col("cost")).alias("cost_usd"), F.bool_or("is_fallback").alias("is_fallback"))


_REUSE_SQL = "count(*) AS entries, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read_tokens)::BIGINT AS read_tokens, CASE WHEN sum(input_tokens + cache_read_tokens) = 0 THEN 0.0::DOUBLE ELSE sum(cache_read_tokens)::BIGINT / sum(input_tokens + cache_read_tokens)::BIGINT * 100 END AS reuse_pct"


@query(f"""{priced_sql()}, r AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25')
SELECT CASE grouping(d, session_id, model) WHEN 3 THEN 'date' WHEN 5 THEN 'session' WHEN 6 THEN 'model' ELSE 'all' END AS axis, coalesce(d::VARCHAR, session_id::VARCHAR, model) AS key, {_REUSE_SQL}
FROM (SELECT *, ts::DATE AS d FROM r) GROUP BY GROUPING SETS ((), (d), (session_id), (model))""")
def range_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a range and their parts by date, session and model, in one pass."""
    e = priced(spark, sf_dir).where("ts >= timestamp'2024-01-05' and ts <= timestamp'2024-01-25'").withColumn("d", F.to_date("ts"))
    i, r = F.sum("input_tokens"), F.sum("cache_read_tokens")
    g = e.groupingSets([[], ["d"], ["session_id"], ["model"]], "d", "session_id", "model").agg(
        F.grouping_id("d", "session_id", "model").alias("g"), F.count("*").alias("entries"), i.alias("input_tokens"), r.alias("read_tokens"), hit_percent(i, F.lit(0), r).alias("reuse_pct"))
    axis = F.when(F.col("g") == 3, "date").when(F.col("g") == 5, "session").when(F.col("g") == 6, "model").otherwise("all")
    return g.select(axis.alias("axis"), F.coalesce(F.col("d").cast("string"), F.col("session_id").cast("string"), "model").alias("key"), "entries", "input_tokens", "read_tokens", "reuse_pct")


def _dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).withColumn("d", cache_dollars()).select("*", "d.saved", "d.wasted")


_SUMS_SQL = f"sum(input_tokens)::BIGINT AS input_tokens, sum(cache_create_tokens)::BIGINT AS create_tokens, sum(cache_read_tokens)::BIGINT AS read_tokens, sum({nano_sql('saved')})::BIGINT AS saved, sum({nano_sql('wasted')})::BIGINT AS wasted"
_HIT_SQL = "CASE WHEN input_tokens + create_tokens + read_tokens = 0 THEN 0.0::DOUBLE ELSE read_tokens / (input_tokens + create_tokens + read_tokens) * 100 END AS hit_pct"


@query(f"{_CACHE}, g AS (SELECT session_id, model, {_SUMS_SQL} FROM c GROUP BY GROUPING SETS ((session_id), (session_id, model))) SELECT *, saved - wasted AS net, {_HIT_SQL} FROM g")
def cache_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, and their models below them."""
    return sessions.cache_tree(_dollars(spark, sf_dir), "session_id", "model")


@query(f"""{_CACHE}, g AS (SELECT session_id::VARCHAR AS key, {_SUMS_SQL} FROM c GROUP BY 1), r AS (SELECT *, saved - wasted AS net, row_number() OVER (ORDER BY abs(saved - wasted) DESC, key) AS rn FROM g),
s AS (SELECT CASE WHEN rn <= 8 THEN key ELSE '(other)' END AS key, sum(net)::BIGINT AS net, sum(input_tokens)::BIGINT AS input_tokens, sum(create_tokens)::BIGINT AS create_tokens, sum(read_tokens)::BIGINT AS read_tokens FROM r GROUP BY 1) SELECT key, net, {_HIT_SQL} FROM s""")
def cache_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sessions.cache_sums(_dollars(spark, sf_dir), [F.col("session_id").cast("string").alias("key")])
    return sessions.cache_breakdown(sums, "key", 8)


def _orders_sql(rows: str, orders: dict[str, str], ties: str, n: int, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, row_number() OVER (ORDER BY {', '.join(filter(None, [x, ties]))})::INTEGER AS place, {columns} FROM {rows}) WHERE place <= {n}" for k, x in orders.items())


@query(f"""{_two('session_id')}, {'o AS (' + _orders_sql('q', {'delta': 'abs(delta) DESC', 'cost-a': 'coalesce(a, 0) DESC', 'cost-b': 'coalesce(b, 0) DESC', 'name': '', 'status': "CASE status WHEN 'dropped' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END, abs(delta) DESC"}, 'key', 10, 'key, status, delta') + ')'} SELECT * FROM o""")
def diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of a comparison in each of its orders."""
    q = _windows(spark, sf_dir, "session_id")
    return reports.first_in_order(q, reports.DIFF_ORDERS, ["key"], 10).select("sort", "place", "key", "status", "delta")


@query(f"""{_two('session_id')} SELECT count(*) FILTER (WHERE status = 'changed' AND abs(delta) < 1 AND abs(coalesce(delta_pct, 0)) < 10) AS noise,
greatest(0, count(*) FILTER (WHERE status = 'changed' AND NOT (abs(delta) < 1 AND abs(coalesce(delta_pct, 0)) < 10)) - 10)::BIGINT AS past_top FROM q""")
def diff_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hidden(_windows(spark, sf_dir, "session_id"), 1.0, 10.0, 10)


_CACHE_ROWS = f"""{_CACHE}, g AS (SELECT session_id AS key, epoch_us(max(ts)) AS "at", {_SUMS_SQL}, sum({nano_sql('cost')})::BIGINT AS cost FROM c GROUP BY 1), r AS (SELECT key, "at", saved - wasted AS net, {_HIT_SQL}, cost, saved < wasted AS anomaly FROM g)"""


@query(f"""{_CACHE_ROWS}, {'o AS (' + _orders_sql('r', {'date': '', 'net': 'net', 'cache': 'hit_pct', 'recent': '"at" DESC', 'cost': 'cost DESC', 'anomaly': 'CASE WHEN anomaly THEN 0 ELSE 1 END'}, '"at", key', 10, 'key') + ')'} SELECT * FROM o""")
def cache_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten sessions of a cache report in each of its orders."""
    d = _dollars(spark, sf_dir)
    sums = sessions.cache_sums(d, ["session_id"])
    more = d.groupBy("session_id").agg(F.unix_micros(F.max("ts")).alias("at"), F.sum(nano(F.col("cost"))).alias("cost"))
    r = sums.join(more, "session_id").select(F.col("session_id").alias("key"), "at", "net", "hit_pct", "cost", (F.col("net") < 0).alias("anomaly"))
    return reports.first_in_order(r, reports.CACHE_ORDERS, ["at", "key"], 10).select("sort", "place", "key")


_SESSION_ROWS = f"{priced_sql()}, s AS (SELECT session_id AS key, sum({nano_sql('cost')})::BIGINT AS cost, (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000 AS minutes, min(model) AS model, 'p' || min(project) AS project, epoch_us(min(ts)) AS started FROM e GROUP BY 1)"


@query(f"""{_SESSION_ROWS}, {'o AS (' + _orders_sql('s', {'cost desc': 'cost DESC', 'duration desc': 'minutes DESC', 'model asc': 'model', 'project asc': 'project', 'started desc': 'started DESC'}, 'key', 10, 'key') + ')'} SELECT * FROM o""")
def session_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))
    s = priced(spark, sf_dir).groupBy(F.col("session_id").alias("key")).agg(F.sum(nano(F.col("cost"))).alias("cost"), F.floor((last - first) / 60_000_000).alias("minutes"), F.min("model").alias("model"), F.concat(F.lit("p"), F.min("project")).alias("project"), first.alias("started"))
    return reports.first_in_order(s, reports.SESSION_ORDERS, ["key"], 10).select("sort", "place", "key")


_PROJECT_ROWS = f"{priced_sql()}, g AS (SELECT CASE WHEN project % 2 = 0 THEN 'P' ELSE 'p' END || project AS name, sum({nano_sql('cost')})::BIGINT AS cost, CASE WHEN project <> 3 THEN count(DISTINCT session_id) END AS used, epoch_us(max(ts)) AS last_seen FROM e GROUP BY project)"


@query(f"""{_PROJECT_ROWS}, {'o AS (' + _orders_sql('g', {'cost asc': 'cost', 'cost desc': 'cost DESC', 'used asc': 'coalesce(used, -1)', 'used desc': 'coalesce(used, -1) DESC', 'last-seen asc': 'last_seen', 'last-seen desc': 'last_seen DESC', 'name asc': '', 'name desc': 'lower(name) DESC'}, 'lower(name), name', 10, 'name') + ')'} SELECT * FROM o""")
def project_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("project") % 2 == 0, "P").otherwise("p"), F.col("project")).alias("name")
    g = priced(spark, sf_dir).groupBy(name, "project").agg(F.sum(nano(F.col("cost"))).alias("cost"), F.countDistinct("session_id").alias("used"), F.unix_micros(F.max("ts")).alias("last_seen"))
    g = g.withColumn("used", F.when(F.col("project") != 3, F.col("used"))).drop("project")
    return reports.first_in_order(g, reports.PROJECT_ORDERS, ["lower(name)", "name"], 10).select("sort", "place", "name")


@query(f"{priced_sql()}, w AS (SELECT date_trunc('week', ts)::DATE AS week, project, sum({nano_sql('cost')})::BIGINT AS nano FROM e GROUP BY ALL) SELECT * FROM w WHERE week IN (SELECT DISTINCT week FROM w ORDER BY week DESC LIMIT 3)")
def recent_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest weeks that have entries."""
    w = priced(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "project").agg(F.sum(nano(F.col("cost"))).alias("nano"))
    return reports.last_periods(w, "week", 3)


@query(f"{priced_sql()}, d AS (SELECT ts::DATE AS day, project, sum({nano_sql('cost')})::BIGINT AS nano FROM e GROUP BY ALL), m AS (SELECT day, sum(nano)::BIGINT AS whole, arg_max(project, nano) AS project, max(nano) AS most FROM d GROUP BY 1) SELECT day, project, most / whole AS share FROM m WHERE most >= 0.2::DOUBLE * whole")
def dominant_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = priced(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "project").agg(F.sum(nano(F.col("cost"))).alias("nano"))
    return reports.dominant(d, "day", "project", "nano", 0.2)
