"""Anchored blocks, quota blocks, shaping and text queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money import nano
from ..functions.timekit import week_start
from ..operators import blocks, conversations, quota, reports
from ..sources.tables import table
from .registry import USAGE_SQL, nano_sql, priced, priced_sql, query, usage

_WINDOWS = """w AS (SELECT session_id, s AS start, s + INTERVAL 5 HOUR AS "end" FROM (SELECT DISTINCT session_id, date_trunc('day', ts) + INTERVAL 10 HOUR AS s FROM u))"""


@query(f"""WITH RECURSIVE {USAGE_SQL}, {_WINDOWS}, j AS (SELECT u.session_id, u.ts, w.start, w."end" FROM u LEFT JOIN w ON u.session_id = w.session_id AND u.ts >= w.start AND u.ts < w."end"),
h AS (SELECT session_id, date_trunc('hour', ts) AS hour, min(ts) AS a, max(ts) AS z, count(*) AS n FROM j WHERE start IS NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hour) AS rn FROM h),
b AS (SELECT session_id, rn, hour AS start FROM o WHERE rn = 1 UNION ALL SELECT o.session_id, o.rn, CASE WHEN o.hour >= b.start + INTERVAL 5 HOUR THEN o.hour ELSE b.start END FROM b JOIN o ON o.session_id = b.session_id AND o.rn = b.rn + 1),
f AS (SELECT b.session_id, b.start, b.start + INTERVAL 5 HOUR AS "end", min(a) AS first_ts, max(z) AS last_ts, sum(n)::BIGINT AS entries FROM b JOIN o USING (session_id, rn) GROUP BY ALL),
c AS (SELECT f.*, (SELECT min(w.start) FROM w WHERE w.session_id = f.session_id AND w.start > f.start) AS nxt FROM f),
x AS (SELECT session_id, start, CASE WHEN nxt < "end" THEN nxt ELSE "end" END AS "end", first_ts, last_ts, entries, 'heuristic' AS anchor FROM c
UNION ALL SELECT session_id, start, "end", min(ts), max(ts), count(*), 'recorded' FROM j WHERE start IS NOT NULL GROUP BY 1, 2, 3)
SELECT session_id, epoch_us(start) AS start_us, epoch_us("end") AS end_us, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us, entries, anchor FROM x""")
def anchored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    start = F.date_trunc("day", F.col("ts")) + F.expr("interval 10 hours")
    w = u.select("session_id", start.alias("start")).distinct().withColumn("end", F.col("start") + F.expr("interval 5 hours"))
    us = F.unix_micros
    return blocks.anchored_blocks(u, w, ["session_id"]).select("session_id", us("start").alias("start_us"), us("end").alias("end_us"), us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), "entries", "anchor")


@query(f"WITH {USAGE_SQL} SELECT account, k AS reset, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(value, (ts, entry_id)) AS current, max(value) AS highest, count(*) AS samples FROM u GROUP BY ALL")
def quota_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = usage(spark, sf_dir).select("account", F.col("k").alias("reset"), "ts", "entry_id", F.col("value").alias("percent"))
    q = quota.quota_blocks(s, ["account"], "reset", ["ts", "entry_id"])
    return q.withColumn("first_us", F.unix_micros("first_ts")).withColumn("last_us", F.unix_micros("last_ts")).drop("first_ts", "last_ts")


@query(f"WITH {USAGE_SQL}, l AS (SELECT *, lag(value) OVER w AS prev_percent, lag(ts + INTERVAL 5 HOUR) OVER w AS r FROM u WINDOW w AS (PARTITION BY session_id ORDER BY ts, entry_id)) SELECT entry_id, session_id, value AS percent, prev_percent FROM l WHERE r > ts AND prev_percent - value >= 5")
def five_hour_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = usage(spark, sf_dir).select("entry_id", "session_id", "ts", F.col("value").alias("percent"), (F.col("ts") + F.expr("interval 5 hours")).alias("resets_at"))
    return quota.credits(s, ["session_id"], ["ts", "entry_id"]).select("entry_id", "session_id", "percent", "prev_percent")


@query(f"{priced_sql()} SELECT project, ts::DATE AS day, sum({nano_sql('cost')})::BIGINT AS nano, count(*) AS entries FROM e GROUP BY ALL")
def merged_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums of three stretches of time, combined."""
    e = priced(spark, sf_dir).withColumn("day", F.to_date("ts"))
    of = lambda c: e.where(c).groupBy("project", "day").agg(F.sum(nano(F.col("cost"))).alias("nano"), F.count("*").alias("entries"))
    return reports.merge_partials([of("entry_id % 3 = 0"), of("entry_id % 3 = 1"), of("entry_id % 3 = 2")], ["project", "day"], ["nano", "entries"])


@query(f"WITH {USAGE_SQL}, m AS (SELECT session_id, model, max(k) AS top FROM u GROUP BY ALL) SELECT session_id, count(top) AS n, CASE WHEN count(top) >= 3 THEN avg(top) END AS mean FROM m GROUP BY 1")
def mean_of_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = usage(spark, sf_dir).groupBy("session_id", "model").agg(F.max("k").alias("top"))
    return reports.mean_of_enough(m, ["session_id"], "top")


@query(f"WITH {USAGE_SQL}, s(account) AS (VALUES (0::BIGINT), (1), (2), (3)) SELECT account, count(entry_id) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM s LEFT JOIN u USING (account) GROUP BY 1")
def footer_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.footer_legs(usage(spark, sf_dir), "account", "k", spark.range(4).withColumnRenamed("id", "account"))


@query(f"""WITH {USAGE_SQL}, t AS (SELECT session_id, row_number() OVER (ORDER BY sum(k) DESC, session_id) AS rn FROM u GROUP BY 1),
g AS (SELECT (ts::DATE - (isodow(ts) - 1)::INTEGER)::DATE AS week, CASE WHEN rn <= 5 THEN session_id::VARCHAR ELSE '(other)' END AS name, sum(k)::BIGINT AS value FROM u JOIN t USING (session_id) GROUP BY ALL)
SELECT week, name, value, value / sum(value) OVER (PARTITION BY week) AS share FROM g""")
def ranked_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).select(week_start(F.to_date("ts")).alias("week"), "session_id", "k")
    return reports.ranked_trend(u, "week", "session_id", "k", 5)


@query(f"WITH {USAGE_SQL}, g AS (SELECT project, min(value) AS lo, max(value) AS hi FROM u GROUP BY 1) SELECT project, greatest(0.0::DOUBLE, lo - (hi - lo) * 0.1::DOUBLE) AS low, hi + (hi - lo) * 0.1::DOUBLE AS high FROM g")
def chart_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.zoom(usage(spark, sf_dir), ["project"], "value")


@query(f"WITH {USAGE_SQL}, p AS (SELECT ts::DATE AS day, k, 'a' AS p FROM u WHERE account = 0 UNION ALL SELECT (ts + INTERVAL 9 DAY)::DATE, k, 'b' FROM u WHERE account > 0) SELECT day, sum(k)::BIGINT AS k, string_agg(DISTINCT p, ',' ORDER BY p) AS providers FROM p GROUP BY 1")
def combined_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).withColumn("day", F.to_date("ts"))
    of = lambda x: x.groupBy("day").agg(F.sum("k").alias("k"))
    # two providers whose days only partly agree, and one that isn't there
    later = u.where("account > 0").withColumn("day", F.date_add("day", 9))
    return reports.combine_providers([("a", of(u.where("account = 0"))), ("b", of(later)), ("c", None)], "day", ["k"])


@query("SELECT conv_id, turn, len(string_split(lower(text), 'on')) - 1 AS n, coalesce(nullif(instr(lower(text), 'on'), 0) - 1, -1) AS first_at FROM conversations")
def occurrence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.ranges(F.col("text"), "On").alias("r"))
    return r.select("conv_id", "turn", F.size("r").alias("n"), F.coalesce(F.try_element_at("r", F.lit(1))["start"], F.lit(-1)).alias("first_at"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)th[ae]n')) AS matches FROM conversations WHERE regexp_matches(text, '(?i)th[ae]n')")
def regex_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.find(table(spark, sf_dir, "conversations"), "th[ae]n")


@query("WITH t AS (SELECT conv_id, substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 80) AS title, min(turn) AS anchor FROM conversations GROUP BY 1) SELECT conv_id, anchor, title FROM t WHERE contains(lower(title), 'the')")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.title_search(table(spark, sf_dir, "conversations"), "The")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND trim(text) <> '' AND NOT starts_with(text, '/')")
def prompt_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prompts(table(spark, sf_dir, "conversations"))


@query("SELECT page_id, string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[-1] AS name, regexp_replace(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[-1], '\\.[^.]*$', '') AS stem FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.basename(path).alias("name"), text.stem(path).alias("stem"))


@query("SELECT page_id, url AS back FROM pages")
def identity_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = table(spark, sf_dir, "pages").select("page_id", text.encode_identity(F.lit("page"), F.col("url")).alias("t"))
    return token.select("page_id", F.element_at(text.decode_identity(F.col("t")), 2).alias("back"))


@query("WITH p AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS line FROM documents) SELECT doc_id, CASE WHEN length(line) > 40 THEN substr(line, 1, 39) || '…' ELSE line END AS preview FROM p")
def line_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 40).alias("preview"))


@query(f"WITH {USAGE_SQL} SELECT session_id, project::VARCHAR AS project, coalesce(arg_max(CASE WHEN k % 3 = 0 THEN 'b' || k END, ts) FILTER (WHERE k % 3 = 0), NULL) AS branch, string_agg(DISTINCT CASE WHEN entry_id % 4 = 0 THEN '0' ELSE '1' END || model, ',' ORDER BY CASE WHEN entry_id % 4 = 0 THEN '0' ELSE '1' END || model) FILTER (WHERE model <> 'error') AS models FROM u GROUP BY 1, 2")
def session_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    t = u.select(F.col("session_id").alias("conv_id"), "ts", F.col("project").cast("string").alias("cwd"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("b"), "k")).alias("branch"),
                 F.when(F.col("model") != "error", F.concat(F.when(F.col("entry_id") % 4 == 0, "0").otherwise("1"), "model")).alias("model"), (F.col("entry_id") % 4 == 0).alias("main"))
    return conversations.browse(t).select(F.col("conv_id").alias("session_id"), "project", "branch", F.array_join("models", ",").alias("models"))
