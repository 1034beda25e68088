"""Week keys and boundaries, durable state, log lines and message texts: queries over what records say."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money import nano
from ..functions.timekit import moment, month_window, parse_window, week_window
from ..operators import attribution, conversations, events, quota, reports, weeks
from ..operators.ranks import placed
from ..sources.logs import ROLLOUT_LINE, message_rows, quota_observations, snap_minutes
from ..sources.tables import table
from .activity import BLOCKS_SQL, _EFFECTIVE, _RECORDS, _blocks, _records
from .registry import USAGE_SQL, nano_sql, priced, priced_sql, query, usage

_KEY = "(epoch_us(ts) // 1000000 // 604800 * 604800)::BIGINT"


def _week() -> Column:
    return (F.floor(F.unix_seconds("ts") / 604_800) * 604_800).cast("long")


@query(f"WITH {USAGE_SQL}, k AS (SELECT {_KEY} AS week, max(ts) AS at FROM u WHERE model <> 'view' GROUP BY 1 UNION ALL SELECT {_KEY} + 604800, max(ts) FROM u WHERE model = 'view' GROUP BY 1) SELECT week, epoch_us(max(at)) AS last_us FROM k GROUP BY 1".replace(" AS at", ' AS "at"').replace("max(at)", 'max("at")'))
def week_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that either of two tables knows, with the latest time seen in both."""
    u = usage(spark, sf_dir)
    a = u.where("model <> 'view'").select(_week().alias("week"), "ts")
    b = u.where("model = 'view'").select((_week() + 604_800).alias("week"), "ts")
    return a.unionByName(b).groupBy("week").agg(F.unix_micros(F.max("ts")).alias("last_us"))


@query(f"WITH {USAGE_SQL}, k AS (SELECT account, {_KEY} AS week, {_KEY} + 604800 AS e FROM u WHERE k < 40 UNION ALL SELECT account, {_KEY}, {_KEY} + 604800 - k FROM u WHERE model = 'click' UNION ALL SELECT account, {_KEY}, {_KEY} + 604800 + k % 3 FROM u WHERE model = 'error') SELECT account, week, max(e)::BIGINT AS week_end FROM k GROUP BY ALL")
def week_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's end from three tables, the latest that one of them gives."""
    u = usage(spark, sf_dir).withColumn("week", _week())
    of = lambda c, e: u.where(c).select("account", "week", e.alias("e"))
    end = F.col("week") + 604_800
    three = of("k < 40", end).unionByName(of("model = 'click'", end - F.col("k"))).unionByName(of("model = 'error'", end + F.col("k") % 3))
    return three.groupBy("account", "week").agg(F.max("e").alias("week_end"))


@query(f"WITH {USAGE_SQL} SELECT account, {_KEY} AS boundary FROM u UNION SELECT account, {_KEY} + 604800 FROM u WHERE model = 'click' UNION SELECT account, {_KEY} + k FROM u WHERE model = 'error'")
def retained_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every boundary that a stored row rests on, once."""
    u = usage(spark, sf_dir).withColumn("week", _week())
    of = lambda df, b: df.select("account", b.alias("boundary"))
    return of(u, F.col("week")).unionByName(of(u.where("model = 'click'"), F.col("week") + 604_800)).unionByName(of(u.where("model = 'error'"), F.col("week") + F.col("k"))).distinct()


@query(f"WITH {USAGE_SQL}, m AS (SELECT session_id, ts, entry_id, k AS percent FROM u WHERE account < 2 UNION ALL SELECT session_id, ts - INTERVAL 1 HOUR, entry_id, k // 2 FROM u WHERE account > 0) SELECT session_id, percent, epoch_us(min(ts)) AS ts_us, arg_min(entry_id, (ts, entry_id)) AS entry_id FROM m GROUP BY ALL")
def cluster_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones of the windows of a cluster as one set: each percent once, at its earliest."""
    u = usage(spark, sf_dir)
    a = u.where("account < 2").select("session_id", "ts", "entry_id", F.col("k").alias("percent"))
    b = u.where("account > 0").select("session_id", (F.col("ts") - F.expr("interval 1 hour")).alias("ts"), "entry_id", F.floor(F.col("k") / 2).alias("percent"))
    both = a.unionByName(b)
    return both.groupBy("session_id", "percent").agg(F.unix_micros(F.min("ts")).alias("ts_us"), F.min_by("entry_id", moment("ts", "entry_id")).alias("entry_id"))


@query(f"""{priced_sql()}, c AS (SELECT account, {_KEY} + (account % 2) * 3600 AS start, sum({nano_sql('cost')})::BIGINT AS nano FROM e GROUP BY ALL), w AS (SELECT account, {_KEY} AS start, max(least(100.0::DOUBLE, value)) AS percent FROM u GROUP BY ALL),
d AS (SELECT account, start // 86400 AS day, max(nano) AS nano FROM c GROUP BY ALL)
SELECT w.account, w.start, percent, coalesce(c.nano, d.nano) AS nano, CASE WHEN c.nano IS NOT NULL THEN 'instant' WHEN d.nano IS NOT NULL THEN 'date' END AS matched FROM w LEFT JOIN c ON c.account = w.account AND c.start = w.start LEFT JOIN d ON d.account = w.account AND d.day = w.start // 86400""")
def report_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of weeks with their costs: by the very instant of the week's start, else by its date."""
    c = priced(spark, sf_dir).withColumn("start", _week() + (F.col("account") % 2) * 3600).groupBy("account", "start").agg(F.sum(nano(F.col("cost"))).alias("by_instant"))
    w = usage(spark, sf_dir).groupBy("account", _week().alias("start")).agg(F.max(F.least(F.lit(100.0), "value")).alias("percent"))
    d = c.groupBy("account", F.floor(F.col("start") / 86_400).alias("day")).agg(F.max("by_instant").alias("by_date"))
    j = w.join(c, ["account", "start"], "left").withColumn("day", F.floor(F.col("start") / 86_400)).join(d, ["account", "day"], "left")
    matched = F.when(F.col("by_instant").isNotNull(), "instant").when(F.col("by_date").isNotNull(), "date")
    return j.select("account", "start", "percent", F.coalesce("by_instant", "by_date").alias("nano"), matched.alias("matched"))


@query(f"WITH {USAGE_SQL}, n AS (SELECT CASE WHEN entry_id % 4 > 0 THEN account END AS account, ts, entry_id, value FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, entry_id DESC) AS rn FROM n), a AS (SELECT account, count(*) AS samples FROM n GROUP BY 1) SELECT a.account, samples, r.entry_id, r.value AS percent FROM a JOIN r ON r.account IS NOT DISTINCT FROM a.account AND rn = 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sample of each account, null being one of them."""
    n = usage(spark, sf_dir).select(F.when(F.col("entry_id") % 4 > 0, F.col("account")).alias("account"), "ts", "entry_id", "value")
    return n.groupBy("account").agg(F.count("*").alias("samples"), F.max_by("entry_id", moment("ts", "entry_id")).alias("entry_id"), F.max_by("value", moment("ts", "entry_id")).alias("percent"))


_FIRST = 1_704_412_800  # 2024-01-05


@query(f"""WITH {USAGE_SQL}, a AS (SELECT session_id, min(epoch_us(ts) // 1000000)::BIGINT AS anchor FROM u WHERE model = 'error' AND k > 70 GROUP BY 1), c AS (SELECT session_id, min(epoch_us(ts) // 1000000)::BIGINT AS anchor FROM u WHERE model = 'signup' AND k > 80 GROUP BY 1),
k AS (SELECT DISTINCT session_id FROM u) SELECT session_id, coalesce(a.anchor, c.anchor, ({_FIRST // 86400} - ({_FIRST // 86400} + 3) % 7) * 86400)::BIGINT AS anchor, CASE WHEN a.anchor IS NOT NULL THEN 'usage' WHEN c.anchor IS NOT NULL THEN 'cost' ELSE 'calendar' END AS source
FROM k LEFT JOIN a USING (session_id) LEFT JOIN c USING (session_id)""")
def week_anchor_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a week's walk begins: at the first usage sample, else the first cost, else the calendar week."""
    u = usage(spark, sf_dir)
    at = F.min(F.unix_seconds("ts")).alias("anchor")
    a = u.where("model = 'error' and k > 70").groupBy("session_id").agg(at).withColumn("source", F.lit("usage"))
    c = u.where("model = 'signup' and k > 80").groupBy("session_id").agg(at).withColumn("source", F.lit("cost"))
    found = weeks.with_fallbacks(u, a, c, ["session_id"], _FIRST)
    named = a.select("session_id", "anchor", "source").unionByName(c.select("session_id", "anchor", "source").join(a.select("session_id"), "session_id", "left_anti"))
    return found.join(named, ["session_id", "anchor"], "left").select("session_id", "anchor", F.coalesce("source", F.lit("calendar")).alias("source"))


@query(f"WITH {_RECORDS}, {_EFFECTIVE} SELECT * FROM eff")
def effective_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective events from durable rows and two later batches, old records never being read again."""
    r = _records(spark, sf_dir)
    state = events.effective_state(r.where("seq % 3 = 0"))
    for n in (1, 2):
        state = events.merge_effective(state, r.where(f"seq % 3 = {n}"))
    return state.where("status = 'active'").select("id", "rev", "seq", "digest", (F.col("digest_lo") != F.col("digest_hi")).alias("conflict"))


@query(f"WITH {USAGE_SQL}, n AS (SELECT CASE WHEN session_id % 5 > 0 THEN session_id::VARCHAR ELSE 'path:p' || project || '/' || k END AS key, ts FROM u) SELECT key, epoch_us(max(ts)) AS last_us FROM n GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
def retention_without_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups to be deleted; rows without an identity are grouped by their path."""
    u = usage(spark, sf_dir).select(F.when(F.col("session_id") % 5 > 0, F.col("session_id")).alias("key"), F.concat(F.lit("p"), "project", F.lit("/"), "k").alias("path"), "ts")
    return events.prunable(u, "key", "ts", F.expr("timestamp'2024-01-30 12:00:00'"), "path").select("key", F.unix_micros("last_ts").alias("last_us"))


@query(f"WITH RECURSIVE {USAGE_SQL}, {BLOCKS_SQL} SELECT session_id, sum(entries)::BIGINT AS in_blocks, (SELECT count(*) FROM u WHERE u.session_id = k.session_id) AS entries FROM k GROUP BY 1")
def block_totals_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a session's blocks against its entries; they are equal."""
    whole = usage(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("entries"))
    return _blocks(spark, sf_dir).groupBy("session_id").agg(F.sum("entries").alias("in_blocks")).join(whole, "session_id")


@query(f"WITH RECURSIVE {USAGE_SQL}, {BLOCKS_SQL} SELECT epoch_us(min(start)) AS start_us, epoch_us(max(\"end\")) AS end_us FROM k")
def displayed_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.displayed_span(_blocks(spark, sf_dir), "start", "end")
    return s.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query(f"""WITH {USAGE_SQL} SELECT entry_id, '{{' || CASE WHEN cache_1h_tokens IS NULL THEN '' ELSE '"cache_1h_tokens":' || cache_1h_tokens || ',' END || '"input_tokens":' || input_tokens || ',"output_tokens":' || output_tokens || CASE WHEN speed IS NULL THEN '' ELSE ',"speed":"' || speed || '"' END || '}}' AS usage FROM u""")
def canonical_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("input_tokens", "output_tokens", "cache_1h_tokens", "speed")
    return usage(spark, sf_dir).select("entry_id", text.canonical_usage({n: F.col(n) for n in names}).alias("usage"))


@query(f"""WITH {USAGE_SQL} SELECT entry_id, sha256('{{"a":"' || project || '","b":"' || model || '","c":"' || k || '"}}') AS hash FROM u""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's hash does not depend on the order in which its fields came."""
    s = lambda c: F.col(c).cast("string")
    one = F.create_map(F.lit("c"), s("k"), F.lit("a"), s("project"), F.lit("b"), F.col("model"))
    other = F.create_map(F.lit("b"), F.col("model"), F.lit("c"), s("k"), F.lit("a"), s("project"))
    record = F.when(F.col("entry_id") % 2 == 0, one).otherwise(other)
    return usage(spark, sf_dir).select("entry_id", F.sha2(text.canonical_json(record), 256).alias("hash"))


@query("SELECT doc_id, md5(substr(text, 1, 16000)) AS kept, greatest(0, length(text) - 16000)::INTEGER AS cut FROM documents")
def capped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a conversation are shown up to 16,000 characters; the cap is the feature."""
    c = text.capped(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", F.md5("c.text").alias("kept"), "c.cut")


_SEARCH = "SELECT conv_id, turn, role, text, len(string_split(lower(text), 'the')) - 1 AS n, instr(lower(text), 'the') AS at FROM conversations WHERE contains(lower(text), 'the')".replace(" AS at ", ' AS "at" ')


@query(f"""WITH h AS ({_SEARCH}), g AS (SELECT conv_id, sum(n)::BIGINT AS hits, string_agg(DISTINCT role, ',' ORDER BY role) AS kinds, min(turn) AS turn, arg_min(text, turn) AS text, arg_min("at", turn) AS p FROM h GROUP BY 1)
SELECT conv_id, hits, kinds, turn, substr(text, greatest(1, p - 40), p - greatest(1, p - 40) + 43) AS snippet FROM g""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.search_conversations(table(spark, sf_dir, "conversations"), "The")


@query(f"""WITH h AS ({_SEARCH} AND role = 'user') SELECT conv_id, sum(n)::BIGINT AS hits, min(turn) AS turn FROM h GROUP BY 1""")
def search_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.search_conversations(table(spark, sf_dir, "conversations"), "the", "prompts").select("conv_id", "hits", "turn")


@query("""WITH t AS (SELECT doc_id % 50 AS conv_id, doc_id AS turn, unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS path FROM documents), g AS (SELECT conv_id, path, max(turn) AS anchor FROM t GROUP BY ALL) SELECT * FROM g WHERE contains(lower(path), 'stor')""")
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a text, at their latest mention; words of documents stand for paths."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("conv_id"), F.col("doc_id").alias("turn"), "text")
    return conversations.file_search(conversations.file_touches(d, "[A-Za-z]{3,}"), "STOR")


@query(f"WITH {USAGE_SQL} SELECT entry_id, epoch_us(ts) // 1000000 + k * 9000 BETWEEN epoch_us(ts) // 1000000 - 300 AND epoch_us(ts) // 1000000 + 691200 AS plausible, CASE WHEN abs(k + 250 - 300) <= 1 THEN 300 WHEN abs(k + 250 - 10080) <= 1 THEN 10080 ELSE k + 250 END::INTEGER AS minutes FROM u")
def plausible_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.unix_seconds("ts")
    return usage(spark, sf_dir).select("entry_id", quota.plausible(now + F.col("k") * 9000, now).alias("plausible"), snap_minutes((F.col("k") + 250).cast("int")).alias("minutes"))


@query(f"WITH {USAGE_SQL} SELECT entry_id, CASE WHEN k % 3 > 0 THEN value END AS value FROM u")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-a-number and infinities are written as null."""
    odd = F.when(F.col("k") % 6 == 0, F.lit(float("nan"))).when(F.col("k") % 6 == 3, F.lit(float("-inf"))).otherwise(F.col("value"))
    return usage(spark, sf_dir).select("entry_id", text.finite_or_null(odd).alias("value"))


@query(f"""WITH {USAGE_SQL}, s AS (SELECT entry_id, 'primary' AS slot, CASE WHEN k <= 50 THEN k * 2.0::DOUBLE WHEN entry_id % 2 = 0 THEN 7.0::DOUBLE END AS used_percent, 299 AS m FROM u UNION ALL SELECT entry_id, 'weekly', 7.0::DOUBLE, 10081 FROM u WHERE entry_id % 2 = 0)
SELECT entry_id, slot, used_percent, CASE WHEN m = 299 THEN 300 ELSE 10080 END AS window_minutes FROM s WHERE used_percent IS NOT NULL""")
def quota_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as rollout lines whose direct limits are now and then beyond 100 percent and read back; the line's info fills in."""
    limit = lambda p, m: F.struct(p.cast("double").alias("used_percent"), F.lit(m).alias("window_minutes"), F.unix_seconds("ts").alias("resets_at"))
    seven, even = F.lit(7.0), F.col("entry_id") % 2 == 0
    info = F.struct(F.map_from_arrays(F.array(F.lit("primary"), F.lit("weekly")), F.array(limit(seven, 299), limit(seven, 10081))).alias("rate_limits"))
    payload = F.struct(F.lit("token_count").alias("type"), F.when(even, info).alias("info"), F.create_map(F.lit("primary"), limit(F.col("k") * 2, 299)).alias("rate_limits"))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("event_msg").alias("type"), payload.alias("payload")))
    rollouts = usage(spark, sf_dir).select(F.lit("f").alias("source_path"), F.col("entry_id").alias("pos"), F.from_json(line, ROLLOUT_LINE).alias("j"))
    return quota_observations(rollouts).select(F.col("pos").alias("entry_id"), "slot", "used_percent", "window_minutes")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'meta' WHEN role = 'user' THEN 'human' ELSE 'assistant' END AS kind, md5(coalesce(text, '')) AS text FROM conversations WHERE role IN ('user', 'assistant')""")
def message_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as conversation lines and read back with their kinds."""
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.concat_ws(":", "conv_id", "turn").alias("uuid"), (F.col("turn") % 5 == 4).alias("isMeta"), F.struct("role", F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))).alias("content")).alias("message")))
    m = message_rows(c.select(F.lit("f").alias("source_path"), line.alias("line")))
    at = F.split("uuid", ":")
    return m.select(at[0].cast("long").alias("conv_id"), at[1].cast(c.schema["turn"].dataType).alias("turn"), "kind", F.md5("text").alias("text"))


@query(f"WITH {USAGE_SQL} SELECT entry_id, CASE WHEN k % 2 = 0 THEN 'run' END AS name, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN model || ' --n ' || k ELSE '' END END AS args FROM u")
def command_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    t = F.when(k % 4 == 0, F.concat(F.lit("/run  "), "model", F.lit(" --n "), k, F.lit(" "))).when(k % 2 == 0, "/run").otherwise(F.concat(F.lit("run /"), "model"))
    return usage(spark, sf_dir).select("entry_id", text.command_of(t).alias("c")).select("entry_id", "c.name", "c.args")


@query(f"WITH {USAGE_SQL} SELECT entry_id, k % 11 = 0 OR k % 4 = 1 OR k % 7 = 2 AS failed FROM u")
def tool_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    calls = usage(spark, sf_dir).select("entry_id", F.when(k % 3 > 0, k % 11 == 0).otherwise(F.when(k % 11 == 0, True)).alias("is_error"), F.when(k % 4 == 1, "Failed").when(k % 4 == 2, "ok").alias("status"), F.when(k % 7 == 2, False).when(k % 7 == 3, True).alias("patch_success"))
    return conversations.tool_failures(calls).select("entry_id", "failed")


_NOW = dt.datetime(2024, 1, 17, 15, 30, tzinfo=dt.UTC)


def _by_window(spark: SparkSession, sf_dir: str, bounds: dict[str, tuple[dt.datetime, dt.datetime]]) -> DataFrame:
    """Each entry is tested against all windows in one pass."""
    at = F.unix_micros("ts")
    us = lambda t: int(t.timestamp() * 1_000_000)
    inside = F.array_compact(F.array(*[F.when((at >= us(a)) & (at < us(b)), n) for n, (a, b) in bounds.items()]))
    e = priced(spark, sf_dir).select("cost", F.explode(inside).alias("name"))
    return e.groupBy("name").agg(F.count("*").alias("entries"), F.sum(nano(F.col("cost"))).alias("nano"))


@query(f"""{priced_sql()}, w(name, a, b) AS (VALUES ('month', TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '2024-02-01 05:00:00'), ('week', TIMESTAMP '2024-01-15 05:00:00', TIMESTAMP '2024-01-22 05:00:00'), ('last-week', TIMESTAMP '2024-01-08 05:00:00', TIMESTAMP '2024-01-15 05:00:00'), ('last-3d', TIMESTAMP '2024-01-14 15:30:00', TIMESTAMP '2024-01-17 15:30:00'), ('2024-01-02..2024-01-04', TIMESTAMP '2024-01-02 05:00:00', TIMESTAMP '2024-01-05 05:00:00'))
SELECT name, count(*) AS entries, sum({nano_sql('cost')})::BIGINT AS nano FROM e JOIN w ON ts >= a AND ts < b GROUP BY 1""")
def named_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of windows named in words, in a zone of its own; each entry is tested against all of them in one pass."""
    zone = "America/New_York"
    bounds = {"month": month_window(_NOW, zone), "week": week_window(_NOW, zone)} | {t: parse_window(t, _NOW, zone, week_window(_NOW, zone)) for t in ("last-week", "last-3d", "2024-01-02..2024-01-04")}
    return _by_window(spark, sf_dir, bounds)


_LATE = dt.datetime(2024, 1, 27, 15, 30, tzinfo=dt.UTC)
_WEEK = (dt.datetime(2024, 1, 23, 7, tzinfo=dt.UTC), dt.datetime(2024, 1, 30, 7, tzinfo=dt.UTC))


@query(f"""{priced_sql()}, w(name, a, b) AS (VALUES ('this-week', TIMESTAMP '2024-01-23 07:00:00', TIMESTAMP '2024-01-27 15:30:00'), ('last-week', TIMESTAMP '2024-01-16 07:00:00', TIMESTAMP '2024-01-23 07:00:00'), ('3w-ago', TIMESTAMP '2024-01-02 07:00:00', TIMESTAMP '2024-01-09 07:00:00'),
('this-month', TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '2024-02-01 05:00:00'), ('last-month', TIMESTAMP '2023-12-01 05:00:00', TIMESTAMP '2024-01-01 05:00:00'), ('2m-ago', TIMESTAMP '2023-11-01 04:00:00', TIMESTAMP '2023-12-01 05:00:00'),
('last-7d', TIMESTAMP '2024-01-20 15:30:00', TIMESTAMP '2024-01-27 15:30:00'), ('prev-7d', TIMESTAMP '2024-01-13 15:30:00', TIMESTAMP '2024-01-20 15:30:00'), ('2024-01-02..2024-01-04', TIMESTAMP '2024-01-02 05:00:00', TIMESTAMP '2024-01-05 05:00:00'),
('past reset', TIMESTAMP '2024-01-23 07:00:00', TIMESTAMP '2024-01-30 07:00:00'))
SELECT name, count(*) AS entries, sum({nano_sql('cost')})::BIGINT AS nano FROM e JOIN w ON ts >= a AND ts < b GROUP BY 1""")
def window_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of every form of window token; weeks are those of a subscription, of which the present one ends now or, past it, at its reset."""
    zone = "America/New_York"
    bounds = {t: parse_window(t, _LATE, zone, _WEEK) for t in ("this-week", "last-week", "3w-ago", "this-month", "last-month", "2m-ago", "last-7d", "prev-7d", "2024-01-02..2024-01-04")}
    return _by_window(spark, sf_dir, bounds | {"past reset": parse_window("this-week", dt.datetime(2024, 2, 2, tzinfo=dt.UTC), zone, _WEEK)})


@query("""WITH i AS (SELECT c_custkey AS identity, c_mktsegment AS label FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY identity) AS n FROM i), s AS (SELECT identity, CASE WHEN n = 1 THEN label ELSE label || ' (' || n || ')' END AS shown FROM n)
SELECT o_orderkey AS order_id, shown FROM orders LEFT JOIN s ON identity = o_custkey""")
def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the collision-safe label of the identity that they belong to."""
    shown = attribution.collision_safe_labels(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"), F.col("c_mktsegment").alias("label")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("identity"))
    return o.join(shown, "identity", "left").select("order_id", "shown")


@query(f"WITH {USAGE_SQL}, r AS (SELECT source, root, slot, entry_id, row_number() OVER (ORDER BY source, root, slot, minutes, account IS NOT NULL, account, entry_id) AS place FROM (SELECT 's' || account % 2 AS source, 'r' || project AS root, model AS slot, CASE WHEN k % 2 = 0 THEN 300 ELSE 10080 END AS minutes, account, entry_id FROM u)) SELECT place, entry_id FROM r")
def identity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota identities in their full logical order, the account last."""
    u = usage(spark, sf_dir)
    i = F.struct(F.concat(F.lit("s"), F.col("account") % 2).alias("source"), F.concat(F.lit("r"), "project").alias("root"), F.col("model").alias("slot"), F.when(F.col("k") % 2 == 0, 300).otherwise(10080).alias("minutes"), F.col("account").alias("account"))
    return placed(u.select("entry_id", i.alias("identity")), ["identity", "entry_id"]).select("place", "entry_id")


@query(f"WITH {USAGE_SQL}, a AS (SELECT 0 AS source, entry_id AS native, ts FROM u WHERE model = 'error' UNION ALL SELECT 1, entry_id, date_trunc('hour', ts) FROM u WHERE model = 'signup'), r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, source, native) AS place FROM a) SELECT place, source, native FROM r")
def combined_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of two sources, latest first; ties in the order of sources, then in a source's own."""
    u = usage(spark, sf_dir)
    of = lambda m, s, t: u.where(F.col("model") == m).select(F.lit(s).alias("source"), F.col("entry_id").alias("native"), t.alias("ts"))
    both = of("error", 0, F.col("ts")).unionByName(of("signup", 1, F.date_trunc("hour", "ts")))
    return placed(both, [F.desc("ts"), "source", "native"]).select("place", "source", "native")
