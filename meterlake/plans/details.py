"""Filters, limits, claims and small rules of reports, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cache_dollars, hit_percent, nano, sample_prices, stable_sum
from ..functions.text import string_leaves
from ..functions.timekit import local_date, parse_filter_range
from ..operators import attribution, blocks, conversations, events, forecasts, intervals, quota, reports
from ..operators.ranks import sliding_median
from ..sources.tables import table
from .activity import BLOCKS_SQL, WEEK, WEEKS_SQL, _blocks, sample_weeks
from .analysis import _CACHE
from .registry import PRICES_SQL, USAGE_SQL, nano_sql, priced, priced_sql, query, sum_sql, usage


@query(f"{priced_sql()} SELECT 'merged' AS scope, count(*) AS entries, sum({nano_sql('cost')})::BIGINT AS nano FROM e UNION ALL SELECT 'one', count(*), sum({nano_sql('cost')})::BIGINT FROM e WHERE account = 1")
def account_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts merged, and one of them."""
    e = priced(spark, sf_dir)
    of = lambda scope, account: e.where(reports.of_account(account)).agg(F.count("*").alias("entries"), F.sum(nano(F.col("cost"))).alias("nano")).withColumn("scope", F.lit(scope))
    return of("merged", None).unionByName(of("one", 1))


@query(f"WITH RECURSIVE {USAGE_SQL}, {BLOCKS_SQL} SELECT session_id, epoch_us(start) AS start_us, entries FROM k WHERE start >= TIMESTAMP '2024-01-17 12:30:00' OR (start <= TIMESTAMP '2024-01-20 12:30:00' AND \"end\" > TIMESTAMP '2024-01-20 12:30:00')")
def recent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.recent(_blocks(spark, sf_dir), F.expr("timestamp'2024-01-20 12:30:00'")).select("session_id", F.unix_micros("start").alias("start_us"), "entries")


def _in_blocks(spark: SparkSession, sf_dir: str, entries: DataFrame) -> DataFrame:
    """Entries with ``start`` and ``end`` of their session's block; an entry meets the blocks of its session that touch its own five hours."""
    b = _blocks(spark, sf_dir).select("session_id", "start", "end")
    return intervals.assign(entries, b, "ts", 5 * 3600, by=["session_id"])


_TOTALS_SQL = f"{BLOCKS_SQL}, t AS (SELECT k.session_id, k.start, k.\"end\", sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM k JOIN u ON u.session_id = k.session_id AND u.ts >= k.start AND u.ts < k.\"end\" GROUP BY ALL)"


@query(f"""WITH RECURSIVE {USAGE_SQL}, {_TOTALS_SQL}, l(raw, lim) AS (SELECT 'max', max(total_tokens) FROM t WHERE "end" <= TIMESTAMP '2024-01-20 12:30:00' UNION ALL SELECT '123456x', 123456 UNION ALL SELECT 'none', NULL)
SELECT session_id, epoch_us(start) AS start_us, raw, lim::BIGINT AS token_limit, CASE WHEN lim > 0 THEN total_tokens / lim * 100 END AS limit_pct FROM t, l""")
def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks against a limit that is the most of all that have ended, a number, or no number."""
    u = usage(spark, sf_dir).select("session_id", "ts", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    t = _in_blocks(spark, sf_dir, u).groupBy("session_id", "start", "end").agg(F.sum("tokens").alias("total_tokens"))
    now, out = F.expr("timestamp'2024-01-20 12:30:00'"), None
    for raw in ("max", "123456x", "none"):
        part = blocks.token_limit(raw, t, now).select("session_id", F.unix_micros("start").alias("start_us"), F.lit(raw).alias("raw"), "token_limit", "limit_pct")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH RECURSIVE {USAGE_SQL}, {BLOCKS_SQL} SELECT k.session_id, epoch_us(k.start) AS start_us, arg_min(u.value, (u.ts, u.entry_id)) AS first_percent, arg_max(u.value, (u.ts, u.entry_id)) AS last_percent
FROM k JOIN u ON u.session_id = k.session_id AND u.ts >= k.start AND u.ts < k."end" GROUP BY ALL""")
def block_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last percent seen in each block."""
    at = F.struct("ts", "entry_id")
    return _in_blocks(spark, sf_dir, usage(spark, sf_dir)).groupBy("session_id", F.unix_micros("start").alias("start_us")).agg(F.min_by("value", at).alias("first_percent"), F.max_by("value", at).alias("last_percent"))


@query(f"""{priced_sql()}, r AS (SELECT session_id, project, sum({nano_sql('cost')})::BIGINT AS nano, count(*) FILTER (WHERE speed = 'fast') AS rebuilds, max(ts) AS last_ts, min(model) AS family FROM e GROUP BY ALL)
SELECT session_id, nano, rebuilds, family FROM r WHERE project IN (1, 2, 4) AND last_ts >= TIMESTAMP '2024-01-03 05:00:00' AND last_ts < TIMESTAMP '2024-02-02 05:00:00' AND rebuilds >= 5 AND family IN ('click', 'nosuch')""")
def browse_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by project, dates of a zone, the least number of rebuilds and families of models; a family that nobody knows adds none."""
    low, high = parse_filter_range("2024-01-03", "2024-02-01", "America/New_York")
    us = lambda t: int(t.timestamp() * 1_000_000)
    g = priced(spark, sf_dir).groupBy("session_id", "project").agg(F.sum(nano(F.col("cost"))).alias("nano"), F.count(F.when(F.col("speed") == "fast", 1)).alias("rebuilds"), F.unix_micros(F.max("ts")).alias("last"), F.min("model").alias("family"))
    kept = F.col("project").isin(1, 2, 4) & conversations.window_filter("last", F.lit(us(low)), F.lit(us(high))) & (F.col("rebuilds") >= 5) & F.col("family").isin("click", "nosuch")
    return g.where(kept).select("session_id", "nano", "rebuilds", "family")


@query(f"{priced_sql()} SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05 05:00:00' AND ts < TIMESTAMP '2024-01-08 05:00:00') AS dates, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-06 17:30:00') AS offsets, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 05:00:00') AS open FROM e")
def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds given as dates, as times with offsets of their own, and with one end open."""
    zone = "America/New_York"
    us = lambda t: None if t is None else F.lit(int(t.timestamp() * 1_000_000))
    ranges = {"dates": ("2024-01-05", "2024-01-07"), "offsets": ("2024-01-05T12:00:00+02:00", "2024-01-06T12:30:00"), "open": ("2024-01-20", None)}
    e = priced(spark, sf_dir).select(F.unix_micros("ts").alias("at"))
    inside = {k: conversations.window_filter("at", *map(us, parse_filter_range(*r, zone))) for k, r in ranges.items()}
    return e.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in inside.items()])


@query(f"WITH {USAGE_SQL} SELECT entry_id FROM u WHERE contains(lower(concat_ws(' ', entry_id, session_id, model, project, speed)), 'k 3') OR contains(lower(concat_ws(' ', entry_id, session_id, model, project, speed)), '9 view')")
def row_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text in any of a row's visible columns, or across two that stand side by side."""
    columns = ["entry_id", "session_id", "model", "project", "speed"]
    return usage(spark, sf_dir).where(reports.row_contains(columns, "K 3") | reports.row_contains(columns, "9 VIEW")).select("entry_id")


@query(f"{priced_sql()} SELECT model, {sum_sql()} AS cost_usd, count(*) AS entries, CASE WHEN sum(input_tokens + cache_create_tokens + cache_read_tokens) = 0 THEN 0.0::DOUBLE ELSE sum(cache_read_tokens)::BIGINT / sum(input_tokens + cache_create_tokens + cache_read_tokens)::BIGINT * 100 END AS hit_pct FROM e GROUP BY 1")
def section_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of one section of a comparison."""
    i, c, r = F.sum("input_tokens"), F.sum("cache_create_tokens"), F.sum("cache_read_tokens")
    g = priced(spark, sf_dir).groupBy("model").agg(stable_sum(F.col("cost")).alias("cost_usd"), F.count("*").alias("entries"), hit_percent(i, c, r).alias("hit_pct"), r.alias("read_tokens"))
    return g.select(*reports.SECTION_COLUMNS["models"])


_AS_OF = 1_705_800_000  # 2024-01-21


@query(f"""{priced_sql()}, b AS (SELECT DISTINCT account AS root, (epoch_us(ts) // 1000000 // 18000 * 18000)::BIGINT AS start, (epoch_us(ts) // 1000000 // 18000 * 18000 + 16200)::BIGINT AS reset FROM u WHERE k % 4 = 0)
SELECT root, start, project, sum({nano_sql('cost')})::BIGINT AS nano, count(*) AS entries FROM e JOIN b ON b.root = e.account AND epoch_us(ts) // 1000000 >= start AND epoch_us(ts) // 1000000 < least(reset, {_AS_OF}) GROUP BY ALL""")
def quota_block_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the projects of a root spent in each of its quota blocks, as far as the blocks had gone at an instant."""
    at = F.unix_seconds("ts")
    start = (F.floor(at / 18_000) * 18_000).cast("long")
    b = usage(spark, sf_dir).where("k % 4 = 0").select(F.col("account").alias("root"), start.alias("start"), (start + 16_200).alias("reset")).distinct()
    e = priced(spark, sf_dir).select(F.col("account").alias("root"), at.alias("ts"), "project", "cost")
    return attribution.block_spend(e, b, _AS_OF, 18_000).groupBy("root", "start", "project").agg(F.sum(nano(F.col("cost"))).alias("nano"), F.count("*").alias("entries"))


_TOKENS = "input_tokens + output_tokens + cache_create_tokens + cache_read_tokens"


@query(f"""WITH {USAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, model ORDER BY {_TOKENS} DESC, (speed IS NOT NULL) DESC, entry_id) AS rn, first_value('f' || entry_id) OVER (PARTITION BY session_id, model ORDER BY entry_id) AS path FROM u)
SELECT entry_id, session_id, model, path FROM r WHERE rn = 1""")
def dedup_sticky_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best entry of a key keeps the file of the first one."""
    u = usage(spark, sf_dir).withColumn("path", F.concat(F.lit("f"), "entry_id"))
    return events.dedup_usage(u, ["session_id", "model"], "path").select("entry_id", "session_id", "model", "path")


@query(f"""{_CACHE}, g AS (SELECT session_id, project, epoch_us(max(ts)) // 1000000 AS at, sum({nano_sql('saved')})::BIGINT - sum({nano_sql('wasted')})::BIGINT AS net, sum(CASE WHEN speed = 'fast' THEN cache_read_tokens ELSE 0 END)::BIGINT / nullif(sum(cache_read_tokens), 0)::BIGINT * 100 AS hit FROM c GROUP BY ALL),
b AS (SELECT *, count(hit) OVER w AS samples, median(hit) OVER w AS m FROM g WINDOW w AS (PARTITION BY project ORDER BY "at" RANGE BETWEEN 1209600 PRECEDING AND 1 PRECEDING)),
f AS (SELECT session_id, samples, round(CASE WHEN samples >= 10 THEN m END, 9) AS baseline, concat_ws(',', CASE WHEN net < 0 THEN 'net_negative' END, CASE WHEN samples >= 10 AND m - hit >= 5 THEN 'cache_drop' END) AS flags, samples < 10 AS unevaluated FROM b),
k AS (SELECT DISTINCT session_id FROM u)
SELECT session_id, samples, baseline, flags, CASE WHEN unevaluated IS NULL THEN 'no_data' WHEN flags <> '' THEN 'anomaly' WHEN unevaluated THEN 'unevaluated' ELSE 'ok' END AS verdict FROM k LEFT JOIN f USING (session_id)""".replace(" AS at,", ' AS "at",'))
def session_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions against the median of those that ended in the fourteen days up to a second before, ten at least, and a verdict on each."""
    e = priced(spark, sf_dir).withColumn("d", cache_dollars())
    reads = F.sum("cache_read_tokens")
    g = e.groupBy("session_id", "project").agg(F.unix_seconds(F.max("ts")).alias("at"), (F.sum(nano(F.col("d.saved"))) - F.sum(nano(F.col("d.wasted")))).alias("net"), F.try_divide(F.sum(F.when(F.col("speed") == "fast", F.col("cache_read_tokens")).otherwise(0)), reads).alias("hit"))
    g = g.withColumn("hit", F.col("hit") * 100)
    a = reports.anomalies(sliding_median(g, ["project"], "at", "hit", 14 * 86_400, 10), 5.0)
    all_ = usage(spark, sf_dir).select("session_id").distinct()
    return reports.verdict(all_.join(a, "session_id", "left")).select("session_id", "samples", F.round("baseline", 9).alias("baseline"), "flags", "verdict")


@query(f"""WITH {USAGE_SQL}, s AS (SELECT session_id, max(least(100.0::DOUBLE, value)) AS percent, max(least(100.0::DOUBLE, value)) * 1.3::DOUBLE AS projected FROM u GROUP BY 1), t(threshold) AS (VALUES (70), (90), (100))
SELECT session_id, threshold, CASE WHEN percent >= threshold THEN 'actual' ELSE 'projected' END AS kind FROM s, t WHERE percent >= threshold OR projected >= threshold""")
def threshold_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = usage(spark, sf_dir).groupBy("session_id").agg(F.max(F.least(F.lit(100.0), "value")).alias("percent"))
    return quota.claims(s.withColumn("projected", F.col("percent") * 1.3), [70, 90, 100], ["session_id"])


@query(f"""{priced_sql()}, {WEEKS_SQL}, c AS (SELECT week, session_id, sum({nano_sql('cost')})::BIGINT AS nano, max(value) % 20 AS percent FROM e JOIN weeks ON ts >= start AND ts < "end" GROUP BY ALL),
r AS (SELECT *, CASE WHEN percent > 0 THEN nano / 1e9 / percent END AS rate FROM c), m AS (SELECT *, count(rate) OVER w AS n, median(rate) OVER w AS med FROM r WINDOW w AS (PARTITION BY session_id ORDER BY week RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT week, session_id, round(CASE WHEN percent >= 10 AND rate IS NOT NULL THEN rate WHEN n >= 2 THEN med ELSE rate END, 9) AS rate, CASE WHEN percent >= 10 AND rate IS NOT NULL THEN 'this_week' WHEN n >= 2 THEN 'median' ELSE 'sparse' END AS source FROM m""")
def rate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars per percent of each week and where they come from."""
    e = intervals.assign(priced(spark, sf_dir), sample_weeks(spark), "ts", WEEK)
    c = e.groupBy("week", "session_id").agg(F.sum(nano(F.col("cost"))).alias("nano"), (F.max("value") % 20).alias("percent"))
    r = c.withColumn("rate", F.when(F.col("percent") > 0, F.col("nano") / 1e9 / F.col("percent")))
    m = reports.trailing_median(r, ["session_id"], "week", "rate", 4, 2)
    s = forecasts.rate_source(F.col("percent"), F.col("rate"), F.col("baseline"))
    return m.select("week", "session_id", s.alias("s")).select("week", "session_id", F.round("s.rate", 9).alias("rate"), "s.source")


@query(f"""{priced_sql()}, a AS (SELECT project, {sum_sql()} AS a, sum(input_tokens)::BIGINT AS a_tokens FROM e WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09' GROUP BY 1), b AS (SELECT project, {sum_sql()} AS b, sum(input_tokens)::BIGINT AS b_tokens FROM e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' GROUP BY 1)
SELECT project, a / 7.0::DOUBLE AS a, b / 3.0::DOUBLE AS b, a_tokens, b_tokens FROM a FULL JOIN b USING (project)""")
def uneven_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows of unlike length: costs by the day, tokens as they are."""
    e = priced(spark, sf_dir)
    of = lambda lo, hi, n: e.where(f"ts >= timestamp'{lo}' and ts < timestamp'{hi}'").groupBy("project").agg(stable_sum(F.col("cost")).alias(n), F.sum("input_tokens").alias(f"{n}_tokens"))
    j = of("2024-01-02", "2024-01-09", "a").join(of("2024-01-10", "2024-01-13", "b"), "project", "full_outer")
    return reports.per_day(j, 7.0, 3.0, {"a": 7.0, "b": 3.0})


_FIELDS = ["input_rate", "output_rate", "create_rate", "read_rate"]


@query(f"""WITH {PRICES_SQL}, a AS (UNPIVOT (SELECT model, {', '.join(_FIELDS)} FROM prices WHERE model <> 'signup') ON {', '.join(_FIELDS)} INTO NAME field VALUE ours), b AS (UNPIVOT (SELECT model, {', '.join(_FIELDS)} FROM prices) ON {', '.join(_FIELDS)} INTO NAME field VALUE v),
t AS (SELECT model, field, CASE WHEN field = 'output_rate' AND model = 'view' THEN v * 2 ELSE v END AS theirs FROM b), l(model, field) AS (VALUES ('view', 'output_rate'), ('click', 'input_rate'), ('signup', NULL), ('error', NULL), ('gone', 'input_rate'))
SELECT l.model, l.field FROM l WHERE NOT CASE WHEN l.field IS NULL THEN EXISTS (SELECT 1 FROM t WHERE t.model = l.model) AND NOT EXISTS (SELECT 1 FROM a WHERE a.model = l.model)
ELSE EXISTS (SELECT 1 FROM a JOIN t USING (model, field) WHERE a.model = l.model AND a.field = l.field AND abs(ours - theirs) > 1e-12) END""")
def stale_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a list of known price differences that differ no more: a field whose prices agree, a model that both lists have."""
    full = sample_prices(spark).unpivot(["model"], _FIELDS, "field", "theirs")
    theirs = full.withColumn("theirs", F.when((F.col("field") == "output_rate") & (F.col("model") == "view"), F.col("theirs") * 2).otherwise(F.col("theirs")))
    ours = full.where("model <> 'signup'").withColumnRenamed("theirs", "ours")
    listed = spark.sql("select * from values ('view', 'output_rate'), ('click', 'input_rate'), ('signup', null), ('error', null), ('gone', 'input_rate') as t(model, field)")
    drift = ours.join(theirs, ["model", "field"]).where("abs(ours - theirs) > 1e-12").select("model", "field")
    lacking = theirs.select("model").distinct().join(ours.select("model"), "model", "left_anti").withColumn("field", F.lit(None).cast("string"))
    real = drift.unionByName(lacking)
    return listed.join(real, listed.model.eqNullSafe(real.model) & listed.field.eqNullSafe(real.field), "left_anti")


@query(f"WITH {USAGE_SQL} SELECT (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo')::DATE AS day, strftime(date_trunc('week', ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo'), '%b %d') AS week_label, count(*) AS entries FROM u GROUP BY ALL")
def zone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a zone with the label of their week."""
    day = local_date(F.col("ts"), "Asia/Tokyo")
    return usage(spark, sf_dir).groupBy(day.alias("day")).agg(F.count("*").alias("entries")).select("day", F.date_format(F.date_trunc("week", "day"), "MMM dd").alias("week_label"), "entries")


# Tool blocks made from turns: every kind of tool, with and without its main argument.
_TOOL = "['Bash', 'Edit', 'Write', 'Task', 'Other'][turn % 5 + 1]"
_PREVIEW = f"""CASE WHEN turn % 7 = 6 THEN {_TOOL} WHEN turn % 5 = 0 THEN 'ls ' || conv_id WHEN turn % 5 < 3 THEN 'src/' || role || '.py' WHEN turn % 5 = 3 THEN 'worker' ELSE 'x' || turn END"""


@query(f"SELECT conv_id, turn, {_TOOL} AS tool, {_PREVIEW} AS preview, turn % 5 IN (1, 2) AND turn % 7 <> 6 AS writes FROM conversations")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with their previews and whether they write a file."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.col("turn") % 5)
    t = F.col("t")
    name = F.element_at(F.array(*map(F.lit, ("Bash", "Edit", "Write", "Task", "Other"))), (t + 1).cast("int"))
    one = lambda k, v: F.create_map(F.lit(k), v)
    arguments = (F.when(F.col("turn") % 7 == 6, F.create_map().cast("map<string,string>")).when(t == 0, one("command", F.concat(F.lit("ls "), "conv_id", F.lit("\nrm x"))))
                 .when(t < 3, one("file_path", F.concat(F.lit("src/"), "role", F.lit(".py")))).when(t == 3, one("subagent_type", F.lit("worker"))).otherwise(one("q", F.concat(F.lit("x"), "turn"))))
    b = c.withColumn("name", name).withColumn("input", arguments)
    rows = b.withColumn("blocks", F.array(F.struct(F.lit("text").alias("type"), "name", "input"), F.struct(F.lit("tool_use").alias("type"), "name", "input")))
    writes = conversations.tool_touches(rows).select("conv_id", "turn", F.lit(True).alias("w"))
    return b.join(writes, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("name").alias("tool"), conversations.tool_preview(F.col("name"), F.col("input")).alias("preview"), F.coalesce("w", F.lit(False)).alias("writes"))


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS chars, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN starts_with(text, '/') THEN 'command' WHEN role = 'system' THEN 'system' WHEN role = 'user' THEN 'prompt' WHEN role = 'assistant' THEN 'reply' ELSE 'tool' END AS kind FROM conversations)
SELECT conv_id, turn, kind, chars, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, count(*) FILTER (WHERE kind = 'prompt') OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM t""")
def turn_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.turn_outline(table(spark, sf_dir, "conversations"))


_WEEK_END = "(epoch_us(ts) // 1000000 // 43200 * 43200 + 43200 + (k % 3) * 21600)::BIGINT"


@query(f"""WITH {USAGE_SQL}, s AS (SELECT session_id, entry_id, ts, epoch_us(ts) // 1000000 AS t, least(100.0::DOUBLE, value) AS percent, {_WEEK_END} AS e FROM u), l AS (SELECT *, lag(percent) OVER w AS pp, lag(e) OVER w AS pe FROM s WINDOW w AS (PARTITION BY session_id ORDER BY ts, entry_id))
SELECT entry_id, session_id, percent, pp AS prev_percent, pp - percent >= 25 AS in_history FROM l WHERE pe > t AND e >= pe AND (pp - percent >= 25 OR (percent <= 1 AND pp - percent >= 3))""")
def week_reset_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resets of weeks that were still open, seen live, and whether a scan of history sees them too."""
    at = F.unix_seconds("ts")
    end = (F.floor(at / 43_200) * 43_200 + 43_200 + (F.col("k") % 3) * 21_600).cast("long")
    s = usage(spark, sf_dir).select("session_id", "entry_id", F.unix_micros("ts").alias("us"), at.alias("ts"), F.least(F.lit(100.0), "value").alias("percent"), end.alias("week_end"))
    order = ["us", "entry_id"]
    past = quota.week_resets_seen(s, ["session_id"], order).select("entry_id", F.lit(True).alias("in_history"))
    live = quota.week_resets_seen(s, ["session_id"], order, live=True)
    return live.join(past, "entry_id", "left").select("entry_id", "session_id", "percent", "prev_percent", F.coalesce("in_history", F.lit(False)).alias("in_history"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE concat_ws('|', CASE WHEN text <> '' THEN substr(text, 1, 16000) END, role, 'deep' || turn) END AS leaves FROM conversations""")
def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in nested arguments, written as JSON and read back; one document in five is broken."""
    inner = F.struct(F.array(F.col("role"), F.lit("")).alias("x"), F.struct(F.concat(F.lit("deep"), "turn").alias("y")).alias("z"), F.col("turn").alias("n"))
    doc = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("a"), inner.alias("b")))
    broken = F.when(F.col("turn") % 5 == 4, F.concat(doc, F.lit("}"))).otherwise(doc)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(string_leaves(broken), "|").alias("leaves"))
