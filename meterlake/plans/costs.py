"""Cost rollups: days, months, weeks, sessions, models, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cache_create_cost, cumulative_entry_cost, sample_prices, stable_sum, tiered, with_prices
from ..functions.timekit import local_date, local_month, week_start
from ..operators import rollups
from ..operators.exact import exact_sum
from ..operators.events import best_per_key, cumulative_advances, dedup_usage, dedup_violations
from .registry import COST_SQL, CREATE_SPLIT_SQL, PRICES_SQL, ROLLUP_SQL, USAGE_SQL, nano_sql, priced, priced_sql, query, sum_sql, tier_sql, usage

def day() -> Column:
    return local_date(F.col("ts"))


@query(f"{priced_sql()} SELECT ts::DATE AS day, {ROLLUP_SQL} FROM e GROUP BY 1")
def daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rollup(priced(spark, sf_dir), [day().alias("day")])


@query(f"{priced_sql('display')} SELECT ts::DATE AS day, {ROLLUP_SQL} FROM e GROUP BY 1")
def daily_cost_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rollup(priced(spark, sf_dir, "display"), [day().alias("day")])


@query(f"{priced_sql('calculate')} SELECT ts::DATE AS day, {ROLLUP_SQL} FROM e GROUP BY 1")
def daily_cost_calculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rollup(priced(spark, sf_dir, "calculate"), [day().alias("day")])


@query(f"{priced_sql()} SELECT (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS day, {ROLLUP_SQL} FROM e GROUP BY 1")
def daily_tz_newyork(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rollup(priced(spark, sf_dir), [local_date(F.col("ts"), "America/New_York").alias("day")])


@query(f"{priced_sql()} SELECT strftime(ts, '%Y-%m') AS month, {ROLLUP_SQL} FROM e GROUP BY 1")
def monthly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rollup(priced(spark, sf_dir), [local_month(F.col("ts")).alias("month")])


@query(f"{priced_sql()} SELECT (ts::DATE - ((isodow(ts) - 1 - 6 + 7) % 7)::INTEGER)::DATE AS week, {ROLLUP_SQL} FROM e GROUP BY 1")
def calendar_week_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks from Sunday."""
    return rollups.rollup(priced(spark, sf_dir), [week_start(day(), 6).alias("week")])


@query(f"""{priced_sql()}, d AS (SELECT ts::DATE AS day, project, {nano_sql('cost')} AS n FROM e), g AS (SELECT day, project, sum(n)::BIGINT AS nano FROM d GROUP BY ALL),
t AS (SELECT project, sum(nano)::BIGINT AS group_total, row_number() OVER (ORDER BY sum(nano) DESC, project) AS group_rank FROM g GROUP BY 1)
SELECT day, project, nano, group_total, group_rank FROM g JOIN t USING (project)""")
def daily_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = priced(spark, sf_dir).groupBy(day().alias("day"), "project").agg(F.sum(F.floor(F.col("cost") * 1e9 + 0.5).cast("long")).alias("nano"))
    return rollups.ranked_groups(e, "project", "nano").select("day", "project", "nano", "group_total", "group_rank")


@query(f"""{priced_sql()}, m AS (SELECT ts::DATE AS bucket, CASE WHEN speed = 'fast' THEN model || '-fast' ELSE model END AS model, {sum_sql()} AS cost_usd, count(*) AS n FROM e GROUP BY ALL)
SELECT bucket, sum({nano_sql('cost_usd')})::DOUBLE / 1e9 AS cost_usd, sum(n)::BIGINT AS entries, string_agg(model, ',' ORDER BY cost_usd DESC, model) AS models FROM m GROUP BY 1""")
def model_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.model_breakdown(priced(spark, sf_dir), day())


@query(f"{priced_sql()} SELECT session_id, {ROLLUP_SQL}, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(DISTINCT model) AS models, arg_max(project, (ts, entry_id)) AS project FROM e GROUP BY 1")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rollups.sessions(priced(spark, sf_dir))
    return s.withColumn("first_us", F.unix_micros("first_ts")).withColumn("last_us", F.unix_micros("last_ts")).drop("first_ts", "last_ts")


@query(f"{priced_sql()} SELECT {ROLLUP_SQL} FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def range_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends count."""
    return rollups.rollup(priced(spark, sf_dir).where("ts between timestamp'2024-01-05' and timestamp'2024-01-12'"), [])


@query(f"{priced_sql('calculate')} SELECT model, {sum_sql()} AS cost_usd, sum(CASE WHEN input_tokens > 200000 THEN 1 ELSE 0 END)::BIGINT AS over_tier, {sum_sql(tier_sql('input_tokens', 'input_rate', 'input_hi'))} AS input_usd FROM e GROUP BY 1")
def tiered_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = priced(spark, sf_dir, "calculate")
    part = tiered(F.col("input_tokens"), F.col("input_rate"), F.col("input_hi"))
    return e.groupBy("model").agg(stable_sum(F.col("cost")).alias("cost_usd"), F.sum((F.col("input_tokens") > 200_000).cast("long")).alias("over_tier"), stable_sum(part).alias("input_usd"))


@query(f"{priced_sql()} SELECT model, {sum_sql(CREATE_SPLIT_SQL)} AS create_usd FROM e GROUP BY 1")
def cache_ttl_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy("model").agg(stable_sum(cache_create_cost(F.col("cache_create_tokens"), F.col("cache_1h_tokens"))).alias("create_usd"))


_IN = "greatest(0, input_tokens - cache_read_tokens)"
_CODEX = f"(({tier_sql(_IN, 'input_rate', 'input_hi', 272000)}) + ({tier_sql('cache_read_tokens', 'read_rate', 'read_hi', 272000)}) + ({tier_sql('output_tokens', 'output_rate', 'output_hi', 272000)})) * CASE WHEN speed = 'fast' THEN coalesce(fast_factor, 2.0::DOUBLE) ELSE 1.0::DOUBLE END"


@query(f"{priced_sql()} SELECT ts::DATE AS day, model, {sum_sql(_CODEX)} AS cost_usd, sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM e GROUP BY ALL")
def codex_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = cumulative_entry_cost(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("output_tokens"))
    return priced(spark, sf_dir).groupBy(day().alias("day"), "model").agg(stable_sum(cost).alias("cost_usd"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


@query(f"""{priced_sql()}, t AS (SELECT session_id, sum({nano_sql('cost')})::BIGINT AS nano, count(*) AS entries FROM e GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY abs(nano) DESC, session_id::VARCHAR) AS rn FROM t)
SELECT CASE WHEN rn <= 5 THEN session_id::VARCHAR ELSE '(other)' END AS session, sum(nano)::BIGINT AS nano, sum(entries)::BIGINT AS entries FROM r GROUP BY 1""")
def breakdown_top5_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = priced(spark, sf_dir).groupBy("session_id").agg(F.sum(F.floor(F.col("cost") * 1e9 + 0.5).cast("long")).alias("nano"), F.count("*").alias("entries"))
    return rollups.top_and_other(t.withColumn("session", F.col("session_id").cast("string")), "session", "nano", 5, ["nano", "entries"])


_TOTAL = "input_tokens + output_tokens + cache_create_tokens + cache_read_tokens"


@query(f"""WITH {USAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, model, k ORDER BY {_TOTAL} DESC, (speed IS NOT NULL) DESC, entry_id) AS rn FROM u)
SELECT entry_id, session_id, model, k, speed FROM r WHERE rn = 1""")
def dedup_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_usage(usage(spark, sf_dir), ["session_id", "model", "k"]).select("entry_id", "session_id", "model", "k", "speed")


@query(f"""WITH {USAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, model, k ORDER BY entry_id) AS rn FROM u), g AS (SELECT session_id, model, k, count(*) AS n FROM r WHERE rn = 1 GROUP BY ALL)
SELECT count(*) FILTER (WHERE n > 1) AS violations FROM g""")
def dedup_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["session_id", "model", "k"]
    return dedup_violations(dedup_usage(usage(spark, sf_dir), keys), keys)


@query(f"""WITH {USAGE_SQL}, b AS (SELECT *, max(input_tokens) OVER (PARTITION BY session_id ORDER BY ts, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u)
SELECT entry_id, session_id, input_tokens FROM b WHERE input_tokens > coalesce(before, 0)""")
def cumulative_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir).withColumn("pos", F.struct("ts", "entry_id"))
    return cumulative_advances(u, ["session_id"], "pos", "input_tokens").select("entry_id", "session_id", "input_tokens")


@query(f"{priced_sql()} SELECT ts::DATE AS day, model, project, grouping(model, project)::INTEGER AS level, {sum_sql()} AS cost_usd, count(*) AS entries FROM e GROUP BY GROUPING SETS ((day), (day, model), (day, project))")
def grouping_sets_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = priced(spark, sf_dir).withColumn("day", day())
    g = e.groupingSets([["day"], ["day", "model"], ["day", "project"]], "day", "model", "project")
    out = g.agg(F.grouping_id("day", "model", "project").cast("int").alias("level"), stable_sum(F.col("cost")).alias("cost_usd"), F.count("*").alias("entries"))
    return out.select("day", "model", "project", "level", "cost_usd", "entries")


@query(f"""{priced_sql()}, t AS (SELECT {sum_sql()} AS whole, sum(CASE WHEN model = 'click' THEN {nano_sql('cost')} END)::BIGINT AS c1, sum(CASE WHEN model = 'purchase' THEN {nano_sql('cost')} END)::BIGINT AS c2,
sum({nano_sql('cost')})::BIGINT AS total, (ts::DATE - (isodow(ts) - 1)::INTEGER)::DATE AS "row" FROM e GROUP BY 5) SELECT "row", c1, c2, total, total - c1 - c2 AS other FROM t""")
def crosstab_week_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rollups.crosstab(priced(spark, sf_dir), week_start(day()), "model", ["click", "purchase"], F.floor(F.col("cost") * 1e9 + 0.5).cast("long"))
    return c.withColumn("other", F.col("total") - F.col("c1") - F.col("c2"))


@query(f"WITH {USAGE_SQL}, {PRICES_SQL} SELECT model, count(*) AS entries FROM u WHERE model NOT IN (SELECT model FROM prices WHERE model <> 'view') GROUP BY 1")
def pricing_coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that a price list, here one without views, doesn't know."""
    known = sample_prices(spark).where("model <> 'view'").select("model")
    return usage(spark, sf_dir).join(known, "model", "left_anti").groupBy("model").agg(F.count("*").alias("entries"))


_FIELDS = ["input_rate", "output_rate", "create_rate", "read_rate"]


@query(f"""WITH {PRICES_SQL}, a AS (UNPIVOT (SELECT model, {', '.join(_FIELDS)} FROM prices) ON {', '.join(_FIELDS)} INTO NAME field VALUE ours),
b AS (SELECT model, field, CASE WHEN field = 'output_rate' THEN ours * 1.5::DOUBLE ELSE ours END AS theirs FROM a WHERE model <> 'click')
SELECT model, field, ours, theirs FROM a FULL JOIN b USING (model, field) WHERE ours IS NULL OR theirs IS NULL OR abs(ours - theirs) > 1e-12""")
def pricing_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two price lists, field by field; the other one lacks clicks and has dearer output."""
    a = sample_prices(spark).unpivot(["model"], _FIELDS, "field", "ours")
    b = a.where("model <> 'click'").select("model", "field", F.when(F.col("field") == "output_rate", F.col("ours") * 1.5).otherwise(F.col("ours")).alias("theirs"))
    return a.join(b, ["model", "field"], "full_outer").where("ours is null or theirs is null or abs(ours - theirs) > 1e-12")


@query(f"""{priced_sql('calculate')} SELECT model, count(*) AS entries, count(*) FILTER (WHERE abs(cost - cost_usd_raw) > 0.01) AS mismatched, max(abs(cost - cost_usd_raw)) AS worst FROM e WHERE cost_usd_raw IS NOT NULL GROUP BY 1""")
def price_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(F.col("cost") - F.col("cost_usd_raw"))
    e = priced(spark, sf_dir, "calculate").where("cost_usd_raw is not null")
    return e.groupBy("model").agg(F.count("*").alias("entries"), F.count(F.when(off > 0.01, 1)).alias("mismatched"), F.max(off).alias("worst"))


@query(f"WITH {USAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, entry_id DESC) AS rn FROM u) SELECT session_id, entry_id, model FROM r WHERE rn = 1")
def latest_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_per_key(usage(spark, sf_dir), ["session_id"], [F.desc("ts"), F.desc("entry_id")]).select("session_id", "entry_id", "model")


@query(f"WITH {USAGE_SQL}, {PRICES_SQL}, c AS (SELECT {COST_SQL['auto']} AS cost, u.* FROM u LEFT JOIN prices USING (model)) SELECT account, {sum_sql()} AS cost_usd, count(*) AS entries FROM c WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def account_range_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open range, synthetic entries included."""
    from ..functions.money import entry_cost

    e = with_prices(usage(spark, sf_dir).where("ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-20'"), sample_prices(spark))
    return e.groupBy("account").agg(stable_sum(entry_cost("auto", False)).alias("cost_usd"), F.count("*").alias("entries"))


@query(f"""WITH {USAGE_SQL}, d AS (SELECT model, coalesce(cost_usd_raw, 0.0::DOUBLE) AS cost FROM u WHERE model <> 'error')
SELECT model, sum((cost * pow(2.0::DOUBLE, 80))::HUGEINT)::VARCHAR::DOUBLE / pow(2.0::DOUBLE, 80) AS cost_usd, count(*) AS n FROM d GROUP BY 1""")
def exact_cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded costs added up without rounding and rounded once. In SQL they are whole numbers of 2 ** -80 dollars, which holds costs of a millionth and more exactly."""
    return exact_sum(priced(spark, sf_dir, "display"), ["model"], F.col("cost"), "cost_usd")
