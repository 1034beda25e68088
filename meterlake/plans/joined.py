"""Weekly reports, project sorting, browse filters and drift counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import nano, stable_sum

from ..sources.logs import envelope
from ..sources.tables import classify_usage_lines, table
from .registry import USAGE_SQL, nano_sql, priced, priced_sql, query, sum_sql, usage

_WEEK = "date_trunc('week', ts)::DATE"


@query(f"""{priced_sql()}, c AS (SELECT {_WEEK} AS week, account, sum({nano_sql('cost')})::BIGINT AS nano FROM e GROUP BY ALL), p AS (SELECT date_trunc('week', ts + INTERVAL 7 DAY)::DATE AS week, account, max(least(100.0::DOUBLE, value)) AS percent FROM u GROUP BY ALL),
k AS (SELECT week, account FROM c UNION SELECT week, account FROM p) SELECT week, account, nano, percent, CASE WHEN percent > 0 THEN nano / 1e9 / percent END AS usd_per_pct FROM k LEFT JOIN c USING (week, account) LEFT JOIN p USING (week, account)""")
def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks known from costs or from usage, each with what there is of both."""
    week = F.to_date(F.date_trunc("week", "ts")).alias("week")
    c = priced(spark, sf_dir).groupBy(week, "account").agg(F.sum(nano(F.col("cost"))).alias("nano"))
    # usage is reported a week late
    late = F.date_add(F.to_date(F.date_trunc("week", "ts")), 7).alias("week")
    p = usage(spark, sf_dir).groupBy(late, "account").agg(F.max(F.least(F.lit(100.0), "value")).alias("percent"))
    j = c.join(p, ["week", "account"], "full_outer")
    return j.withColumn("usd_per_pct", F.when(F.col("percent") > 0, F.col("nano") / 1e9 / F.col("percent")))


@query(f"{priced_sql()}, g AS (SELECT project, {sum_sql()} AS cost, CASE WHEN project <> 3 THEN count(DISTINCT session_id) END AS used FROM e GROUP BY 1) SELECT project, cost, used, row_number() OVER (ORDER BY coalesce(used, -1) DESC, lower(project::VARCHAR)) AS place FROM g")
def project_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by use, unknown use as less than none, ties by name."""
    from pyspark.sql import Window

    g = priced(spark, sf_dir).groupBy("project").agg(stable_sum(F.col("cost")).alias("cost"), F.countDistinct("session_id").alias("used")).withColumn("used", F.when(F.col("project") != 3, F.col("used")))
    w = Window.orderBy(F.coalesce("used", F.lit(-1)).desc(), F.lower(F.col("project").cast("string")))
    return g.withColumn("place", F.row_number().over(w))


@query(f"{priced_sql()}, s AS (SELECT session_id, project, max(ts) AS last_ts, {sum_sql()} AS cost FROM e GROUP BY ALL) SELECT session_id, project, cost FROM s WHERE project IN (1, 4) AND last_ts >= TIMESTAMP '2024-01-30 06:00:00' AND last_ts < TIMESTAMP '2024-01-31' AND cost BETWEEN 1000 AND 1600")
def browse_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by date of their last entry, project and cost."""
    s = priced(spark, sf_dir).groupBy("session_id", "project").agg(F.max("ts").alias("last_ts"), stable_sum(F.col("cost")).alias("cost"))
    return s.where("project in (1, 4) and last_ts >= timestamp'2024-01-30 06:00:00' and last_ts < timestamp'2024-01-31' and cost between 1000 and 1600").drop("last_ts")


@query(f"""WITH {USAGE_SQL} SELECT CASE WHEN entry_id % 10 = 0 THEN 'malformed' WHEN model = 'view' THEN 'type' WHEN entry_id % 7 = 0 THEN 'timestamp' WHEN model = 'error' THEN 'synthetic' WHEN entry_id % 13 = 0 THEN 'bad_timestamp' END AS skip_reason, count(*) AS lines, sum(CASE WHEN entry_id % 10 <> 0 THEN input_tokens ELSE 0 END)::BIGINT AS tokens FROM u GROUP BY 1""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as log lines, some of them broken, and read back."""
    u = usage(spark, sf_dir)
    line = F.to_json(F.struct(
        F.when(F.col("model") == "view", "user").otherwise("assistant").alias("type"),
        F.when(F.col("entry_id") % 7 == 0, "").when(F.col("entry_id") % 13 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.struct(F.when(F.col("model") == "error", "<synthetic>").otherwise(F.col("model")).alias("model"), F.struct("input_tokens").alias("usage")).alias("message")))
    lines = u.select(F.lit("f").alias("source_path"), F.when(F.col("entry_id") % 10 == 0, F.substring(line, 2, 40)).otherwise(line).alias("line"))
    return classify_usage_lines(lines).groupBy("skip_reason").agg(F.count("*").alias("lines"), F.sum("input_tokens").alias("tokens"))


@query(f"WITH {USAGE_SQL}, g AS (SELECT project, count(*) AS n FROM u GROUP BY 1) SELECT '{{\"schemaVersion\":1,\"project\":' || project || ',\"n\":' || n || '}}' AS json FROM g")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope(usage(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n")))


@query(f"WITH {USAGE_SQL}, d AS (SELECT entry_id, k FROM u WHERE cache_create_tokens <> 0 OR cache_read_tokens <> 0) SELECT count(*) AS active, (SELECT count(*) FROM u) - count(*) AS idle FROM d")
def cache_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = (F.col("cache_create_tokens") != 0) | (F.col("cache_read_tokens") != 0)
    return usage(spark, sf_dir).agg(F.count(F.when(active, 1)).alias("active"), F.count(F.when(~active, 1)).alias("idle"))


@query("SELECT n_name AS nation, r_name AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def nation_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are summed up by nation before two small tables are joined on."""
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return g.join(n, "n_nationkey").select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "customers", "balance")


@query("SELECT o_orderpriority AS priority, count(*) AS late FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY) GROUP BY 1")
def late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semi join with a range: orders of which an item was shipped more than ninety days later."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    late = o.join(li, (o.o_orderkey == li.l_orderkey) & (li.l_shipdate > o.o_orderdate + F.expr("interval 90 days")), "left_semi")
    return late.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("late"))


@query("SELECT c_custkey AS cust, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with no order since 2000."""
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'2000-01-01'")
    c = table(spark, sf_dir, "customer").join(recent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("name"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    g = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))).alias("month"))
    return g.agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS items, round(sum(l_quantity), 2) AS quantity, round(sum(round(l_extendedprice * (1 - l_discount), 4)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-06-01' GROUP BY ALL")
def item_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2000-06-01'")
    paid = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")
    return li.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(paid), 2).cast("double").alias("revenue"))


def share_markdown(rows: DataFrame, title: str, limit: int = 200) -> str:
    """A report's first ``limit`` rows as a Markdown document, for presentation; it says so if there are more."""
    from ..functions.text import markdown_table

    head = rows.limit(limit + 1).collect()
    more = f"\nThe first {limit} rows; there are more.\n" if len(head) > limit else ""
    return f"# {title}\n\n{markdown_table(head[:limit], rows.columns)}\n{more}"


