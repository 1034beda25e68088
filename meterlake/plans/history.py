"""Milestone history, checks of milestones, and refreshes after changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history
from ..operators.consensus import decisions
from ..streaming.incremental import apply_feed, refresh_groups
from .registry import USAGE_SQL, query, usage

_CYCLES = f"""{USAGE_SQL}, s AS (SELECT *, epoch_us(ts) // 1000000 AS x FROM u), ret AS (SELECT session_id % 9 AS account, 'w' || (x // 604800) AS key, min(x // 604800 * 604800 + session_id % 4 * 40000) AS start, max(x // 604800 * 604800 + 604800 + k * 2500) AS "end" FROM s GROUP BY ALL),
rs AS (SELECT DISTINCT session_id % 9 AS account, 'w' || (x // 604800) AS key, x AS "at" FROM s WHERE model = 'error' AND entry_id % 7 = 0),
cut AS (SELECT account, key, start, "end" FROM ret UNION SELECT account, key, "at", "end" FROM ret JOIN rs USING (account, key) WHERE "at" > start AND "at" < "end"),
cyc AS (SELECT account, key, start, coalesce(lead(start) OVER (PARTITION BY account, key ORDER BY start), "end") AS "end" FROM cut),
pts AS (SELECT account, "at", lead("at") OVER (PARTITION BY account ORDER BY "at") AS stop FROM (SELECT account, start AS "at" FROM cyc UNION SELECT account, "end" FROM cyc)),
own AS (SELECT p.account, "at", stop, c.key, c.start, c."end", row_number() OVER (PARTITION BY p.account, "at" ORDER BY c.start DESC, c."end" DESC, c.key DESC) AS rn FROM pts p JOIN cyc c ON c.account = p.account AND c.start <= "at" AND "at" < c."end" WHERE stop IS NOT NULL),
o1 AS (SELECT * FROM own WHERE rn = 1), o2 AS (SELECT *, CASE WHEN lag(key) OVER w = key AND lag(start) OVER w = start AND lag("end") OVER w = "end" AND lag(stop) OVER w = "at" THEN 0 ELSE 1 END AS new FROM o1 WINDOW w AS (PARTITION BY account ORDER BY "at")),
o3 AS (SELECT *, sum(new) OVER (PARTITION BY account ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS run FROM o2), pc AS (SELECT account, key, start, "end", min("at") AS piece, max(stop) AS piece_end FROM o3 GROUP BY account, key, start, "end", run),
mi AS (SELECT session_id % 9 AS account, x AS "at", k::INTEGER AS percent, value AS cumulative, CASE WHEN k % 4 > 0 THEN value / 3.0::DOUBLE END AS marginal FROM s WHERE model = 'purchase'),
de AS (SELECT pc.account, key, start, mi."at", percent, round(cumulative, 4) AS cumulative, round(marginal, 4) AS marginal FROM mi JOIN pc ON pc.account = mi.account AND mi."at" >= piece AND mi."at" < piece_end)"""


def _cycles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, milestones, blocks): weeks of nine accounts, whose ends reach into the next week, cut at some errors; purchases as milestones; five-hour blocks of entries."""
    u = usage(spark, sf_dir).withColumn("x", F.unix_seconds("ts")).withColumn("account", F.col("session_id") % 9)
    week = F.floor(F.col("x") / 604_800)
    key = F.concat(F.lit("w"), week).alias("key")
    retained = u.select("account", key, (week * 604_800 + F.col("session_id") % 4 * 40_000).alias("start"), (week * 604_800 + 604_800 + F.col("k") * 2500).alias("end"))
    resets = u.where("model = 'error' and entry_id % 7 = 0").select("account", key, F.col("x").alias("at"))
    milestones = u.where("model = 'purchase'").select("account", F.col("x").alias("at"), F.col("k").cast("int").alias("percent"), F.col("value").alias("cumulative"), F.when(F.col("k") % 4 > 0, F.col("value") / 3.0).alias("marginal"))
    blocks = u.select("account", (F.floor(F.col("x") / 18_000) * 18_000).alias("start")).distinct().withColumn("end", F.col("start") + 18_000)
    return history.physical_cycles(history.logical_cycles(retained, resets)), milestones, blocks


@query(f"WITH {_CYCLES} SELECT * FROM pc")
def physical_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycles(spark, sf_dir)[0]


@query(f"WITH {_CYCLES} SELECT * FROM de")
def cycle_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones in the cycle that counts at their instant."""
    pieces, milestones, _ = _cycles(spark, sf_dir)
    return history.cycle_detail(pieces, milestones)


@query(f"""WITH {_CYCLES}, bl AS (SELECT DISTINCT session_id % 9 AS account, x // 18000 * 18000 AS b0, x // 18000 * 18000 + 18000 AS b1 FROM s), m AS (SELECT account, key, start, count(*) AS n, max("at") AS latest FROM de GROUP BY ALL),
b AS (SELECT pc.account, key, start, count(DISTINCT b0) AS n FROM pc JOIN bl ON bl.account = pc.account AND b0 < piece_end AND b1 > piece GROUP BY ALL),
f AS (SELECT c.account, c.key, c.start, c."end", coalesce(m.n, 0) AS milestones, coalesce(b.n, 0) AS blocks, latest, row_number() OVER (PARTITION BY c.account ORDER BY c.start DESC, c."end" DESC, c.key DESC) AS place
  FROM (SELECT DISTINCT account, key, start, "end" FROM pc) c LEFT JOIN m USING (account, key, start) LEFT JOIN b USING (account, key, start))
SELECT account, key, start, "end", milestones, blocks, place = 1 AS is_current, place, md5(concat_ws('|', account, key, start, milestones, blocks, coalesce(latest::VARCHAR, '-'))) AS stamp FROM f""")
def cycle_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles, newest first, with what their details hold."""
    pieces, milestones, blocks = _cycles(spark, sf_dir)
    return history.cycle_index(pieces, history.cycle_detail(pieces, milestones), blocks)


_SEGMENTS = f"""{USAGE_SQL}, x AS (SELECT session_id % 9 AS account, entry_id, epoch_us(ts) AS "at", model, k, input_tokens AS nano FROM u), rs AS (SELECT account, "at", min(entry_id) AS reset_id FROM x WHERE model = 'error' AND k % 5 = 0 GROUP BY ALL),
t AS (SELECT m.account, m.entry_id AS id, m."at", coalesce((SELECT max(r."at") FROM rs r WHERE r.account = m.account AND r."at" <= m."at"), -1) AS since FROM x m WHERE m.model = 'purchase'),
g AS (SELECT t.*, coalesce(rs.reset_id, 0) AS ref, (SELECT sum(c.nano) FROM x c WHERE c.account = t.account AND c.model <> 'error' AND c."at" >= since AND c."at" <= t."at")::BIGINT AS cost FROM t LEFT JOIN rs ON rs.account = t.account AND rs."at" = since)"""


@query(f"""WITH {_SEGMENTS}, p AS (SELECT *, CASE WHEN id % 17 = 3 THEN cost + 1 ELSE cost END AS nano, CASE WHEN id % 19 = 4 THEN 0 WHEN id % 23 = 5 THEN 999999999 ELSE ref END AS stated FROM g)
SELECT id, 'cost' AS kind FROM p WHERE id % 17 = 3 UNION ALL SELECT id, 'segment' FROM p WHERE id % 19 = 4 AND ref <> 0 UNION ALL SELECT id, 'unknown_reset' FROM p WHERE id % 19 <> 4 AND id % 23 = 5""")
def milestone_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones whose stored cost or segment is not that of a recomputation; some are made wrong here, and no other is found."""
    u = usage(spark, sf_dir).select((F.col("session_id") % 9).alias("account"), "entry_id", F.unix_micros("ts").alias("at"), "model", "k", F.col("input_tokens").alias("nano"))
    resets = u.where("model = 'error' and k % 5 = 0").groupBy("account", "at").agg(F.min("entry_id").alias("reset_id"))
    costs = u.where("model <> 'error'")
    # what was stored: one ordered pass an account
    both = costs.select("account", "at", F.lit(1).alias("k"), "entry_id", "model", "nano", F.lit(None).cast("long").alias("reset_id")).unionByName(resets.select("account", "at", F.lit(0).alias("k"), F.lit(0).cast("long").alias("entry_id"), F.lit("reset").alias("model"), F.lit(0).cast("long").alias("nano"), "reset_id"))
    known = both.withColumn("ref", F.coalesce(F.last("reset_id", True).over(Window.partitionBy("account").orderBy("at", "k", "entry_id").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    told = known.withColumn("sum", F.sum("nano").over(Window.partitionBy("account", "ref").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("model = 'purchase'")
    i = F.col("entry_id")
    stored = told.select("account", i.alias("id"), "at", F.when(i % 17 == 3, F.col("sum") + 1).otherwise(F.col("sum")).alias("nano"), F.when(i % 19 == 4, 0).when(i % 23 == 5, 999_999_999).otherwise(F.col("ref")).cast("long").alias("reset_id"))
    return history.milestone_violations(stored, resets, costs)


@query(f"""WITH {USAGE_SQL}, n AS (SELECT entry_id, CASE WHEN entry_id % 10 = 0 THEN session_id + 1 WHEN entry_id % 10 = 3 THEN NULL ELSE session_id END AS session_id, CASE WHEN entry_id % 10 = 2 THEN value + 1 ELSE value END AS value FROM u WHERE entry_id % 10 <> 1)
SELECT session_id, count(*) AS n, median(value) AS middle FROM n GROUP BY 1""")
def refreshed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by session after rows moved, changed and went: only groups of their old and new images are computed anew."""
    rows = usage(spark, sf_dir).select("entry_id", "session_id", "value")
    compute = lambda df: df.groupBy("session_id").agg(F.count("*").alias("n"), F.median("value").alias("middle"))
    k = F.col("entry_id") % 10
    image = F.struct(*rows.columns)
    moved = F.struct("entry_id", F.when(k == 0, F.col("session_id") + 1).when(k == 3, F.lit(None)).otherwise(F.col("session_id")).alias("session_id"), F.when(k == 2, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    feed = rows.where(k <= 3).select(image.alias("before"), F.when(k != 1, moved).alias("after"))
    return refresh_groups(compute(rows), apply_feed(rows, feed, "entry_id"), feed, ["session_id"], compute)


@query()
def pending_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on readings of nine accounts: each event is a reading of its session and a tick; purchases tell what is published, errors set and lift tombstones. A fold over traces, which
    SQL has no whole expression for; a plain state machine is its test."""
    u = usage(spark, sf_dir).select((F.col("session_id") % 9).alias("axis"), "entry_id", F.unix_seconds("ts").alias("at"), "model", "k", F.concat(F.lit("s"), F.col("session_id") % 4).alias("token"))
    none, i = (lambda t: F.lit(None).cast(t)), F.col("entry_id")
    window = F.floor(F.col("at") / 604_800)
    percent = (F.col("k") % 6 * 10).cast("double")

    def rows(df: DataFrame, kind: str, last: int, **values: object) -> DataFrame:
        names = {"token": "string", "received_at": "long", "percent": "double", "window_key": "long", "raw": "long", "generation": "long", "state": "string", "through": "long"}
        return df.select("axis", (i * 4 + last).alias("seq"), "at", F.lit(kind).alias("kind"), *[values.get(n, none(t)).cast(t).alias(n) for n, t in names.items()])

    readings = rows(u, "reading", 0, token=F.col("token"), received_at=F.col("at"), percent=percent, window_key=window, raw=window * 10 + F.col("k") % 3)
    published = rows(u.where("model = 'purchase'"), "published", 1, percent=percent, window_key=window, raw=window * 10, generation=i % 3)
    stones = rows(u.where("model = 'error'"), "tombstone", 2, state=F.when(F.col("k") % 3 == 0, "inflight").when(F.col("k") % 3 == 1, "committed").otherwise("none"), through=F.col("at") - 20)
    return decisions(readings.unionByName(published).unionByName(stones).unionByName(rows(u, "tick", 3)))
