"""Evaluations of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import evaluations
from .registry import USAGE_SQL, query, usage


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of sessions' alerts: errors close the gate and signups open it, purchases set a rule, all others are observations, two in five
    of them captured some hours ahead."""
    u = usage(spark, sf_dir)
    kind = F.when(F.col("model").isin("error", "signup"), "gate").when(F.col("model") == "purchase", "rule").otherwise("observation")
    value = F.when(F.col("model") == "error", "closed").when(F.col("model") == "signup", "open").when(F.col("model") == "purchase", F.concat((F.col("k") % 3 * 20 + 10), F.lit(","), (F.col("k") % 3 * 20 + 50)))
    capture = F.when(kind == "observation", F.timestamp_micros(F.unix_micros("ts") + (F.col("k") % 5 - 2) * 21_600_000_000))
    return u.select(F.col("session_id").alias("root"), F.col("ts").alias("at"), F.col("entry_id").alias("seq"), kind.alias("kind"), value.alias("value"), F.when(kind == "observation", F.col("k").cast("double")).alias("percent"), capture.alias("capture_at"))


CHANGES_SQL = f"""{USAGE_SQL}, ch AS (SELECT session_id AS root, epoch_us(ts) AS t, entry_id AS seq, CASE WHEN model IN ('error', 'signup') THEN 'gate' WHEN model = 'purchase' THEN 'rule' ELSE 'observation' END AS kind,
  CASE model WHEN 'error' THEN 'closed' WHEN 'signup' THEN 'open' WHEN 'purchase' THEN (k % 3 * 20 + 10) || ',' || (k % 3 * 20 + 50) END AS value, k::DOUBLE AS percent, epoch_us(ts) + (k % 5 - 2) * 21600000000 AS capture FROM u)"""


@query(f"""WITH {CHANGES_SQL}, o AS (SELECT * FROM ch WHERE kind = 'observation'),
line AS (SELECT root, t, 0 AS late, seq, kind, value FROM ch UNION ALL SELECT DISTINCT root, capture, 1, 0, 'boundary', NULL FROM o WHERE capture > t AND capture <= epoch_us(TIMESTAMP '2024-01-25 00:00:00')),
g AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'gate' THEN value END IGNORE NULLS) OVER w, 'closed') AS gate, coalesce(last_value(CASE WHEN kind = 'gate' THEN value END IGNORE NULLS) OVER e, 'closed') AS gate_before,
  last_value(CASE WHEN kind = 'rule' THEN value END IGNORE NULLS) OVER w AS rule, last_value(CASE WHEN kind = 'rule' THEN value END IGNORE NULLS) OVER e AS rule_before FROM line WHERE t <= epoch_us(TIMESTAMP '2024-01-25 00:00:00')
  WINDOW w AS (PARTITION BY root ORDER BY t, late, seq ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY root ORDER BY t, late, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN kind = 'gate' AND gate = 'open' AND gate_before <> 'open' THEN 'gate_enabled' WHEN kind = 'gate' AND gate <> 'open' AND gate_before = 'open' THEN 'gate_disabled'
  WHEN kind = 'rule' AND gate = 'open' AND rule IS DISTINCT FROM rule_before THEN 'rule_changed' WHEN kind = 'observation' AND gate = 'open' THEN 'window_dirty' WHEN kind = 'boundary' AND gate = 'open' THEN 'scheduled' END AS reason FROM g),
p AS (SELECT r.*, (SELECT arg_max(percent, (capture, o.t, o.seq)) FROM o WHERE o.root = r.root AND (o.t < r.t OR o.t = r.t AND (r.late = 1 OR o.seq <= r.seq)) AND (o.capture <= o.t OR o.capture < r.t OR o.capture = r.t AND r.late = 1)) AS percent FROM r WHERE reason IS NOT NULL)
SELECT root, t AS at_us, reason, CASE WHEN reason <> 'gate_disabled' THEN percent END AS percent, CASE WHEN reason <> 'gate_disabled' THEN coalesce(len(list_filter(string_split(rule, ','), lambda x: x::DOUBLE <= percent)), 0)::INTEGER END AS crossed FROM p""")
def alert_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluations(changes(spark, sf_dir), F.expr("timestamp'2024-01-25 00:00:00'"))
    return e.select("root", F.unix_micros("at").alias("at_us"), "reason", "percent", "crossed")
