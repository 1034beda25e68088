"""Correction batches in the journal of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events
from ..operators.ranks import checkpointed
from .registry import USAGE_SQL, query, usage


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as journal records: errors stand outside batches; of a session's other entries of a day the first begins a batch, the last commits it and those between are
    its actions. Some batches lack their commit, announce another count or manifest, or hold a second, different record in a place."""
    u = usage(spark, sf_dir)
    digest = F.concat("model", F.coalesce("speed", F.lit("")), F.lit("-"), "k")
    loose = u.where("model = 'error'").select((F.col("session_id") % 40).alias("id"), (F.col("entry_id") % 3).alias("rev"), F.col("entry_id").alias("seq"), F.lit("active").alias("status"), digest.alias("digest"))
    b = F.col("session_id") * 1000 + F.dayofyear("ts")
    w = Window.partitionBy("batch").orderBy("seq")
    rows = u.where("model <> 'error'").select(b.alias("batch"), F.col("entry_id").alias("seq"), (F.col("session_id") % 40).alias("id"), (F.col("k") % 7).alias("rev"), F.when(F.col("k") % 9 == 0, "tombstone").otherwise("active").alias("status"), digest.alias("digest"))
    rows = rows.withColumn("r", F.row_number().over(w)).withColumn("last", F.count("*").over(Window.partitionBy("batch")))
    kind = F.when(F.col("r") == 1, "begin").when(F.col("r") == F.col("last"), "commit").otherwise("action")
    rows = rows.withColumn("kind", kind).where("last > 1").withColumn("n", F.when(F.col("kind") == "action", F.col("r") - 2).otherwise(-1))
    marks = rows.groupBy("batch").agg(events.manifest_of(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "action", F.struct("n", "digest")))), lambda x: x.digest)).alias("m"), (F.max("last") - 2).alias("c"))
    rows = rows.join(marks, "batch")
    marker = F.col("kind") != "action"
    manifest = F.when(marker, F.when((F.col("batch") % 17 == 2), F.concat("m", F.lit("x"))).otherwise(F.col("m")))
    count = F.when(marker, F.when(F.col("batch") % 11 == 5, F.col("c") + 1).when((F.col("batch") % 19 == 3) & (F.col("kind") == "commit"), F.col("c") + 2).otherwise(F.col("c"))).cast("long")
    rows = rows.select("batch", "kind", "n", F.when((F.col("batch") % 23 == 4) & (F.col("n") == 0), F.col("seq") + 1_000_000).otherwise(F.col("seq")).alias("seq"), "id", F.col("rev").cast("long").alias("rev"), "status", F.when(marker, "mark").otherwise(F.col("digest")).alias("digest"), manifest.alias("manifest"), count.alias("count"))
    rows = rows.where("not (kind = 'commit' and batch % 7 = 3) and not (kind = 'begin' and batch % 29 = 6)")
    again = rows.where("kind = 'action' and n = 1 and batch % 13 = 1").withColumn("digest", F.concat("digest", F.lit("'"))).withColumn("seq", F.col("seq") + 2_000_000)
    return loose, rows.unionByName(again)


_BATCH_SQL = f"""{USAGE_SQL}, loose AS (SELECT session_id % 40 AS id, entry_id % 3 AS rev, entry_id AS seq, 'active' AS status, model || coalesce(speed, '') || '-' || k AS digest FROM u WHERE model = 'error'),
r0 AS (SELECT session_id * 1000 + dayofyear(ts) AS batch, entry_id AS seq, session_id % 40 AS id, k % 7 AS rev, CASE WHEN k % 9 = 0 THEN 'tombstone' ELSE 'active' END AS status, model || coalesce(speed, '') || '-' || k AS digest FROM u WHERE model <> 'error'),
r1 AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY seq) AS r, count(*) OVER (PARTITION BY batch) AS last FROM r0),
r2 AS (SELECT *, CASE WHEN r = 1 THEN 'begin' WHEN r = last THEN 'commit' ELSE 'action' END AS kind, CASE WHEN r = 1 OR r = last THEN -1 ELSE r - 2 END AS n FROM r1 WHERE last > 1),
m AS (SELECT batch, sha256(coalesce(string_agg(digest, chr(10) ORDER BY n) FILTER (WHERE kind = 'action'), '')) AS m, max(last) - 2 AS c FROM r2 GROUP BY 1),
r3 AS (SELECT batch, kind, n, CASE WHEN batch % 23 = 4 AND n = 0 THEN seq + 1000000 ELSE seq END AS seq, id, rev, status, CASE WHEN kind = 'action' THEN digest ELSE 'mark' END AS digest,
  CASE WHEN kind <> 'action' THEN CASE WHEN batch % 17 = 2 THEN m || 'x' ELSE m END END AS manifest, CASE WHEN kind <> 'action' THEN CASE WHEN batch % 11 = 5 THEN c + 1 WHEN batch % 19 = 3 AND kind = 'commit' THEN c + 2 ELSE c END END AS count
  FROM r2 JOIN m USING (batch) WHERE NOT (kind = 'commit' AND batch % 7 = 3) AND NOT (kind = 'begin' AND batch % 29 = 6)),
rec AS (SELECT * FROM r3 UNION ALL SELECT batch, kind, n, seq + 2000000, id, rev, status, digest || '''', manifest, count FROM r3 WHERE kind = 'action' AND n = 1 AND batch % 13 = 1),
f AS (SELECT *, min(digest) OVER p <> max(digest) OVER p AS clash, row_number() OVER (PARTITION BY batch, kind, n ORDER BY seq, digest) AS rn FROM rec WINDOW p AS (PARTITION BY batch, kind, n)),
a AS (SELECT *, lag(seq) OVER (PARTITION BY batch ORDER BY n) >= seq AS late FROM f WHERE rn = 1 AND kind = 'action'),
ag AS (SELECT batch, count(*) AS actions, min(n) AS n0, max(n) AS n1, min(seq) AS s0, max(seq) AS s1, bool_or(coalesce(late, false)) AS late, bool_or(clash) AS clash, sha256(string_agg(digest, chr(10) ORDER BY n)) AS got FROM a GROUP BY 1),
mk AS (SELECT batch, max(seq) FILTER (WHERE kind = 'begin') AS b, max(seq) FILTER (WHERE kind = 'commit') AS c, max(manifest) FILTER (WHERE kind = 'begin') AS bm, max(manifest) FILTER (WHERE kind = 'commit') AS cm, max(count) FILTER (WHERE kind = 'begin') AS bc, max(count) FILTER (WHERE kind = 'commit') AS cc FROM f WHERE rn = 1 AND kind <> 'action' GROUP BY 1),
v0 AS (SELECT coalesce(mk.batch, ag.batch) AS batch, b, c, bm, cm, bc, cc, coalesce(actions, 0) AS actions, n0, n1, s0, s1, coalesce(late, false) AS late, coalesce(clash, false) AS clash, coalesce(got, sha256('')) AS got, b IS NOT NULL AND c IS NOT NULL AS whole FROM mk FULL JOIN ag ON mk.batch = ag.batch),
v1 AS (SELECT *, coalesce(actions = bc AND (bc = 0 OR n0 = 0 AND n1 = bc - 1), false) AS numbered FROM v0),
v2 AS (SELECT batch, whole, list_filter([CASE WHEN clash THEN 'action_sequence_conflict' END, CASE WHEN c IS NOT NULL AND b IS NULL THEN 'commit_without_begin' END, CASE WHEN whole AND NOT numbered THEN 'manifest_action_sequence_mismatch' END,
  CASE WHEN whole AND numbered AND got <> bm THEN 'manifest_actions_hash_mismatch' END, CASE WHEN whole AND (bm <> cm OR bc <> cc) THEN 'marker_manifest_mismatch' END, CASE WHEN whole AND (b >= c OR numbered AND (late OR coalesce(s0 <= b OR s1 >= c, false))) THEN 'record_order_violation' END], lambda x: x IS NOT NULL) AS vs FROM v1),
verdicts AS (SELECT batch, CASE WHEN len(vs) > 0 THEN 'tainted' WHEN whole THEN 'completed' ELSE 'open' END AS verdict, array_to_string(vs, ',') AS violations FROM v2)"""


@query(f"WITH {_BATCH_SQL} SELECT * FROM verdicts")
def batch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.batch_verdicts(events.batch_state(_records(spark, sf_dir)[1]))


@query(f"""WITH {_BATCH_SQL}, c AS (SELECT id, rev, seq, status, digest, digest AS lo FROM loose UNION ALL SELECT id, rev, seq, status, digest, digest FROM f WHERE rn = 1 AND kind = 'action' AND batch IN (SELECT batch FROM verdicts WHERE verdict = 'completed')),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rev DESC, seq) AS n, min(digest) OVER (PARTITION BY id, rev) <> max(digest) OVER (PARTITION BY id, rev) AS conflict FROM c)
SELECT id, rev, seq, digest, conflict FROM w WHERE n = 1 AND status = 'active'""")
def batched_effective_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective events where batches count as a whole or not at all, read in three increments."""
    loose, rows = (checkpointed(r) for r in _records(spark, sf_dir))  # read by each increment
    a = b = None
    for n in range(3):
        a, b = events.loose_state(loose.where(f"seq % 3 = {n}"), a), events.batch_state(rows.where(f"seq % 3 = {n}"), b)
    return events.effective_with_batches(a, b)
