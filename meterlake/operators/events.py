"""Deduplication, effective events and idempotent sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in an order; rows with a null key all stay. A hot key is cut to one row per task before the shuffle."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(*order)
    best = rows.where(whole).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return best.unionByName(rows.where(~whole))


def dedup_usage(entries: DataFrame, keys: list[str], sticky: str | None = None) -> DataFrame:
    """One entry per key: the most tokens, then the one with a speed, then the first. ``sticky`` names a column that stays that of the
    key's first entry."""
    if sticky:
        w = Window.partitionBy(*keys).orderBy("entry_id")
        known = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
        entries = entries.withColumn(sticky, F.when(known == 1, F.col(sticky)).otherwise(F.first(sticky).over(w)))
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create_tokens") + F.col("cache_read_tokens")
    return best_per_key(entries, keys, [total.desc(), F.col("speed").isNotNull().desc(), F.col("entry_id").asc()])


def cumulative_advances(rows: DataFrame, by: list[str], order: str, cumulative: str) -> DataFrame:
    """Rows whose cumulative count exceeds every one before it in its key; rows without one always stay."""
    before = F.max(cumulative).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col(cumulative).isNull() | (F.col(cumulative) > F.col("_b"))).drop("_b")


def effective_events(records: DataFrame) -> DataFrame:
    """``records`` (id, rev, seq, status, digest): per id the highest revision, of several the first; ``conflict`` if the records of
    that revision differ; only active ones."""
    top = records.groupBy("id").agg(F.max("rev").alias("rev"))
    at = records.join(top, ["id", "rev"])
    won = at.groupBy("id", "rev").agg(F.min_by(F.struct("status", "digest"), "seq").alias("w"), F.min("seq").alias("seq"), (F.min("digest") != F.max("digest")).alias("conflict"))
    return won.where(F.col("w.status") == "active").select("id", "rev", "seq", F.col("w.digest").alias("digest"), "conflict")


def merge_effective(state: DataFrame, records: DataFrame) -> DataFrame:
    """The state of ``effective_state`` with further records taken in: an id's row is set against the new records of its revision or
    higher ones, so that old records are never read again."""
    s = state.select("id", "rev", "seq", "status", F.array("digest_lo", "digest_hi").alias("d"), "digest")
    r = records.select("id", "rev", "seq", "status", F.array("digest").alias("d"), "digest")
    return _state(s.unionByName(r))


def effective_state(records: DataFrame) -> DataFrame:
    """(id, rev, seq, status, digest, digest_lo, digest_hi): what has to be kept of records (id, rev, seq, status, digest) so that others can
    be merged in later; inactive ids stay, as a later record must not revive an older revision."""
    return _state(records.select("id", "rev", "seq", "status", F.array("digest").alias("d"), "digest"))


def _state(rows: DataFrame) -> DataFrame:
    top = rows.groupBy("id").agg(F.max("rev").alias("rev"))
    at = rows.join(top, ["id", "rev"])
    won = at.groupBy("id", "rev").agg(F.min_by(F.struct("status", "digest"), "seq").alias("w"), F.min("seq").alias("seq"), F.min(F.array_min("d")).alias("digest_lo"), F.max(F.array_max("d")).alias("digest_hi"))
    return won.select("id", "rev", "seq", "w.status", "w.digest", "digest_lo", "digest_hi")


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with those rows added whose key it lacks; run again, it adds nothing."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys))


def rederivation_plan(desired: DataFrame, effective: DataFrame) -> DataFrame:
    """(id, action): insert, update or tombstone, by comparing digests; equal ones need nothing."""
    d, e = desired.select("id", F.col("digest").alias("want")), effective.select("id", F.col("digest").alias("have"))
    action = F.when(F.col("have").isNull(), "insert").when(F.col("want").isNull(), "tombstone").when(F.col("want") != F.col("have"), "update")
    return d.join(e, "id", "full_outer").select("id", action.alias("action")).where("action is not null")


def dedup_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("violations"))


def prunable(rows: DataFrame, key: str, ts: str, cutoff: Column, path: str | None = None) -> DataFrame:
    """Groups whose latest row is before the cutoff; with ``path``, rows without a key are grouped by that."""
    if path:
        rows = rows.withColumn(key, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("path:"), F.col(path))))
    return rows.groupBy(key).agg(F.max(ts).alias("last_ts")).where(F.col("last_ts") < cutoff)


#: Columns of records that belong to batches: ``kind`` begin, commit or action; ``n`` numbers a batch's actions from 0 (markers have -1); ``manifest`` and
#: ``count`` stand on markers: the digests of all actions, as ``manifest_of`` makes them, and how many there are.
BATCH_RECORD = ["batch", "kind", "n", "seq", "id", "rev", "status", "digest", "manifest", "count"]


def manifest_of(digests: Column) -> Column:
    """The digest of a batch's actions: of their digests in order."""
    return F.sha2(F.array_join(digests, "\n"), 256)


def batch_state(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """What has to be kept of batch records (``BATCH_RECORD``): the first of each marker and each numbered action, and the least and largest digest of
    all that claim its place. With ``state``, further records are taken in without a look at old ones."""
    rows = records.select(*BATCH_RECORD, F.col("digest").alias("lo"), F.col("digest").alias("hi"))
    if state is not None:
        rows = rows.unionByName(state.select(rows.columns))
    key = ["batch", "kind", "n"]
    rest = [c for c in BATCH_RECORD if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("seq", "digest")).alias("r"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return first.select(*key, "r.*", "lo", "hi")


def batch_verdicts(state: DataFrame) -> DataFrame:
    """(batch, verdict, violations) of a ``batch_state``: completed, open if a marker is still missing, or tainted, with the kinds of violation by name.

    A batch is tainted by two different records in one place, by a commit without a begin, by markers that differ, by numbers of actions other
    than those announced, by records out of order, and by actions that are not those of the manifest. The digests of one batch meet in one row."""
    w = Window.partitionBy("batch").orderBy("n")
    rows = state.withColumn("_late", (F.col("kind") == "action") & (F.lag(F.when(F.col("kind") == "action", F.col("seq"))).over(w) >= F.col("seq")))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    action = F.col("kind") == "action"
    g = rows.groupBy("batch").agg(
        of("begin", "seq").alias("b"), of("commit", "seq").alias("c"), of("begin", "manifest").alias("bm"), of("commit", "manifest").alias("cm"), of("begin", "count").alias("bc"), of("commit", "count").alias("cc"),
        F.bool_or((F.col("lo") != F.col("hi")) & ~action).alias("m_conflict"), F.bool_or((F.col("lo") != F.col("hi")) & action).alias("a_conflict"), F.count(F.when(action, 1)).alias("actions"),
        F.min(F.when(action, F.col("n"))).alias("first_n"), F.max(F.when(action, F.col("n"))).alias("last_n"), F.min(F.when(action, F.col("seq"))).alias("first_seq"), F.max(F.when(action, F.col("seq"))).alias("last_seq"), F.bool_or("_late").alias("late"),
        F.array_sort(F.collect_list(F.when(action, F.struct("n", "digest")))).alias("d"))
    both = F.col("b").isNotNull() & F.col("c").isNotNull()
    numbered = (F.col("actions") == F.col("bc")) & ((F.col("bc") == 0) | (F.col("first_n") == 0) & (F.col("last_n") == F.col("bc") - 1))
    disorder = (F.col("b") >= F.col("c")) | numbered & (F.coalesce("late", F.lit(False)) | F.coalesce((F.col("first_seq") <= F.col("b")) | (F.col("last_seq") >= F.col("c")), F.lit(False)))
    kinds = [
        ("action_sequence_conflict", F.col("a_conflict")), ("commit_without_begin", F.col("c").isNotNull() & F.col("b").isNull()), ("manifest_action_sequence_mismatch", both & ~numbered),
        ("manifest_actions_hash_mismatch", both & numbered & (manifest_of(F.transform("d", lambda x: x.digest)) != F.col("bm"))), ("marker_conflict", F.col("m_conflict")),
        ("marker_manifest_mismatch", both & ((F.col("bm") != F.col("cm")) | (F.col("bc") != F.col("cc")))), ("record_order_violation", both & disorder)]
    violations = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in kinds]))
    verdict = F.when(F.size("violations") > 0, "tainted").when(both, "completed").otherwise("open")
    return g.withColumn("violations", violations).select("batch", verdict.alias("verdict"), F.array_join("violations", ",").alias("violations"))


def loose_state(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """What has to be kept of records outside batches (id, rev, seq, status, digest): a row an id and revision, as a batch that is withdrawn may revive any."""
    rows = records.select("id", "rev", "seq", "status", "digest", F.col("digest").alias("lo"), F.col("digest").alias("hi"))
    if state is not None:
        rows = rows.unionByName(state.select(rows.columns))
    g = rows.groupBy("id", "rev").agg(F.min_by(F.struct("seq", "status", "digest"), "seq").alias("r"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.select("id", "rev", "r.*", "lo", "hi")


def effective_with_batches(loose: DataFrame, batches: DataFrame) -> DataFrame:
    """``effective_events`` of a ``loose_state`` and a ``batch_state``: the actions of completed batches count, all together, and those of an open or tainted
    batch don't, whatever they had superseded before."""
    done = batch_verdicts(batches).where("verdict = 'completed'").select("batch")
    taken = batches.where("kind = 'action'").join(done, "batch", "left_semi")
    rows = loose.select("id", "rev", "seq", "status", "digest", "lo", "hi").unionByName(taken.select("id", "rev", "seq", "status", "digest", "lo", "hi"))
    top = rows.groupBy("id").agg(F.max("rev").alias("rev"))
    won = rows.join(top, ["id", "rev"]).groupBy("id", "rev").agg(F.min_by(F.struct("status", "digest"), "seq").alias("w"), F.min("seq").alias("seq"), (F.min("lo") != F.max("hi")).alias("conflict"))
    return won.where(F.col("w.status") == "active").select("id", "rev", "seq", F.col("w.digest").alias("digest"), "conflict")
