"""Who a quota window, an entry or a call belongs to: votes, assertions, unambiguous joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adopt_spend(entries: DataFrame, windows: DataFrame, unit_seconds: int) -> DataFrame:
    """(entry_id, account) for entries (entry_id, root, ts) that no account owns: the one account that all windows (root, start, end,
    account) over the entry's time name; none or several leave it alone, and a window without an account says nothing. Times
    are epoch seconds. Overlapping windows of one account are one before entries meet them in units of time, so an entry meets
    a few stretches per account, however many windows there are."""
    by = Window.partitionBy("root", "account").orderBy("start")
    w = windows.where("account is not null and start < end").groupBy("root", "account", "start").agg(F.max("end").alias("end"))
    open_until = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("_new", F.coalesce((F.col("start") > open_until).cast("int"), F.lit(1))).withColumn("_n", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    w = w.groupBy("root", "account", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    w = w.withColumn("_u", F.explode(F.sequence(F.floor(F.col("start") / unit_seconds), F.floor(F.col("end") / unit_seconds))))
    e = entries.withColumn("_u", F.floor(F.col("ts") / unit_seconds))
    met = e.join(w, ["root", "_u"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    g = met.groupBy("entry_id").agg(F.min("account").alias("account"), F.max("account").alias("_hi"))
    return g.where(F.col("account") == F.col("_hi")).select("entry_id", "account")


def block_spend(entries: DataFrame, blocks: DataFrame, as_of: int, unit_seconds: int) -> DataFrame:
    """Entries (root, ts, ...) with the quota block (root, start, reset) that they fall in: from its start until its reset or ``as_of``,
    whichever is first. Times are epoch seconds; both meet in units of time of their root."""
    last = F.least(F.col("reset"), F.lit(as_of))
    b = blocks.where(F.col("start") < last).withColumn("_until", last).withColumn("_u", F.explode(F.sequence(F.floor(F.col("start") / unit_seconds), F.floor(F.col("_until") / unit_seconds))))
    e = entries.withColumn("_u", F.floor(F.col("ts") / unit_seconds))
    return e.join(b, ["root", "_u"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("_until"))).drop("_u", "_until")


def resolve_assertions(assertions: DataFrame, groups: DataFrame) -> DataFrame:
    """``assertions`` (op_id, axes, resets, account), ``groups`` (group_id, axes, resets, in_scope, native), resets being arrays ->
    (op_id, account, outcome, group_id). An assertion matches the groups of its axes with which it shares a reset: none is dormant,
    several split; then out of scope is model_scoped, a group that names an account itself native, a group claimed for two accounts
    conflict; else resolved."""
    a = assertions.select("op_id", "axes", "account", F.explode("resets").alias("reset"))
    g = groups.select("group_id", "axes", "in_scope", "native", F.explode("resets").alias("reset"))
    # groups are summed up per reset first, so that an assertion meets one row for each reset of its own
    parts = lambda hi: [F.min("group_id").alias("group_id"), F.max(hi).alias("_hi"), F.bool_and("in_scope").alias("in_scope"), F.max("native").alias("native")]
    hit = a.join(g.groupBy("axes", "reset").agg(*parts("group_id")), ["axes", "reset"]).groupBy("op_id").agg(*parts("_hi"))
    j = assertions.select("op_id", "account").join(hit, "op_id", "left")
    one = F.col("group_id") == F.col("_hi")
    outcome = (F.when(F.col("group_id").isNull(), "dormant").when(~one, "split").when(~F.col("in_scope"), "model_scoped").when(F.col("native").isNotNull(), "native").otherwise("resolved"))
    j = j.withColumn("outcome", outcome).withColumn("group_id", F.when(F.col("outcome").isin("dormant", "split"), None).otherwise(F.col("group_id")))
    claims = j.where("outcome = 'resolved'").groupBy("group_id").agg((F.min("account") != F.max("account")).alias("_clash"))
    j = j.join(claims, "group_id", "left")
    return j.select("op_id", "account", F.when((F.col("outcome") == "resolved") & F.col("_clash"), "conflict").otherwise(F.col("outcome")).alias("outcome"), "group_id")


def unambiguous(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs whose key occurs once on either side."""
    once = lambda df: df.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return left.join(once(left), key).join(right.join(once(right), key), key)


def fold_owners(rows: DataFrame, by: list[str], call: str, position: str) -> DataFrame:
    """(*by, call, owner, results): the first row of each call owns the later ones."""
    return rows.where(F.col(call).isNotNull()).groupBy(*by, call).agg(F.min(position).alias("owner"), (F.count("*") - 1).alias("results"))


def collision_safe_labels(identities: DataFrame) -> DataFrame:
    """(identity, label) -> with ``shown``: the first identity of a label keeps it, others get a number; one that would spell a literal
    label moves on by as many numbers as its label has literal look-alikes."""
    n = F.row_number().over(Window.partitionBy("label").orderBy("identity"))
    taken = identities.select(F.regexp_extract("label", r"^(.*) \((\d+)\)$", 1).alias("label")).where("label <> ''").groupBy("label").agg(F.count("*").alias("_skip"))
    j = identities.withColumn("_n", n).join(taken, "label", "left")
    return j.select("identity", "label", F.when(F.col("_n") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ("), (F.col("_n") + F.coalesce("_skip", F.lit(0))).cast("string"), F.lit(")"))).alias("shown"))
