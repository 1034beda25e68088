"""Further log formats: cumulative accounting, quota observations, messages, titles, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_document, strip_sent, wrapper_kind

LIMIT = "struct<used_percent double, window_minutes int, resets_at bigint>"
ROLLOUT_LINE = (
    "timestamp string, type string, payload struct<type string, id string, model string, turn_id string, parent_thread_id string, "
    "info struct<last_token_usage struct<input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint, total_tokens bigint>, "
    f"total_token_usage struct<total_tokens bigint>, rate_limits map<string, {LIMIT}>>, rate_limits map<string, {LIMIT}>>"
)
JOURNAL_LINE = "v int, t string, id string, rev int, at string, src string, provider string, account string, payload string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, pos, value): lines with their position in the file. A file may be read in several splits, in any order, so a position
    is where the split begins and, in it, how many lines came before. Lines of a split are counted in the order in which they
    are read, which is that of the file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_at"), "value").withColumn("_n", F.monotonically_increasing_id())
    return raw.select("source_path", F.struct(F.col("_at").alias("at"), F.col("_n").alias("n")).alias("pos"), "value")


def line_offsets(lines: DataFrame) -> DataFrame:
    """Adds ``offset``, the byte at which each line of ``numbered_lines`` begins, for files whose lines end in one line feed. Bytes are
    summed up by split first, so a file of many splits is no single task."""
    size = F.octet_length("value") + 1
    inside = Window.partitionBy("source_path", "pos.at").orderBy("pos.n").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("source_path", F.col("pos.at").alias("_at")).agg(F.sum(size).alias("_b"))
    before = F.coalesce(F.sum("_b").over(Window.partitionBy("source_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("source_path", "_at", before.alias("_before"))
    return lines.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).withColumn("_at", F.col("pos.at")).join(splits, ["source_path", "_at"]).select("source_path", "pos", "value", (F.col("_before") + F.col("_in")).alias("offset"))


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, pos, j): parsed lines with their order within the file."""
    lines = numbered_lines(spark, path).select("source_path", "pos", F.from_json("value", ROLLOUT_LINE).alias("j"))
    return lines.where("j is not null")


def accounting(rollouts: DataFrame) -> DataFrame:
    """Token counts of rollout lines whose cumulative total advances; lines without a total always count. Session and model are the
    latest named before in the file; lines that a forked thread copied before it named a model are left out."""
    w = Window.partitionBy("source_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    meta = F.col("j.type") == "session_meta"
    r = rollouts.withColumn("session_id", F.last(F.when(meta, F.col("j.payload.id")), True).over(w))
    r = r.withColumn("parent", F.last(F.when(meta, F.col("j.payload.parent_thread_id")), True).over(w))
    r = r.withColumn("model", F.last(F.when(F.col("j.type") == "turn_context", F.col("j.payload.model")), True).over(w))
    use, total = F.col("j.payload.info.last_token_usage"), F.col("j.payload.info.total_token_usage.total_tokens")
    counts = r.where((F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count") & use.isNotNull() & ~(F.col("model").isNull() & F.col("parent").isNotNull()))
    before = F.max(total).over(Window.partitionBy("source_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    ok = counts.withColumn("_b", F.coalesce(before, F.lit(0))).where(total.isNull() | (total > F.col("_b")))
    n = lambda f: F.coalesce(use[f], F.lit(0)).alias(f)
    stem = F.regexp_extract("source_path", r"([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl$", 1)
    out = ok.select("source_path", "pos", F.try_to_timestamp("j.timestamp").alias("ts"), F.coalesce("session_id", F.when(stem != "", stem)).alias("session_id"), F.coalesce("model", F.lit("unknown")).alias("model"),
                    *[n(f) for f in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")])
    return out.where("ts is not null and session_id is not null")


META = (
    "timestamp string, type string, payload struct<type string, id string, session_id string, forked_from_id string, cwd string, git string, source string, thread_source string, "
    "model_provider string, context_window bigint, turn_id string, call_id string>")
# Fixed value: whose thread it is if nothing says.
THREAD_OF = "user"


def _said(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def thread_facts(lines: DataFrame) -> DataFrame:
    """(source_path, pos, thread_id, thread_source, parent_id, cwd, git, source_kind, provider, context_window) of the lines (source_path, pos, value) that begin a thread. The source is what is stated, or the only key of an
    object that names where the thread came from, else a person's; objects are canonical."""
    j = F.from_json("value", META)
    p = F.col("j.payload")
    keys = F.when(p.source.startswith("{"), F.json_object_keys(p.source))
    only = F.when(F.size(keys) == 1, _said(F.try_element_at(keys, F.lit(1))))
    stated = F.when(~p.thread_source.startswith("{"), _said(p.thread_source))
    rows = lines.withColumn("j", j).where("j.type = 'session_meta' and j.payload is not null")
    return rows.select(
        "source_path", "pos", F.coalesce(_said(p.session_id), _said(p.id)).alias("thread_id"), F.coalesce(stated, only, F.lit(THREAD_OF)).alias("thread_source"), _said(p.forked_from_id).alias("parent_id"), _said(p.cwd).alias("cwd"),
        F.when(p.git.startswith("{"), canonical_document(p.git)).alias("git"), F.when(~p.source.startswith("{"), _said(p.source)).alias("source_kind"), _said(p.model_provider).alias("provider"), F.when(p.context_window > 0, p.context_window).alias("context_window"))


def physical_events(lines: DataFrame) -> DataFrame:
    """(source_path, pos, ts, record_type, event_type, turn_id, call_id, thread_id, payload): a row for every line that is a JSON object, with its canonical payload and the thread that the file's latest
    beginning before it, or itself, names."""
    j = F.from_json("value", META)
    whole = F.try_parse_json("value")
    rows = lines.withColumn("j", j).withColumn("_p", F.to_json(F.try_variant_get(whole, "$.payload", "variant"))).where(F.ltrim("value").startswith("{") & whole.isNotNull())
    begun = F.when(F.col("j.type") == "session_meta", F.coalesce(_said(F.col("j.payload.session_id")), _said(F.col("j.payload.id"))))
    w = Window.partitionBy("source_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("source_path", "pos", F.try_to_timestamp("j.timestamp").alias("ts"), F.col("j.type").alias("record_type"), F.col("j.payload.type").alias("event_type"), F.col("j.payload.turn_id").alias("turn_id"), F.col("j.payload.call_id").alias("call_id"), F.last(begun, True).over(w).alias("thread_id"), F.col("_p").alias("payload"))


def quota_observations(rollouts: DataFrame) -> DataFrame:
    """(source_path, pos, ts, slot, used_percent, window_minutes, resets_at): one row per slot of a line's limits; each number is the
    direct one if it is valid, else the one in the line's info. Slots without a valid number of each kind are left out."""
    p = F.col("j.payload")
    slots = F.array_distinct(F.concat(F.coalesce(F.map_keys(p.rate_limits), F.array().cast("array<string>")), F.coalesce(F.map_keys(p.info.rate_limits), F.array().cast("array<string>"))))
    r = rollouts.select("source_path", "pos", F.try_to_timestamp("j.timestamp").alias("ts"), p.rate_limits.alias("a"), p.info.rate_limits.alias("b"), F.explode(slots).alias("slot"))

    def pick(field: str, good) -> Column:
        x, y = F.try_element_at("a", F.col("slot"))[field], F.try_element_at("b", F.col("slot"))[field]
        return F.coalesce(F.when(good(x), x), F.when(good(y), y))

    o = r.select("source_path", "pos", "ts", "slot", pick("used_percent", lambda c: c.between(0, 100)).alias("used_percent"), pick("window_minutes", lambda c: c > 0).alias("window_minutes"), pick("resets_at", lambda c: c > 0).alias("resets_at"))
    return o.where("ts is not null and used_percent is not null and window_minutes is not null and resets_at is not null").withColumn("window_minutes", snap_minutes(F.col("window_minutes")))


def snap_minutes(m: Column) -> Column:
    """Five hours or seven days if within a minute of it."""
    return F.when(F.abs(m - 300) <= 1, 300).when(F.abs(m - 10080) <= 1, 10080).otherwise(m)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal records; a torn last line, like any that doesn't parse, is skipped. ``month`` is the segment."""
    raw = spark.read.text(path).select(F.from_json("value", JOURNAL_LINE).alias("j")).select("j.*")
    return raw.where("id is not null and t in ('obs', 'op', 'evt')").withColumn("month", F.substring("at", 1, 7))


def append_journal(records: DataFrame, path: str) -> None:
    """Adds records to the journal, a folder per month."""
    fields = [c for c in ("v", "t", "id", "rev", "at", "src", "provider", "account", "payload") if c in records.columns]
    records.select(F.to_json(F.struct(*fields)).alias("value"), F.substring("at", 1, 7).alias("month")).write.mode("append").partitionBy("month").text(path)


def message_rows(lines: DataFrame) -> DataFrame:
    """(source_path, uuid, parent_uuid, ts, kind, text) of conversation lines; the first kind that fits: meta, tool_result, human,
    assistant; and queued for what a person typed while the other side was busy, which comes as an attachment of its own. What only
    wraps commands, notifications, echoes or summaries is meta wherever it stands. A line's text is the concatenation of its text blocks, without a note of when it was sent."""
    schema = (
        "type string, timestamp string, uuid string, parentUuid string, isMeta boolean, isSidechain boolean, message struct<role string, content string>, "
        "attachment struct<type string, commandMode string, prompt string>")
    j = F.from_json("line", schema)
    none = F.array().cast("array<struct<type:string,text:string>>")
    blocks = F.from_json(F.col("j.message.content"), "array<struct<type string, text string>>")
    mode, prompt = F.col("j.attachment.commandMode"), F.col("j.attachment.prompt")
    queued = (F.col("j.type") == "attachment") & F.col("j.uuid").isNotNull() & (F.col("j.attachment.type") == "queued_command") & mode.isin("prompt", "task-notification") & (F.trim(prompt) != "")
    m = lines.withColumn("j", j).withColumn("_queued", F.coalesce(queued, F.lit(False))).where("j.type in ('user', 'assistant') or _queued").withColumn("blocks", blocks)
    has_result = F.exists(F.coalesce("blocks", none), lambda b: b.type == "tool_result")
    own = F.when(F.col("j.message.content").startswith("["), F.array_join(F.transform(F.filter("blocks", lambda b: b.type == "text"), lambda b: b.text), "\n")).otherwise(F.col("j.message.content"))
    typed = F.col("_queued") | (F.col("j.type") == "user")
    text = F.coalesce(F.when(F.col("_queued"), prompt).otherwise(own), F.lit(""))
    text = F.when(typed, strip_sent(text)).otherwise(text)
    wrapped = typed & wrapper_kind(text).isNotNull() | F.col("_queued") & (mode == "task-notification")
    kind = (F.when(F.coalesce("j.isMeta", F.lit(False)), "meta").when(has_result, "tool_result").when(wrapped, "meta").when(F.col("_queued"), "queued").when(F.col("j.type") == "user", "human").otherwise("assistant"))
    return m.select("source_path", F.col("j.uuid").alias("uuid"), F.col("j.parentUuid").alias("parent_uuid"), F.try_to_timestamp("j.timestamp").alias("ts"), kind.alias("kind"), text.alias("text"))


def envelope(rows: DataFrame, version: int = 1) -> DataFrame:
    """One JSON text per row, the schema version first, non-finite numbers as null."""
    cols = [F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(F.lit(version).alias("schemaVersion"), *cols)).alias("json"))
