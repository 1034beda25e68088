"""Subagents, bounded inputs and segments of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions.text import bounded_json
from ..operators import conversations
from ..operators.segments import segments
from ..sources.logs import message_rows
from ..sources.logs import physical_events as events_of
from ..sources.logs import thread_facts as facts_of
from ..sources.tables import table
from .registry import USAGE_SQL, query, usage

_TURNS = """t AS (SELECT conv_id, turn, CASE WHEN turn % 11 = 7 THEN turn + 1000 WHEN conv_id % 13 = 6 AND turn = 4 THEN 5 WHEN conv_id % 13 = 6 AND turn = 5 THEN 4 WHEN turn > 0 THEN turn - 1 - turn % 2 END AS parent, CASE WHEN turn % 6 = 3 OR turn % 8 = 2 THEN 'agent-' || turn % 5 END AS agent,
  turn // 2 AS message, length(text)::BIGINT AS cost, CASE WHEN turn % 3 <> 1 THEN regexp_extract_all(text, '[a-z]{8,}') END AS files, CASE WHEN turn % 4 = 1 THEN turn % 3 || '/' || turn % 3 + 2 END AS tasks FROM conversations)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in a forest: some lead two back, some have a parent that isn't there, and two of some conversations follow each other."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    odd = F.col("conv_id") % 13 == 6
    parent = F.when(t % 11 == 7, t + 1000).when(odd & (t == 4), 5).when(odd & (t == 5), 4).when(t > 0, t - 1 - t % 2)
    agent = F.when((t % 6 == 3) | (t % 8 == 2), F.concat(F.lit("agent-"), t % 5))
    tasks = F.when(t % 4 == 1, F.concat(t % 3, F.lit("/"), t % 3 + 2))
    return c.select("conv_id", "turn", parent.alias("parent"), agent.alias("agent"), F.floor(t / 2).alias("message"), F.length("text").cast("long").alias("cost"), F.when(t % 3 != 1, F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))).alias("files"), tasks.alias("tasks"))


@query(f"""WITH RECURSIVE {_TURNS}, r AS (SELECT conv_id, turn, agent AS bucket FROM t WHERE agent IS NOT NULL UNION ALL SELECT c.conv_id, c.turn, r.bucket FROM r JOIN t c ON c.conv_id = r.conv_id AND c.parent = r.turn AND c.agent IS NULL),
b AS (SELECT t.*, bucket, CASE WHEN row_number() OVER (PARTITION BY t.conv_id, message ORDER BY t.turn) = 1 THEN cost END AS once FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn),
f AS (SELECT conv_id, bucket, count(DISTINCT p) AS files FROM (SELECT conv_id, bucket, unnest(files) AS p FROM b) GROUP BY ALL), g AS (SELECT conv_id, bucket, count(*) AS turns, sum(once)::BIGINT AS cost, arg_max(tasks, turn) FILTER (WHERE tasks IS NOT NULL) AS tasks FROM b GROUP BY ALL)
SELECT g.conv_id, g.bucket, turns, cost, coalesce(files, 0) AS files, tasks FROM g LEFT JOIN f ON f.conv_id = g.conv_id AND f.bucket IS NOT DISTINCT FROM g.bucket""")
def subagent_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs, files and task snapshots of a conversation by the subagent that its turns come under."""
    return conversations.bucket_outline(_turns(spark, sf_dir))


@query("""WITH d AS (SELECT conv_id, turn, repeat(text, 1 + turn::INTEGER % 9) AS a, text AS b FROM conversations)
SELECT conv_id, turn, len(a) > 8000 AS truncated, true AS within, md5(a[1:8000]) AS a, md5(b) AS b FROM d""")
def bounded_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool inputs with a leaf that may be long, read back after they were cut."""
    c = table(spark, sf_dir, "conversations")
    d = c.select("conv_id", "turn", F.to_json(F.struct(F.expr("repeat(text, 1 + cast(turn as int) % 9)").alias("a"), F.col("text").alias("b"))).alias("doc")).select("conv_id", "turn", bounded_json(F.col("doc")).alias("x"))
    back = F.from_json("x.text", "a string, b string")
    return d.select("conv_id", "turn", "x.truncated", (F.length("x.text") <= 32_000).alias("within"), F.md5(back.a).alias("a"), F.md5(back.b).alias("b"))


@query("""WITH RECURSIVE l AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, list((1 + length(text) // 300)::BIGINT ORDER BY turn) AS b, list((CASE WHEN turn % 7 = 3 THEN 0 WHEN turn % 3 = 1 THEN 1 ELSE 2 END)::INTEGER ORDER BY turn) AS k FROM conversations GROUP BY 1),
p AS (SELECT conv_id, turns, b, k, 0::BIGINT AS s, 0::BIGINT AS e, -1 AS segment FROM l UNION ALL SELECT conv_id, turns, b, k, e, coalesce(cut, whole), segment + 1 FROM (
  SELECT *, (list_sort([[k[c + 1]::BIGINT, c] for c in range(e + 1, whole) if list_sum(b[e + 1:c]) >= 8 - 3 AND k[c + 1] < 2])[1])[2] AS cut FROM (
    SELECT *, list_max([x for x in range(e + 1, len(b) + 1) if x = e + 1 OR list_sum(b[e + 1:x]) <= 8]) AS whole FROM p WHERE e < len(b))))
SELECT conv_id, unnest(turns[s + 1:e]) AS turn, segment FROM p WHERE segment >= 0""")
def lookback_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut in segments of at most eight blocks of 300 characters, looking back over 45 percent for a title or a change to tools."""
    c, none = table(spark, sf_dir, "conversations"), F.lit(None).cast("long")
    rank = F.when(F.col("turn") % 7 == 3, 0).when(F.col("turn") % 3 == 1, 1).otherwise(2)
    g = c.select("conv_id", "turn", (1 + F.floor(F.length("text") / 300)).alias("blocks"), rank.alias("rank"), none.alias("first"), none.alias("last"))
    return segments(g, ["conv_id"], "turn", 8, 0.45).select("conv_id", "turn", "segment")


@query(r"""WITH t AS (SELECT conv_id, turn, turn % 8 AS k, text FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'marker' WHEN 1 THEN 'notification' WHEN 2 THEN 'echo' WHEN 3 THEN 'compaction' END AS kind, md5(CASE WHEN k = 5 THEN text ELSE CASE k WHEN 0 THEN ' <command-name>/run</command-name> <command-args>' || text || '</command-args> ' WHEN 1 THEN '<task-notification>' || text || '</task-notification> later'
  WHEN 2 THEN chr(10) || '<bash-stdout>' || text || '</bash-stdout>' WHEN 3 THEN 'This session is being continued from a previous conversation: ' || text WHEN 4 THEN '<command-name>/run</command-name>' || text WHEN 6 THEN '<bash-input>' || text ELSE text END END) AS shown FROM t""")
def message_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns wrapped as commands, notifications and echoes are, coloured, or stamped with when they were sent; some only begin like that."""
    t, k = F.col("text"), F.col("turn") % 8
    wrap = lambda a, b="": F.concat(F.lit(a), t, F.lit(b))
    raw = (F.when(k == 0, wrap(" <command-name>/run</command-name> <command-args>", "</command-args> ")).when(k == 1, wrap("<task-notification>", "</task-notification> later")).when(k == 2, wrap("\n<bash-stdout>", "</bash-stdout>"))
           .when(k == 3, wrap("This session is being continued from a previous conversation: ")).when(k == 4, wrap("<command-name>/run</command-name>")).when(k == 5, wrap(" <system-reminder>Message sent at 2024-01-01 10:00 UTC.</system-reminder> ")).when(k == 6, wrap("<bash-input>")).otherwise(t))
    coloured = F.concat(F.lit("\x1b[1m\x1b]0;title\x07"), raw, F.lit("\x1b[0m\x1b"))
    plain = texts.strip_ansi(coloured)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.wrapper_kind(plain).alias("kind"), F.md5(texts.strip_sent(plain)).alias("shown"))


@query("""SELECT conv_id, turn, sha256('{"a":{"k":[1,{"x":null,"y":' || turn || '}],"l":true},"b":' || conv_id || ',"role":"' || role || '"}') AS digest FROM conversations""")
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of documents whose keys, nested ones too, come in an order that differs from row to row."""
    odd = F.col("turn") % 2 == 1
    inner = F.when(odd, F.format_string('{"l": true, "k": [1, {"y": %d, "x": null}]}', "turn")).otherwise(F.format_string('{"k":[1,{"x":null,"y":%d}],"l":true}', "turn"))
    doc = F.when(odd, F.format_string('{"role": "%s", "b": %d, "a": %s}', "role", "conv_id", inner)).otherwise(F.format_string('{"b":%d , "a":%s, "role":"%s"}', "conv_id", inner, "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(texts.canonical_document(doc), 256).alias("digest"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'one ' || turn || '|' || role || '|plain' WHEN turn % 3 = 1 THEN '**one ' || turn || '**' || chr(10) || 'text|plain' ELSE 'plain' END AS headings FROM conversations""")
def reasoning_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold lines of summaries as headings; an entry with any other line stays whole."""
    one = F.concat(F.lit("**one "), "turn", F.lit("**"))
    first = F.when(F.col("turn") % 3 == 0, F.concat(one, F.lit("\n<!-- -->\n\n  **"), "role", F.lit("** \n"))).when(F.col("turn") % 3 == 1, F.concat(one, F.lit("\ntext"))).otherwise(" ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(texts.reasoning_headings(F.array(first, F.lit(None).cast("string"), F.lit("plain"))), "|").alias("headings"))


@query("""WITH t AS (SELECT conv_id, turn, 1 + turn % 4 AS plus, turn % 3 AS minus, len(string_split(text, chr(10))) AS n, text[len(text):] = chr(10) OR text = '' AS closed FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, 'a.sql' AS path, 'update' AS op, (plus + 1)::INTEGER AS added, (minus + 1)::INTEGER AS removed FROM t UNION ALL SELECT conv_id, turn, 'b.txt', 'add', (n - closed::INTEGER)::INTEGER, 0 FROM t UNION ALL SELECT conv_id, turn, 'c.txt', 'update', NULL, NULL FROM t""")
def patch_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of patches with their counts: a diff whose lines look like heads, a new file, and a diff without a hunk."""
    t = F.col("turn")
    plus, minus = (1 + t % 4).cast("int"), (t % 3).cast("int")
    diff = F.concat(F.lit("--- a.sql\n+++ a.sql\n@@ -1,"), minus + 1, F.lit(" +1,"), plus + 1, F.lit(" @@ part\n"), F.repeat(F.lit("--- old\n"), minus), F.repeat(F.lit("+++i;\n"), plus), F.lit(" same\n\\ No newline\n@@ -90 +90 @@\n-x\n+y\n+beyond"))
    change = lambda kind, d, c: F.struct(F.lit(kind).alias("type"), d.cast("string").alias("unified_diff"), c.cast("string").alias("content"))
    none = F.lit(None)
    changes = F.create_map(F.lit("a.sql"), change("update", diff, none), F.lit("b.txt"), change("add", none, F.col("text")), F.lit("c.txt"), change("update", F.lit("+no hunk"), none))
    return conversations.patch_touches(table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", changes.alias("changes")))


@query(r"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x, role FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM p WHERE role = 'user' AND x <> ''),
g AS (SELECT conv_id, string_agg(n || '. ' || x, chr(10) ORDER BY n) AS body FROM n GROUP BY 1) SELECT c.conv_id, '# Replay recipe' || chr(10) || chr(10) || coalesce(body, '_(no prompts)_') || chr(10) AS markdown FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id)""".replace("\\\\s", "\\s"))
def replay_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.export_markdown(table(spark, sf_dir, "conversations"), "recipe")


def _rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of rollouts, a file a session: some begin a thread, all others are calls; some are no JSON."""
    u, k = usage(spark, sf_dir), F.col("k")
    git = F.when(k % 4 == 0, F.format_string(', "git": {"url": "u%d", "branch": "b"}', k)).otherwise("")
    source = F.when(k % 3 == 0, ', "source": {"subagent": {}}').when(k % 3 == 1, ', "source": "cli"').otherwise("")
    meta = F.format_string('{"type": "session_meta", "payload": {"id": "t%d"%s%s, "context_window": %d}}', "entry_id", git, source, k - 20)
    call = F.format_string('{"payload": {"type": "call", "turn_id": "%d", "call_id": "c%d", "b": {"z": 1, "a": 2}}, "type": "event_msg"}', k, "entry_id")
    line = F.when(k % 10 < 3, meta).when(k % 10 == 9, F.lit("torn {")).otherwise(call)
    return u.select(F.concat(F.lit("s"), "session_id").alias("source_path"), F.col("entry_id").alias("pos"), line.alias("value"))


@query(f"""WITH {USAGE_SQL} SELECT 's' || session_id AS source_path, entry_id AS pos, 't' || entry_id AS thread_id, CASE WHEN k % 3 = 0 THEN 'subagent' ELSE 'user' END AS thread_source, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS cwd, CASE WHEN k % 4 = 0 THEN '{{"branch":"b","url":"u' || k || '"}}' END AS git,
CASE WHEN k % 3 = 1 THEN 'cli' END AS source_kind, NULL::VARCHAR AS provider, CASE WHEN k > 20 THEN k - 20 END AS context_window FROM u WHERE k % 10 < 3""")
def thread_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(_rollout(spark, sf_dir))


@query(f"""WITH {USAGE_SQL}, l AS (SELECT 's' || session_id AS source_path, entry_id AS pos, k, k % 10 < 3 AS meta FROM u WHERE k % 10 <> 9)
SELECT source_path, pos, CASE WHEN meta THEN 'session_meta' ELSE 'event_msg' END AS record_type, CASE WHEN NOT meta THEN 'call' END AS event_type, CASE WHEN NOT meta THEN k::VARCHAR END AS turn_id, CASE WHEN NOT meta THEN 'c' || pos END AS call_id,
  last_value(CASE WHEN meta THEN 't' || pos END IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS thread_id, CASE WHEN NOT meta THEN '{{"b":{{"a":2,"z":1}},"call_id":"c' || pos || '","turn_id":"' || k || '","type":"call"}}' END AS payload FROM l""")
def physical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a rollout with its canonical payload; of lines that begin a thread the payload is left to ``thread_facts``."""
    e = events_of(_rollout(spark, sf_dir)).drop("ts")
    return e.withColumn("payload", F.when(F.col("record_type") != "session_meta", F.col("payload")))


@query("""SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'meta' WHEN 2 THEN 'meta' WHEN 3 THEN 'human' ELSE 'queued' END AS kind, md5(CASE turn % 7 WHEN 1 THEN 'done: ' || text WHEN 2 THEN '<bash-input>' || text || '</bash-input>' ELSE text END) AS text FROM conversations WHERE turn % 7 <> 4 AND trim(text) <> ''""")
def queued_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as lines of a conversation, most of them queued while the other side was busy, and read back."""
    c, k, t = table(spark, sf_dir, "conversations"), F.col("turn") % 7, F.col("text")
    prompt = F.when(k == 1, F.concat(F.lit("done: "), t)).when(k == 2, F.concat(F.lit("<bash-input>"), t, F.lit("</bash-input>"))).when(k == 5, F.concat(F.lit("<system-reminder>Message sent at 10:00 UTC.</system-reminder> "), t)).otherwise(t)
    attachment = F.struct(F.when(k == 4, "file").otherwise("queued_command").alias("type"), F.when(k == 1, "task-notification").otherwise("prompt").alias("commandMode"), prompt.alias("prompt"))
    id_ = F.concat_ws(":", "conv_id", "turn").alias("uuid")
    queued = F.to_json(F.struct(F.lit("attachment").alias("type"), id_, attachment.alias("attachment")))
    plain = F.to_json(F.struct(F.lit("user").alias("type"), id_, F.struct(F.lit("user").alias("role"), t.alias("content")).alias("message")))
    lines = c.where("trim(text) <> ''").select(F.lit("f").alias("source_path"), F.when(k == 3, plain).otherwise(queued).alias("line"))
    at = F.split("uuid", ":")
    return message_rows(lines).select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "kind", F.md5("text").alias("text"))


_ROOTS = ["/home/u0", "/home/u0/p1/", "/home/u1/p2/src", "/home/u2/p3/s", "/home/u3", "/home/u3/p4/src/m1"]


@query(f"""WITH {USAGE_SQL}, c AS (SELECT entry_id, '/home/u' || session_id % 5 || '/p' || project || CASE WHEN k % 3 > 0 THEN '/src/m' || k % 4 ELSE '/' END AS cwd FROM u), r(root) AS (VALUES {', '.join(f"('{r.rstrip('/')}')" for r in _ROOTS)}),
m AS (SELECT entry_id, arg_max(root, length(root)) AS root FROM c JOIN r ON rtrim(cwd, '/') = root OR starts_with(cwd, root || '/') GROUP BY 1) SELECT entry_id, root FROM c LEFT JOIN m USING (entry_id)""")
def project_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost repository root above each entry's directory."""
    tail = F.when(F.col("k") % 3 > 0, F.concat(F.lit("/src/m"), F.col("k") % 4)).otherwise("/")
    rows = usage(spark, sf_dir).select("entry_id", F.concat(F.lit("/home/u"), F.col("session_id") % 5, F.lit("/p"), "project", tail).alias("cwd"))
    values = ", ".join(f"('{r}')" for r in _ROOTS)
    return conversations.nearest_root(rows, spark.sql(f"select * from values {values} as t(root)")).select("entry_id", "root")
