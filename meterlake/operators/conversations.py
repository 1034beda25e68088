"""Conversations: outlines, search, facets, export, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import diff_counts, occurrences
from .ranks import checkpointed

SCOPES = {"all": None, "prompts": ["user"], "chat": ["user", "assistant"]}


def classify(turns: DataFrame) -> DataFrame:
    """Adds ``kind`` to (role, text): empty, command, system, prompt, reply, tool; the first that holds."""
    t = F.coalesce("text", F.lit(""))
    kind = (F.when(F.trim(t) == "", "empty").when(t.startswith("/"), "command").when(F.col("role") == "system", "system")
            .when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "reply").otherwise("tool"))
    return turns.withColumn("kind", kind)


def outline(turns: DataFrame) -> DataFrame:
    """One row per conversation: turns, prompts, replies, characters, the first prompt as title."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count(F.when(F.col("role") == "user", 1)).alias("prompts"), F.count(F.when(F.col("role") == "assistant", 1)).alias("replies"),
        F.sum(F.length("text")).alias("chars"), F.substring(first, 1, 80).alias("title"))


def search(rows: DataFrame, text: str, query: str, by: list[str]) -> DataFrame:
    """Rows that hold a literal, ignoring case, with how often and the first place; an empty query finds nothing."""
    folded = F.lower(F.col(text))
    hits = rows.where(F.contains(folded, F.lit(query.lower()))) if query else rows.where(F.lit(False))
    return hits.select(*by, occurrences(F.col(text), query).alias("hits"), F.instr(folded, query.lower()).alias("first_at"))


#: What a search may be restricted to: the roles whose turns count; none means all.
SEARCH_KINDS = {"all": None, "prompts": ["user"], "assistant": ["assistant"], "tools": ["tool"]}


def search_conversations(turns: DataFrame, query: str, kind: str = "all", around: int = 40) -> DataFrame:
    """One row per conversation with a hit of a literal, ignoring case: hits in all, the roles that have some, the first turn that does
    and a snippet of it, ``around`` characters on either side."""
    roles = SEARCH_KINDS[kind]
    found = search(turns if roles is None else turns.where(F.col("role").isin(roles)), "text", query, ["conv_id", "turn", "role", "text"])
    g = found.groupBy("conv_id").agg(F.sum("hits").alias("hits"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("kinds"), F.min("turn").alias("turn"), F.min_by(F.struct("text", "first_at"), "turn").alias("h"))
    at = F.greatest(F.lit(1), F.col("h.first_at") - around)
    return g.select("conv_id", "hits", "kinds", "turn", F.substring(F.col("h.text"), at, F.col("h.first_at") - at + len(query) + around).alias("snippet"))


def facets(turns: DataFrame) -> DataFrame:
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))


PATCH = "map<string, struct<type string, unified_diff string, content string>>"


def patch_touches(rows: DataFrame, changes: str = "changes") -> DataFrame:
    """(conv_id, turn, path, op, added, removed) of patches (``PATCH``), a row a file. Counts come from the diff, or for a file that is added or deleted from its content; null where neither tells."""
    c = rows.select("conv_id", "turn", F.explode(changes).alias("path", "c"))
    lines = F.size(F.split("c.content", "\n")) - F.col("c.content").rlike(r"\n\z").cast("int") - (F.col("c.content") == "").cast("int")
    whole = F.when((F.col("c.type") == "add") & F.col("c.content").isNotNull(), F.struct(lines.alias("added"), F.lit(0).alias("removed"))).when((F.col("c.type") == "delete") & F.col("c.content").isNotNull(), F.struct(F.lit(0).alias("added"), lines.alias("removed")))
    counts = F.when(F.col("c.unified_diff").isNotNull(), diff_counts(F.col("c.unified_diff"))).otherwise(whole)
    return c.select("conv_id", "turn", "path", F.col("c.type").alias("op"), counts.alias("n")).select("conv_id", "turn", "path", "op", "n.added", "n.removed")


def replay_recipe(turns: DataFrame) -> DataFrame:
    """(conv_id, markdown): the prompts of each conversation as numbered steps of one line, to be run again; a conversation without any says so."""
    prompt = (F.col("role") == "user") & (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != "")
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    ordered = F.array_sort(F.collect_list(F.when(prompt, F.struct("turn", line.alias("x")))))
    g = turns.groupBy("conv_id").agg(ordered.alias("p"))
    steps = F.transform("p", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.x))
    body = F.when(F.size("p") > 0, F.array_join(steps, "\n")).otherwise("_(no prompts)_")
    return g.select("conv_id", F.concat(F.lit("# Replay recipe\n\n"), body, F.lit("\n")).alias("markdown"))


def export_markdown(turns: DataFrame, scope: str = "all") -> DataFrame:
    """(conv_id, markdown): turns of a scope in order, or as ``replay_recipe``. A conversation is one row, so it must fit in one."""
    if scope == "recipe":
        return replay_recipe(turns)
    roles = SCOPES[scope]
    t = turns if roles is None else turns.where(F.col("role").isin(roles))
    part = F.concat(F.lit("## "), "role", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", part.alias("p"))))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x.p), "\n\n").alias("markdown"))


def tail_page(turns: DataFrame, size: int) -> DataFrame:
    """The last ``size`` turns of every conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size)


def response_gaps(turns: DataFrame) -> DataFrame:
    """Prompts that no reply follows directly."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("_next", F.lead("role").over(w)).where((F.col("role") == "user") & F.coalesce(F.col("_next") != "assistant", F.lit(True))).drop("_next")


def file_touches(turns: DataFrame, pattern: str = r"[\w./-]+\.(?:py|ts|md|json|sql)\b") -> DataFrame:
    """(conv_id, path, touches, last_turn) of paths named in turns."""
    named = turns.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("path"))
    return named.groupBy("conv_id", "path").agg(F.count("*").alias("touches"), F.max("turn").alias("last_turn"))


#: Tools that write files, and the argument that a tool's preview shows.
WRITERS = ("Edit", "MultiEdit", "Write", "NotebookEdit")
PREVIEWED = {"Bash": "command", "Read": "file_path", "Edit": "file_path", "Write": "file_path", "Grep": "pattern", "Glob": "pattern", "Task": "description"}
TOOL_BLOCKS = "array<struct<type string, name string, input map<string, string>>>"


def tool_touches(rows: DataFrame, blocks: str = "blocks") -> DataFrame:
    """(conv_id, turn, path, tool) of tool blocks (``TOOL_BLOCKS``) that write a file."""
    b = rows.select("conv_id", "turn", F.explode(blocks).alias("b")).where((F.col("b.type") == "tool_use") & F.col("b.name").isin(*WRITERS))
    return b.select("conv_id", "turn", F.try_element_at("b.input", F.lit("file_path")).alias("path"), F.col("b.name").alias("tool")).where("path is not null")


def tool_preview(name: Column, arguments: Column) -> Column:
    """One line that says what a tool call does: its main argument, for a task without one its kind, else the first argument that isn't
    empty, else the tool's name."""
    main = F.create_map(*[F.lit(x) for kv in PREVIEWED.items() for x in kv])
    value = F.coalesce(F.try_element_at(arguments, F.try_element_at(main, name)), F.when(name == "Task", F.try_element_at(arguments, F.lit("subagent_type"))))
    first = F.try_element_at(F.filter(F.map_values(arguments), lambda v: v.isNotNull() & (v != "")), F.lit(1))
    shown = F.coalesce(value, first)
    return F.when(arguments.isNull(), "").when(F.coalesce(shown, F.lit("")) == "", F.coalesce(name, F.lit(""))).otherwise(F.element_at(F.split(shown, "\r?\n"), 1))


def turn_outline(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, chars, before, prompt): the skeleton of a conversation, with the characters before each turn and the number of
    the prompt that it belongs to."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = classify(turns).select("conv_id", "turn", "kind", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    before = F.coalesce(F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("before", before).withColumn("prompt", F.count(F.when(F.col("kind") == "prompt", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def window_filter(column: str, low: Column | None, high: Column | None) -> Column:
    """Half-open bounds; a null bound is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    if high is not None:
        out = out & (F.col(column) < high)
    return out


FAILED = ("failed", "error", "cancelled", "timeout")


def tool_failures(calls: DataFrame) -> DataFrame:
    """Adds ``failed`` to (is_error, status, patch_success): an error mark, a failed status, or a patch that says so; unknown is no failure."""
    bad = F.coalesce(F.col("is_error"), F.lit(False)) | F.coalesce(F.lower("status").isin(*FAILED), F.lit(False)) | F.coalesce(~F.col("patch_success"), F.lit(False))
    return calls.withColumn("failed", bad)


def titles(turns: DataFrame) -> DataFrame:
    """The latest non-empty title per conversation of rows (conv_id, turn, title)."""
    return turns.where(F.coalesce("title", F.lit("")) != "").groupBy("conv_id").agg(F.max_by("title", "turn").alias("title"))


def title_search(turns: DataFrame, query: str) -> DataFrame:
    """One hit per conversation whose title, its first prompt, holds the query, anchored at its first turn."""
    t = outline(turns).select("conv_id", "title")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("anchor"))
    hits = t.where(F.contains(F.lower("title"), F.lit(query.lower()))) if query else t.where(F.lit(False))
    return hits.join(first, "conv_id").select("conv_id", "anchor", "title")


def file_search(touches: DataFrame, query: str) -> DataFrame:
    """(conv_id, path) whose path holds the query, ignoring case, at its latest touch."""
    return touches.where(F.contains(F.lower("path"), F.lit(query.lower()))).groupBy("conv_id", "path").agg(F.max("last_turn").alias("anchor"))


def find(turns: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """Turns that match a regular expression, with the number of matches; sort by turn for document order."""
    p = pattern if case_sensitive else f"(?i){pattern}"
    n = F.regexp_count("text", F.lit(p))
    return turns.select("conv_id", "turn", n.alias("matches")).where("matches > 0")


def prompts(turns: DataFrame) -> DataFrame:
    """The spine of a conversation: its prompts that are no commands, numbered."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return classify(turns).where("kind = 'prompt'").select("conv_id", "turn", F.row_number().over(w).alias("n"))


def nearest_root(rows: DataFrame, roots: DataFrame, cwd: str = "cwd") -> DataFrame:
    """Adds ``root`` to rows with a working directory: the innermost of ``roots`` (root) that is the directory itself or above it, null if none is. Every directory is cut into those
    above it once, and these are met by an equality; slashes at the end don't count."""
    parts = F.split("_cwd", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when((n == 1) & (parts[0] == ""), "/").otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    dirs = rows.select(F.col(cwd).alias("_dir")).where("_dir <> ''").distinct().withColumn("_cwd", F.regexp_replace("_dir", "(?<=.)/+$", ""))
    known = roots.select(F.regexp_replace("root", "(?<=.)/+$", "").alias("_root")).where("_root is not null").distinct()
    best = dirs.select("_dir", F.explode(above).alias("_root")).join(known, "_root").groupBy("_dir").agg(F.max_by("_root", F.length("_root")).alias("root"))
    return rows.join(best, F.col(cwd) == F.col("_dir"), "left").drop("_dir")


def browse(turns: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """One row per session of (conv_id, ts, cwd, branch, model, main): latest branch that is known, models, main ones first, by name,
    null if none; ``roots`` (cwd, root) names projects, as the file system cannot be asked from a task."""
    t = turns if roots is None else turns.join(roots, "cwd", "left")
    project = F.col("root") if roots is not None else F.col("cwd")
    ordered = F.array_sort(F.collect_set(F.when(F.col("model").isNotNull(), F.struct((~F.col("main")).alias("side"), "model"))))
    g = t.groupBy("conv_id").agg(F.max_by("branch", F.when(F.col("branch").isNotNull(), F.col("ts"))).alias("branch"), F.max_by(project, F.when(project.isNotNull(), F.col("ts"))).alias("project"), ordered.alias("m"), F.max("ts").alias("last_ts"))
    names = F.array_distinct(F.transform("m", lambda x: x.model))
    return g.select("conv_id", "branch", F.coalesce("project", F.lit("")).alias("project"), F.when(F.size(names) > 0, names).alias("models"), "last_ts")


def buckets(turns: DataFrame) -> DataFrame:
    """Adds ``bucket`` to turns (conv_id, turn, parent, agent): a turn's own agent, or else that of the nearest turn above it that has one; null for the main
    thread. A turn whose parent isn't there is a root; turns that follow each other in a circle have no bucket, and ``circular`` says so.

    Pointers are doubled: every round a turn takes over what the turn that it points to has found, or points where that one points, so a
    chain of any length is done in as many rounds as its length has binary digits. Each round's table is stored."""
    key = ["conv_id", "turn"]
    there = turns.select("conv_id", F.col("turn").alias("parent"), F.col("turn").alias("_t")).distinct()
    known = turns.select(*key, "parent", "agent").join(there, ["conv_id", "parent"], "left").select(*key, "agent", F.when(F.col("agent").isNull(), F.col("_t")).alias("up"))
    state = checkpointed(known.groupBy(*key).agg(F.min("agent").alias("found"), F.min("up").alias("up")).withColumn("up", F.when(F.col("found").isNull(), F.col("up"))))
    jump, nodes = 1, state.count()
    while jump <= nodes and not state.where("up is not null").isEmpty():
        s, t = state.alias("s"), state.alias("t")
        met = s.join(t, (F.col("s.conv_id") == F.col("t.conv_id")) & (F.col("s.up") == F.col("t.turn")), "left")
        state = checkpointed(met.select("s.conv_id", "s.turn", F.coalesce("s.found", "t.found").alias("found"), F.col("t.up").alias("up")))
        jump *= 2
    return turns.join(state.select(*key, F.col("found").alias("bucket"), F.col("up").isNotNull().alias("circular")), key)


def bucket_outline(turns: DataFrame) -> DataFrame:
    """(conv_id, bucket, turns, cost, files, tasks) of turns (conv_id, turn, parent, agent, message, cost, files, tasks): each message's cost counts once, at its first turn;
    ``files`` counts the different paths of a bucket's lists, ``tasks`` is its latest snapshot."""
    b = buckets(turns)
    first = Window.partitionBy("conv_id", "message").orderBy("turn")
    once = b.withColumn("_c", F.when(F.col("message").isNull() | (F.row_number().over(first) == 1), F.col("cost")))
    paths = b.select("conv_id", "bucket", F.explode("files").alias("_f")).groupBy("conv_id", "bucket").agg(F.countDistinct("_f").alias("files"))
    g = once.groupBy("conv_id", "bucket").agg(F.count("*").alias("turns"), F.sum("_c").alias("cost"), F.max_by("tasks", F.when(F.col("tasks").isNotNull(), F.col("turn"))).alias("tasks"))
    g, p = g.alias("g"), paths.alias("p")
    same = (F.col("g.conv_id") == F.col("p.conv_id")) & F.col("g.bucket").eqNullSafe(F.col("p.bucket"))
    return g.join(p, same, "left").select("g.conv_id", "g.bucket", "turns", "cost", F.coalesce("files", F.lit(0)).alias("files"), "tasks")
