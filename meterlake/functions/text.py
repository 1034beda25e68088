"""Text columns: names, numbers, secrets, line differences, search."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a secret, in order; the flags are (ignore case, keep group 1).
SECRETS = [
    ("authorization-header", r"(\bAuthorization:[ \t]*)\S[^\r\n]*", True, True),
    ("bearer-token", r"(\bBearer[ \t]+)[A-Za-z0-9._~+/=-]{16,}", True, True),
    ("anthropic-key", r"sk-ant-[A-Za-z0-9_-]{8,}", False, False),
    ("generic-sk-key", r"sk-[A-Za-z0-9_-]{20,}", False, False),
    ("github-token", r"(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{16,}", False, False),
    ("aws-access-key", r"AKIA[0-9A-Z]{16}", False, False),
    ("slack-token", r"xox[baprs]-[A-Za-z0-9-]{10,}", False, False),
    ("secret-assignment", r"(\b(?:api[_-]?key|secret|token|passwd|password)\b[ \t]*[=:][ \t]*)(?:\"[^\"\r\n]{6,}\"|'[^'\r\n]{6,}'|[^\s\"']{6,})", True, True),
]


def scrub_secrets(text: Column) -> Column:
    """Secrets replaced by [REDACTED:name], in order; a second pass changes nothing."""
    for name, pattern, fold, keep in SECRETS:
        text = F.regexp_replace(text, ("(?i)" if fold else "") + pattern, ("$1" if keep else "") + f"[REDACTED:{name}]")
    return text


# Fixed value: characters that continue a word, so that a whole-word token next to one stays.
EDGE = "A-Za-z0-9_.-"


def scrub_identities(text: Column, tokens: dict[str, tuple[str, bool]]) -> Column:
    """``tokens``: what to replace -> (by what, only as a whole word). One pass, the longest match first, so that no replacement is
    replaced again."""
    if not tokens:
        return text
    alternatives = [rf"(?<![{EDGE}]){re.escape(t)}(?![{EDGE}])" if whole else re.escape(t) for t, (_, whole) in sorted(tokens.items(), key=lambda x: (-len(x[0]), x[0]))]
    pattern = re.compile("|".join(alternatives))

    @F.pandas_udf("string")
    def scrub(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: pattern.sub(lambda m: tokens[m[0]][0], x), na_action="ignore")

    return scrub(text)


def short_model(model: Column) -> Column:
    """Without vendor prefix and date."""
    return F.regexp_replace(F.regexp_replace(model, "^(?:claude-|anthropic[/.])", ""), r"-\d{8}$", "")


def humanise(n: Column) -> Column:
    """1234 -> 1.2K, 1500000 -> 1.5M."""
    tenth = lambda x: F.format_number(x, 1)
    return F.when(n >= 1_000_000, F.concat(tenth(n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(tenth(n / 1e3), F.lit("K"))).otherwise(n.cast("string"))


def occurrences(text: Column, query: str) -> Column:
    """How often a literal occurs, ignoring case, without overlaps."""
    if not query:
        return F.lit(0)
    q = query.lower()
    folded = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(folded) - F.length(F.replace(folded, F.lit(q), F.lit("")))) / F.lit(len(q))).cast("int")


def line_diff(old: Column, new: Column, budget: int = 4_000_000) -> Column:
    """struct(added, removed) lines by longest common subsequence; null if the table would have more than ``budget`` cells. A line ends after a line
    feed and at no other character."""

    def lines(s: str | None) -> list[str]:
        return re.findall(r"[^\n]*\n|[^\n]+", s or "")

    def common(a: list[str], b: list[str]) -> int:
        """Length of the longest common subsequence; a row of its table is one whole number, a bit a place, which is zero where the row steps up."""
        at: dict[str, int] = {}
        for i, x in enumerate(a):
            at[x] = at.get(x, 0) | 1 << i
        ones = (1 << len(a)) - 1
        row = ones
        for y in b:
            met = row & at.get(y, 0)
            row = (row + met | row - met) & ones
        return len(a) - row.bit_count()

    def stat(a: list[str], b: list[str]) -> tuple[int | None, int | None]:
        if len(a) * len(b) > budget:
            return None, None
        n = common(a, b)
        return len(b) - n, len(a) - n

    @F.pandas_udf("added int, removed int")
    def diff(olds: pd.Series, news: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stat(lines(a), lines(b)) for a, b in zip(olds, news)], columns=["added", "removed"]).astype("Int32")

    return diff(old, new)


def opaque_key(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def strip_ansi(text: Column) -> Column:
    """Without terminal escape sequences: control sequences, commands to the terminal up to their end, and escapes that are cut off."""
    return F.regexp_replace(text, "\x1b\\[[0-9;:?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)?|\x1b", "")


# What wraps text that a person did not write.
MARKERS = ("command-name", "command-message", "command-args", "local-command-caveat", "local-command-stdout", "local-command-stderr")
NOTIFICATIONS, ECHOES = ("task-notification", "bash-notification"), ("bash-input", "bash-stdout", "bash-stderr")
COMPACTION = "This session is being continued from a previous conversation"
SENT = r"\A\s*<system-reminder>Message sent at [^<]*UTC\.</system-reminder>\s*"


def _wrapped(tags: tuple[str, ...]) -> str:
    """A pattern of one whole element, up to the first end that fits; it does not look further for another end."""
    return rf"<({'|'.join(tags)})>(?>[\s\S]*?</\1>)"


def wrapper_kind(text: Column) -> Column:
    """What a text is that a person did not write: marker if it is nothing but elements of commands, notification or echo if it begins with a whole element of that kind, compaction if it
    begins as a summary does; else null."""
    return (F.when(text.rlike(rf"\A\s*(?:{_wrapped(MARKERS)}\s*)++\z"), "marker").when(text.rlike(rf"\A\s*{_wrapped(NOTIFICATIONS)}"), "notification")
            .when(text.rlike(rf"\A\s*{_wrapped(ECHOES)}"), "echo").when(text.rlike(rf"\A\s*{re.escape(COMPACTION)}"), "compaction"))


def strip_sent(text: Column) -> Column:
    """Without a leading note of when a message was sent."""
    return F.regexp_replace(text, SENT, "")


def canonical_document(document: Column) -> Column:
    """A JSON text with the keys of all objects in order and no spaces, whatever nests in it; null for what is no JSON or names a key twice. Numbers are
    written as their value is, 1.50 as 1.5."""
    return F.to_json(F.try_parse_json(document))


def reasoning_headings(entries: Column) -> Column:
    """Headings of a summary (array of texts): an entry of which each line but separators is a bold one gives those lines' texts, any other entry itself. Blank and null entries give none."""
    def one(entry: Column) -> Column:
        lines = F.filter(F.transform(F.split(entry, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "<!-- -->"))
        bold = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"\A\*\*[^\n]+\*\*\z"))
        return F.when(bold, F.transform(lines, lambda x: F.substring(x, F.lit(3), F.length(x) - 4))).otherwise(F.array(entry))

    return F.flatten(F.transform(F.filter(entries, lambda e: F.coalesce(F.trim(e) != "", F.lit(False))), one))


def diff_counts(diff: Column) -> Column:
    """struct(added, removed) lines of a unified diff, counted inside its hunks, whose heads say how many lines they have; null for a text without a hunk."""
    head = r"^@@ -[0-9]+(?:,([0-9]+))? [+][0-9]+(?:,([0-9]+))? @@"
    start = F.struct(F.lit(0).alias("old"), F.lit(0).alias("new"), F.lit(0).alias("added"), F.lit(0).alias("removed"), F.lit(False).alias("seen"))

    def size(line: Column, group: int) -> Column:
        n = F.regexp_extract(line, head, group)
        return F.when(n == "", 1).otherwise(n.try_cast("int"))

    def step(s: Column, line: Column) -> Column:
        inside, opens = (s.old > 0) | (s.new > 0), line.rlike(head)
        plus, minus, note = line.startswith("+"), line.startswith("-"), line.startswith("\\")
        counts = inside & ~note
        return F.struct(
            F.when(~inside & opens, size(line, 1)).otherwise(s.old - (counts & ~plus).cast("int")).alias("old"), F.when(~inside & opens, size(line, 2)).otherwise(s.new - (counts & ~minus).cast("int")).alias("new"),
            (s.added + (counts & plus).cast("int")).alias("added"), (s.removed + (counts & minus).cast("int")).alias("removed"), (s.seen | ~inside & opens).alias("seen"))

    done = F.aggregate(F.split(diff, "\n"), start, step)
    return F.when(done.seen, F.struct(done.added.alias("added"), done.removed.alias("removed")))


def command_of(text: Column) -> Column:
    """struct(name, args) of a slash command; null for other texts."""
    name = F.regexp_extract(text, r"^/([A-Za-z][\w:-]*)", 1)
    return F.when(name != "", F.struct(name.alias("name"), F.trim(F.regexp_extract(text, r"^/[A-Za-z][\w:-]*\s+([\s\S]*)$", 1)).alias("args")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def encode_identity(*parts: Column) -> Column:
    """Parts as one URL-safe text; ``decode_identity`` gives them back."""
    raw = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.regexp_replace(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def decode_identity(token: Column) -> Column:
    pad = F.rpad(F.translate(token, "-_", "+/"), ((F.length(token) + 3) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.decode(F.unbase64(pad), "UTF-8"), "array<string>")


def preview(text: Column, width: int = 80) -> Column:
    """The first line, shortened."""
    line = F.trim(F.element_at(F.split(F.coalesce(text, F.lit("")), "\n"), 1))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def ranges(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """array<struct<start, end>> of a literal's occurrences, from 0, without overlaps: the text is cut at them and the parts' lengths summed up."""
    if not query:
        return F.array().cast("array<struct<start:int,end:int>>")
    hay, q = (text, query) if case_sensitive else (F.lower(text), query.lower())
    parts = F.split(F.coalesce(hay, F.lit("")), re.escape(q))
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, n: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + n
        return F.array_append(acc, F.struct(at.cast("int").alias("start"), (at + len(q)).cast("int").alias("end")))

    return F.aggregate(sizes, empty, step)


def content_hash(*parts: Column) -> Column:
    """Hash of a canonical JSON text: the fields in the order given."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def canonical_usage(usage: dict[str, Column]) -> Column:
    """Usage as JSON with its keys in order; a value that is null leaves its key out."""
    return F.to_json(F.struct(*[usage[k].alias(k) for k in sorted(usage)]))


def canonical_json(record: Column) -> Column:
    """A map of texts as JSON with its keys in order, for hashing."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(record))))


def capped(text: Column, most: int = 16_000) -> Column:
    """struct(text, cut): at most ``most`` characters, and how many were left off."""
    return F.struct(F.substring(text, 1, most).alias("text"), F.greatest(F.lit(0), F.length(text) - most).alias("cut"))


def string_leaves(document: Column, most: int = 16_000, depth: int = 12) -> Column:
    """array<string>: the texts in a JSON document that aren't empty, in its order and without keys, each up to ``most`` characters, none from
    below ``depth``. JSON nests without bound, which no built-in function walks, so a batch is read in Python."""

    def walk(v: object, level: int, out: list[str]) -> None:
        if isinstance(v, str):
            if v:
                out.append(v[:most])
        elif level < depth and isinstance(v, (dict, list)):
            for x in v.values() if isinstance(v, dict) else v:
                walk(x, level + 1, out)

    def of(text: str | None) -> list[str]:
        out: list[str] = []
        try:
            walk(json.loads(text), 0, out)
        except (TypeError, ValueError, RecursionError):
            return []
        return out

    @F.pandas_udf("array<string>")
    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return leaves(document)


# Bounds of a tool's input, in characters, entries and levels, and what stands for what was left out.
LEAF, KEY, TOTAL, NODES, DEPTH, ELIDED = 8000, 512, 32_000, 2000, 12, "…"


class _Number(str):
    """A number as it was written."""


def _bounded(text: str | None) -> tuple[str | None, bool]:
    try:
        root = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=lambda _: None)
    except RecursionError:
        return None, True
    except (TypeError, ValueError):
        return None, False
    if not isinstance(root, dict):
        return None, False
    out: list[str] = []
    left, nodes, cut = TOTAL, 0, False

    def spend(x: str) -> None:
        nonlocal left
        out.append(x)
        left -= len(x)

    def string(x: str, most: int, keep: int = 0) -> None:
        """As much of it as ``most`` characters and the budget allow, ``keep`` characters of which are for what follows."""
        nonlocal cut
        shown = x[: min(most, max(0, left - 2 - keep))]
        wire = json.dumps(shown)
        while len(wire) > left - keep:  # escapes are longer
            over = len(wire) - (left - keep)
            shown = shown[: max(0, min(len(shown) - 1, len(shown) - over // 12))]
            wire = json.dumps(shown)
        cut |= len(shown) < len(x)
        spend(wire)

    def value(v: object, depth: int) -> None:
        """Writes a value; at least two characters are left for it."""
        nonlocal left, nodes, cut
        if depth > DEPTH:
            cut = True
            string(ELIDED if left >= 8 else "", LEAF)
        elif isinstance(v, (dict, list)):
            pair = "{}" if isinstance(v, dict) else "[]"
            out.append(pair[0])
            left -= 2
            first, seen = True, set()
            for k in v:
                if isinstance(v, dict):
                    if k[:KEY] in seen:
                        cut = True
                        continue
                    seen.add(k[:KEY])
                # a comma, a key's quotes and colon, and the least that a value can be
                if left < (not first) + (3 if isinstance(v, dict) else 0) + 2:
                    cut = True
                    break
                if not first:
                    spend(",")
                first = False
                if isinstance(v, dict):
                    string(k, KEY, keep=3)
                    spend(":")
                if nodes >= NODES:
                    cut = True
                    string(ELIDED if left >= 8 else "", LEAF)
                    break
                nodes += 1
                value(v[k] if isinstance(v, dict) else k, depth + 1)
            out.append(pair[1])
        elif isinstance(v, str) and not isinstance(v, _Number):
            string(v, LEAF)
        else:
            written = str(v) if isinstance(v, _Number) else json.dumps(v)
            if len(written) <= left:
                spend(written)
            else:
                cut = True
                spend('""')

    value(root, 0)
    return "".join(out), cut


def bounded_json(document: Column) -> Column:
    """struct(text, truncated): a JSON object cut to at most 32,000 characters of JSON with escapes, leaves to 8,000 and keys to 512 characters, 2,000 entries and 12 levels. One
    budget is spent on keys, values and what surrounds them in the document's order; entries beyond it are left out. Numbers stay as written;
    of keys cut alike the first stays. Null for what is no object; an object too deep to be read is null and truncated."""

    @F.pandas_udf("text string, truncated boolean")
    def bound(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_bounded(t) for t in texts], columns=["text", "truncated"])

    return bound(document)


def markdown_table(rows: list, columns: list[str]) -> str:
    """A table of collected report rows, which are few."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    return "\n".join(lines + [f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows])


def html_table(rows: list, columns: list[str]) -> str:
    import html

    tr = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + tr("th", columns) + "".join(tr("td", [r[c] for c in columns]) for r in rows) + "</table>"
