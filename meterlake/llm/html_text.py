"""Visible text of HTML pages: a small tree builder and a layout-aware renderer, page by page."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import text_batches

# Fixed values of the HTML standard: elements by how they parse and lay out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes audio video canvas datalist defs desc metadata symbol".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary svg table tbody td text tfoot th thead tr caption ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption option legend summary svg text".split())
#: start tag -> (open elements that it ends, elements beyond which it doesn't look)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: an element that stands between its parent and a child that needs it
IMPLIED_START = {"td": ("tr", {"tr"}), "th": ("tr", {"tr"}), "tr": ("tbody", {"tbody", "thead", "tfoot"})}

# An attribute as the tokenizer of the standard reads it: a quote opens a value only directly after "=" and white space.
_VALUE = r"""[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+)|(?=>)|\Z)"""
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_VALUE})?+")
_UNNAMED = re.sub(r"\((?=\[\^)", "(?:", _VALUE)
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\r\f/]++|{_NAME}(?:{_UNNAMED})?+)*+)(?:>|\Z)""", re.S)
_TOLD = re.compile("hidden|style|colspan|rowspan", re.I)
_CONCEALED = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_NUMBER = re.compile(r"[ \t\n\r\f]*(\d{1,9})")
# Fixed values of the HTML standard: a cell spans so many columns and rows at most.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


@dataclass(frozen=True)
class Layout:
    """Lines are indented by ``indent`` columns at most, cells wider than ``wide`` don't widen their column, columns that begin after ``line`` are
    not aligned, tables nested deeper than ``deep`` are read as running text and rows spanned are followed in the first ``followed``
    columns, so that no page takes or gives more than a multiple of its own length. No text is lost by these bounds, and ``UNBOUNDED`` has none."""

    indent: float = 40
    wide: float = 100
    line: float = 400
    deep: float = 16
    followed: float = 100


UNBOUNDED = Layout(*[float("inf")] * 5)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HEAD_ONLY = frozenset("base link meta title style script noscript template head html".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of attributes of one name the first counts. Empty if none is of use here."""
    out: dict[str, str] = {}
    if _TOLD.search(attrs):
        for name, *values in _ATTRIBUTE.findall(attrs):
            out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def concealed(attrs: str) -> bool:
    found = attributes(attrs)
    return "hidden" in found or bool(_CONCEALED.search(found.get("style", "")))


def span(attrs: dict[str, str], name: str, most: int) -> int:
    m = _NUMBER.match(attrs.get(name, ""))
    return max(1, min(int(m[1]), most)) if m else 1


def parse(source: str) -> Node:
    """The tree of a page. Where the open elements of a name stand is kept, so that no tag searches the stack."""
    root = Node("html")
    stack = [root]
    open_at: dict[str, list[int]] = defaultdict(list)

    def pop() -> None:
        open_at[stack.pop().tag].pop()

    def close(tags: set[str], stop: set[str]) -> None:
        """Ends the innermost open element of ``tags`` and all inside it, unless one of ``stop`` stands between."""
        at = max((open_at[t][-1] for t in tags if open_at[t]), default=0)
        if at and at >= max((open_at[t][-1] for t in stop if open_at[t]), default=0):
            while len(stack) > at:
                pop()

    def push(tag: str, attrs: str = "") -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        open_at[tag].append(len(stack))
        stack.append(node)

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            if len(stack) > 1 and stack[-1].tag == "head" and not text.isspace():
                pop()
            stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not open_at["p"]:
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                close({tag}, set() if tag in ("table", "body", "html") else {"table", "td", "th"} - {tag} if tag not in ("tr", "tbody", "thead", "tfoot") else {"table"})
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in _HEAD_ONLY:
            pop()
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "li", "div", "blockquote", "button"})
        if tag in IMPLIED_END:
            ends, stop = IMPLIED_END[tag]
            if tag in ("tr", "tbody", "thead", "tfoot"):
                close({"td", "th"}, {"table"})
            if tag in ("tbody", "thead", "tfoot"):
                close({"tr"}, {"table"})
            close(set(ends), set(stop))
        while tag in IMPLIED_START and open_at["table"]:
            between, parents = IMPLIED_START[tag]
            if stack[-1].tag in parents:
                break
            if between == "tr" and stack[-1].tag == "table":
                push("tbody")
            push(between)
            break
        push(tag, m[3] or "")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            stop = end.start() if end else n
            stack[-1].children.append(source[at:stop])
            at = end.end() if end else n
            pop()
        elif tag in VOID or (m[3] or "").rstrip().endswith("/") and tag not in BLOCK:
            pop()
    return root


class Writer:
    """Lines of one flow of text: a page's, or a table cell's."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.marker = ""
        self.indent = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.line.append(first)
            for x in rest:
                self.end(keep=True)
                self.line.append(x)
            return
        s = _SPACE.sub(" ", s)
        if not self.line or self.line[-1].endswith((" ", "\n")):
            s = s.lstrip(" ")
        if s:
            self.line.append(s)

    def end(self, keep: bool = False) -> None:
        line, self.line = "".join(self.line).rstrip(), []
        if not line and not (keep and self.lines):
            return
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        lead = " " * int(min(self.indent, self.layout.indent))
        if self.marker:
            lead = lead[: max(0, len(lead) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append(f"{lead}{line}" if line else "")

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = max(self.gap, int(spaced))

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines)


class Table:
    """Cells by row and column; a cell that spans rows or columns leaves the places after it empty."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.rows: list[dict[int, str]] = []
        self.column = 0
        self.taken: dict[int, int] = {}  # column -> the last row that a cell from above reaches

    def row(self) -> None:
        self.rows.append({})
        self.column = 0

    def cell(self, text: str, attrs: dict[str, str]) -> None:
        if not self.rows:
            self.row()
        at = len(self.rows) - 1
        while self.taken.get(self.column, -1) >= at:
            self.column += 1
        wide, down = span(attrs, "colspan", MOST_COLUMNS), span(attrs, "rowspan", MOST_ROWS)
        if down > 1:
            self.taken.update(dict.fromkeys(range(self.column, int(min(self.column + wide, self.layout.followed))), at + down - 1))
        if text := " ".join(text.split()):
            self.rows[-1][self.column] = text
        self.column += wide

    def lines(self) -> Iterator[str]:
        """Columns of equal width, two spaces apart, without columns and rows that are empty throughout."""
        width: dict[int, int] = {}
        for r in self.rows:
            for i, c in r.items():
                width[i] = max(width.get(i, 0), len(c) if len(c) <= self.layout.wide else 0)
        starts, at = {}, 0
        for i in sorted(width):
            starts[i] = at
            at += width[i] + 2
        for r in self.rows:
            line, n = [], 0
            for i, c in r.items():  # cells come in order of columns
                pad = max(2 if n else 0, starts[i] - n if starts[i] <= self.layout.line else 0)
                line += [" " * pad, c]
                n += pad + len(c)
            if line:
                yield "".join(line)


def render(root: Node, layout: Layout = Layout()) -> str:
    flows = [Writer(layout)]
    tables: list[Table] = []
    lists: list[list] = []
    pre = deep = 0
    work: list[tuple[object, bool]] = [(root, False)]
    while work:
        node, leaving = work.pop()
        out = flows[-1]
        if isinstance(node, str):
            out.text(html.unescape(node), pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if tag in HIDDEN or node.attrs and concealed(node.attrs):
                continue
            if tag == "br":
                out.end(keep=True)
                continue
            if tag in BLOCK and tag not in ("td", "th"):
                out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, 0])
            elif tag == "li":
                if lists:
                    lists[-1][1] += 1
                marker = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                out.indent += len(marker)
                out.marker = marker
            elif tag in ("blockquote", "dd"):
                out.indent += 2
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                if len(tables) < layout.deep:
                    tables.append(Table(layout))
                else:
                    deep += 1
            elif tag == "tr" and tables and not deep:
                tables[-1].row()
            elif tag in ("td", "th") and tables and not deep:
                flows.append(Writer(layout))
            elif tag in ("td", "th"):
                out.text(" ", False)
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children))
            continue
        if tag in ("td", "th") and tables and not deep:
            tables[-1].cell(flows.pop().result(), attributes(node.attrs))
            continue
        if tag == "table" and deep:
            deep -= 1
        elif tag == "table":
            for line in tables.pop().lines():
                out.line.append(line)
                out.end()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        if tag in BLOCK:
            out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
        if tag == "li":
            out.indent -= len(f"{lists[-1][1]}. ") if lists and lists[-1][0] == "ol" else 2
            out.marker = ""
        elif tag in ("blockquote", "dd"):
            out.indent -= 2
            out.marker = ""
        elif tag == "pre":
            pre -= 1
    return flows[0].result()


def visible_text(source: str | None, layout: Layout = Layout()) -> str:
    return render(parse(source), layout) if source else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", layout: Layout = Layout()) -> DataFrame:
    """(page_id, text, n_lines, n_words) of every row of ``pages``, in place and without a shuffle.

    Missing and unclosed tags are supplied, what the page hides (head, scripts, templates, ``hidden``,
    ``display:none``) is left out, blocks stand on lines of their own with a blank line around
    paragraphs, headings, lists and tables, list items have markers by depth and table cells are aligned
    in columns, across spanned columns and rows. Text of drawings (svg) is visible, each piece on a line. Null or empty HTML gives an empty
    text; repeated rows give repeated results. Nesting is walked without recursion, in time that grows with the page's
    length only. Indents and the alignment of tables are bounded by ``layout``; no text is lost by these bounds.
    """
    text_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [visible_text(t.as_py(), layout) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([len(t.split()) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string, n_lines long, n_words long")
