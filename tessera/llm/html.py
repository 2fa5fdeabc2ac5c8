"""Visible text of web pages, laid out: a tree builder with implied tags, visibility rules and a line renderer.

The builder keeps a stack of open elements, closes those whose end tag may be left out and adds the
rows and cells that tables imply.  Subtrees that are not displayed are never entered; text that is only
invisible is left out, and a visible part of an invisible one is shown.  A table is laid out when it closes, so nested ones need no recursion; everything else is laid out in one walk over the tree.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, and elements that are not shown.
TEXT_ONLY = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes noscript audio video canvas datalist".split())
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
#: Elements that start a line, and those with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li listing main nav option optgroup search section summary td th tr tbody thead tfoot caption textarea xmp".split()
)
PRE = frozenset("pre textarea listing xmp".split())
#: Start tags that close an open p; for others, which open elements they close and up to which they look.
ENDS_P = (BLOCK | {"hr"}) - frozenset("body html option optgroup td th tr tbody thead tfoot caption legend textarea".split())
CELLS, ROWS = frozenset(("td", "th")), frozenset(("tbody", "thead", "tfoot"))
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "datalist"))),
    "td": (CELLS, frozenset(("table", "tr"))),
    "th": (CELLS, frozenset(("table", "tr"))),
    "tr": (CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
} | {t: (CELLS | ROWS | {"tr", "caption", "colgroup"}, frozenset(("table",))) for t in ("tbody", "thead", "tfoot", "caption", "colgroup")}
FENCE = frozenset(("table", "td", "th", "html", "body", "caption"))
#: Parts of a table, inside which only some elements may stand; others go before the table.
PARTS = ROWS | {"table", "tr", "colgroup"}
IN_TABLE = CELLS | ROWS | {"tr", "caption", "colgroup", "col"}
#: Columns are padded to this width at most (a longer cell moves only its own line); lists and quotations are indented deeper for this many
#: levels (their markers and text stay beyond); columns that a cell spans at most, as the HTML standard has it.
WIDEST, DEEPEST, SPAN = 240, 32, 1000

_NAME = r"[a-zA-Z][^\s/>\x00]*"
_OTHER = r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?"
_QUOTED = re.compile(_OTHER + rf"""|<(/?)({_NAME})((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_PLAIN = re.compile(_OTHER + rf"|<(/?)({_NAME})([^<>]*)>", re.S)
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_MATTERS = re.compile(r"hidden|style|open|colspan|rowspan|start|value|reversed", re.I)
_DECLARATION = re.compile(r"""\s*([-\w]+)\s*:((?:[^;"'(]++|"[^"]*+"?|'[^']*+'?|\([^)]*+\)?)*+)|[^;]*+;?""")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


class Lines:
    """A part that is laid out already."""

    __slots__ = ("lines",)

    def __init__(self, lines: list[str]):
        self.lines = lines


def _attributes(source: str) -> dict[str, str]:
    if not source or not _MATTERS.search(source):
        return {}
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _style(source: str) -> tuple[str, str]:
    """The values of display and visibility, empty where a style does not set them; the last of each counts."""
    out = {"display": "", "visibility": ""}
    for m in _DECLARATION.finditer(source):
        if m[1] and m[1].lower() in out:
            out[m[1].lower()] = m[2].split("!")[0].strip().lower()
    return out["display"], out["visibility"]


def _tokens(source: str):
    """(end, name, attributes) for tags, a string for text; once a quote stays open, quotes no longer count."""
    at, pattern, size = 0, _QUOTED, len(source)
    while at < size:
        m = pattern.search(source, at)
        stop = m.start() if m else size
        if pattern is _QUOTED:
            opens = _OPENS.search(source, at, stop)
            if opens:  # a tag that this pattern can't end
                pattern = _PLAIN
                continue
        if stop > at:
            yield source[at:stop]
        if not m:
            return
        at = m.end()
        if m[2]:
            name = m[2].lower()
            yield bool(m[1]), name, m[3]
            if name in TEXT_ONLY and not m[1]:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else size
                if stop > at:
                    yield source[at:stop]
                at = stop


def build(source: str) -> tuple[Node, str]:
    """The tree of what is shown, and the page's title."""
    root = Node("#root")
    stack, names, title, unseen = [root], ["#root"], None, 0  # unseen: depth of the outermost hidden element
    open_: Counter[str] = Counter()
    visible = [True]

    def close(depth: int) -> None:
        nonlocal unseen
        while len(stack) > depth:
            node = stack.pop()
            visible.pop()
            open_[names[-1]] -= 1
            if names.pop() == "table" and not unseen:
                node.children = [Lines(table_lines(node))]
            if len(stack) < unseen:
                unseen = 0

    def find(wanted, fence=frozenset()) -> int:
        if not any(open_[t] for t in wanted):
            return 0
        for k in range(len(names) - 1, 0, -1):
            if names[k] in wanted:
                return k
            if names[k] in fence:
                return 0
        return 0

    def place(child) -> None:
        """Adds what is shown to the open element; what may not stand in its part of a table goes before the table."""
        if names[-1] in PARTS and not (isinstance(child, Node) and child.tag in IN_TABLE):
            k = find(("table",))
            if k:
                stack[k - 1].children.insert(len(stack[k - 1].children) - 1, child)
                return
        stack[-1].children.append(child)

    def push(tag: str, attributes=None) -> None:
        nonlocal unseen
        node = Node(tag, attributes)
        a = node.attributes
        shut = names[-1] == "details" and "open" not in stack[-1].attributes and tag != "summary"
        display, visibility = _style(a["style"]) if "style" in a else ("", "")
        hides = tag in UNSEEN or "hidden" in a or shut or (tag == "dialog" and "open" not in a) or display == "none"
        if not unseen and not hides:
            place(node)
        stack.append(node)
        visible.append(visibility == "visible" or (visible[-1] and visibility not in ("hidden", "collapse")))
        names.append(tag)
        open_[tag] += 1
        if not unseen and hides:
            unseen = len(stack)

    def part() -> int:
        """Depth of the innermost open part of a table, 0 inside its cells and captions and outside tables."""
        if not open_["table"]:
            return 0
        for k in range(len(names) - 1, 0, -1):
            if names[k] in CELLS or names[k] == "caption":
                return 0
            if names[k] in PARTS:
                return k if find(("table",)) else 0
        return 0

    for token in _tokens(source):
        if isinstance(token, str):
            if names[-1] == "title" and title is None:
                title = " ".join(unescape(token).split())
            if unseen and names[-1] == "head" and token.strip():
                close(find(("head",)))
            if unseen or not visible[-1] or (names[-1] == "details" and "open" not in stack[-1].attributes):
                continue
            text = token if names[-1] in ("xmp",) or "&" not in token else unescape(token)
            if names[-1] not in PARTS or text.strip():
                place(text)
            continue
        is_end, tag, source_attributes = token
        if is_end:
            if tag == "br":
                if not unseen:
                    place(Node("br"))
                continue
            if tag in ("html", "body"):
                continue
            fence = frozenset() if tag in FENCE or tag in CLOSES else FENCE
            if tag in CELLS or tag == "tr" or tag in ROWS:
                fence = frozenset(("table",))
            k = find((tag,), fence)
            if k:
                close(k)
            elif tag == "p" and not unseen:
                place(Node("p"))
            continue
        if open_["head"] and tag not in IN_HEAD:
            k = find(("head",))
            if k and k == len(names) - 1:
                close(k)
        if tag in ("html", "body", "head") and open_[tag]:
            continue
        if tag in IN_TABLE or tag in ("form", "table"):
            k = part()
            if k and tag == "form":  # an empty element there
                continue
            if k and tag == "table":  # ends the table it stands in
                close(find(("table",)))
            elif k:
                close(k if names[k] == "colgroup" and tag != "col" else k + 1)
            elif tag in IN_TABLE and open_["caption"]:
                k = find(("caption",), frozenset(("table",)))
                if k:
                    close(k)
        if tag in ENDS_P:
            k = find(("p",), FENCE)
            if k:
                close(k)
        rule = CLOSES.get(tag)
        if rule and (tag in CELLS or any(open_[t] for t in rule[0])):
            first = 0
            for k in range(len(names) - 1, 0, -1):
                if names[k] in rule[1]:
                    break
                if names[k] in rule[0]:
                    first = k
                    if tag in ("li", "dt", "dd", "option"):
                        break
            if first:
                close(first)
            if tag in CELLS and find(("table",)) and names[-1] in ("table", "tbody", "thead", "tfoot"):
                push("tr")
        if tag in VOID:
            if not unseen and tag in ("br", "hr", "wbr"):
                place(Node(tag))
            continue
        push(tag, _attributes(source_attributes))
    close(1)
    return root, title or ""


def _number(value: str | None, default: int, most: int) -> int:
    try:
        return max(-most, min(most, int(value)))
    except (TypeError, ValueError):
        return default


def layout(root: Node) -> list[str]:
    """Lines of a tree's text: runs of blanks are one, blocks start lines, spaced blocks have an empty line around them."""
    lines: list[str] = []
    current: list[str] = []
    indents, marker = [""], [""]
    pre = blank = 0  # depth of preformatted elements; whether an empty line is due

    def put(text: str) -> None:
        nonlocal blank
        if blank and lines and lines[-1] != "":
            lines.append("")
        blank = 0
        lines.append((indents[-1][: -len(marker[0])] + marker[0] if marker[0] else indents[-1]) + text if text else "")
        if text:
            marker[0] = ""

    def flush() -> None:
        if current:
            text = "".join(current)
            current.clear()
            text = text.rstrip(" \n") if pre else _BLANKS.sub(" ", text).strip(" ")
            if text.strip():
                for part in text.split("\n"):
                    put(part.rstrip())

    todo: list = [(child, True) for child in reversed(root.children)]
    counters: list[int | None] = []
    while todo:
        node, entering = todo.pop()
        if isinstance(node, str):
            current.append(node if pre else _BLANKS.sub(" ", node))
            continue
        if isinstance(node, Lines):
            flush()
            for text in node.lines:
                put(text)
            continue
        tag = node.tag
        if tag == "br":
            if pre:
                current.append("\n")
            else:
                shown = "".join(current).strip()
                flush()
                if not shown and lines and lines[-1] != "" and not blank:
                    lines.append("")
            continue
        if tag == "wbr":
            continue
        if tag in BLOCK:
            flush()
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and counters):
                blank = 1
        if entering:
            todo.append((node, False))
            todo.extend((child, True) for child in reversed(node.children))
            if tag in PRE:
                pre += 1
                if node.children and isinstance(node.children[0], str) and node.children[0][:1] == "\n":
                    todo[-1] = (node.children[0][1:], True)
            elif tag == "ol":
                counters.append(_number(node.attributes.get("start"), 1, 10**9) - 1)
            elif tag in ("ul", "menu"):
                counters.append(None)
            elif tag == "li":
                sign = "- "
                if counters and counters[-1] is not None:
                    counters[-1] = _number(node.attributes.get("value"), counters[-1] + 1, 10**9)
                    sign = f"{counters[-1]}. "
                marker[0] = sign
                indents.append(indents[-1] + " " * len(sign) if len(indents) <= DEEPEST else indents[-1])
            elif tag in ("blockquote", "dd"):
                indents.append(indents[-1] + ("  " if len(indents) <= DEEPEST else ""))
        else:
            if tag in PRE:
                pre -= 1
            elif tag in ("ol", "ul", "menu"):
                counters.pop()
            elif tag in ("li", "blockquote", "dd"):
                indents.pop()
                marker[0] = ""
    flush()
    while lines and lines[-1] == "":
        lines.pop()
    return lines


def table_lines(table: Node) -> list[str]:
    """A table's caption and rows, cells side by side, each column as wide as its widest cell (up to WIDEST)."""
    rows, head = [], []
    for part in table.children:
        if isinstance(part, Node):
            if part.tag == "tr":
                rows.append(part)
            elif part.tag in ROWS:
                for r in part.children:
                    if isinstance(r, Node) and r.tag == "tr":
                        rows.append(r)
                    elif isinstance(r, Node):
                        head += layout(r)
            else:
                head += layout(part)
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column: rows it stays taken for
    for row in rows:
        col, cells = 0, []
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in CELLS:
                while taken.get(col):
                    col += 1
                span = max(1, _number(cell.attributes.get("colspan"), 1, SPAN))
                down = max(1, _number(cell.attributes.get("rowspan"), 1, len(rows)))
                cells.append((col, span, layout(cell)))
                for c in range(col, col + span):
                    taken[c] = down
                col += span
            elif isinstance(cell, Node):
                head += layout(cell)
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        placed.append(cells)
    width: dict[int, int] = {}
    for cells in placed:
        for col, span, text in cells:
            width.setdefault(col, 0)
            if span == 1:
                width[col] = max(width[col], min(WIDEST, max(map(len, text), default=0)))
    starts, at = {}, 0
    for col in sorted(width):
        starts[col] = at
        at += width[col] + 2
    out = []
    for cells in placed:
        for k in range(max((len(text) for _, _, text in cells), default=0)):
            line = ""
            for col, _, text in cells:
                start = starts[col]
                piece = text[k] if k < len(text) else ""
                if piece:
                    line = line.ljust(start)
                    line = (line if not line or line.endswith("  ") else line.rstrip() + "  ") + piece
            out.append(line.rstrip())
    return head + out


def render(source: str | None) -> tuple[str, str]:
    """(visible text, title) of a page; both empty for null or empty sources."""
    if not source:
        return "", ""
    root, title = build(source)
    return "\n".join(layout(root)).replace("\xa0", " "), title


def extract_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep``, title and text (all that is visible, laid out), one row for each row of ``pages``.

    Null and empty pages have an empty title and text; repeated rows and null ids keep their rows.
    Whole pages are read, however long; other columns are not, so their names may clash.  An empty table gives
    an empty result.
    """
    types = dict(pages.dtypes)

    def kernel(piece):
        got = [render(x) for x in piece.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array([t for _, t in got], pa.string()), pa.array([t for t, _ in got], pa.string())], [*keep, "title", "text"])

    return map_texts(pages.select(*dict.fromkeys([*keep, "html"])), kernel, "".join(f"`{c}` {types[c]}, " for c in keep) + "title string, text string", "html")
