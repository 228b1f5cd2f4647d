"""HTML to text by layout: a tree with implied tags, visibility rules, and a block renderer.

The tree builder reads tags, closes what the next tag implies (paragraphs before blocks, items before
items, cells and rows before cells and rows, all of them at the end of their container), knows void
and raw-text elements and ignores stray end tags. Text and elements that stand in a table but in no
cell come before the table; a cell without a row gets one. Visible is what a browser shows: not head, script,
style, template and the like, nor closed dialogs, the drawing of an svg (its text is shown), the
options that a closed select doesn't show, nor elements with ``hidden``, ``display:none`` or ``visibility:hidden``.

The renderer keeps block spacing (one blank line around paragraphs, headings, lists and tables; a
line break between other blocks), bullets and numbers of lists with their indent, quotes, rules,
preformatted text as it is, and tables as cells aligned in columns.

Cells stand at the first column that cells above (``rowspan``) and before (``colspan``) leave free,
as in the HTML table model; columns in which no cell has text take no room.

Pages are worked row by row, in time linear in their length: open elements are found by their tag's
places in the stack, and there is no recursion. Boxes (items, quotes, cells) more than ``NEST`` deep
are shown without a further indent or grid.

Defined cases: null and blank pages give the empty text, as does a table without rows; markup that
ends anywhere is closed there, and a tag that never ends is text; numbers that are none (``colspan``,
``start``) are left out; repeated pages are rendered each; an empty table gives an empty result;
extra columns pass through, and one named like the result is replaced by it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object audio video canvas datalist noembed noframes area param source track annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote hr figure form fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside div footer header hgroup main nav section li dt dd figcaption details summary center legend menu tr caption thead tbody tfoot td th search".split())
CLOSES_P = (BLOCK - frozenset("html body td th tr caption thead tbody tfoot".split())) | frozenset(["hr"])

#: Tag: (open elements that it ends, elements that bound the search for them).
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: What may stand in a head; anything else ends it.
HEADED = frozenset("html head base link meta title style script noscript noframes template".split())
#: Open elements of a table that hold no text, and what may stand in them.
PARTS = frozenset("table tbody thead tfoot tr colgroup".split())
TABLED = frozenset("caption colgroup col tbody thead tfoot tr td th style script template".split())
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
SCOPE = frozenset("table td th caption button html template".split())

#: Limits of the standard for the cells that one cell may span, and boxes that are set in one another at most.
COLUMNS, ROWS, NEST = 1000, 65534, 48
#: A table whose alignment would take more than so many characters and so many times its text is set cell after cell.
PADDED = 200_000, 20

OPEN = re.compile(r"<(?=[!?/a-zA-Z])")
ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|</[^>]*>?", re.S)
START = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
TORN = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLANKS = " \t\r\n\f"
SPACES = re.compile(r"[ \t\r\n\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def number(text: str | None, low: int, high: int, other: int) -> int:
    """The whole number at the head of an attribute, held between two bounds; ``other`` where there is none."""
    m = re.match(r"[ \t\r\n\f]*+\+?(-?[0-9]{1,9}+)([0-9]?)", text or "")
    if not m:
        return other
    return max(low, min(high, int(m[1]) if not m[2] else high))


class Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, n: int) -> None:
        """End all elements from place ``n`` on."""
        while len(self.stack) > n:
            self.at[self.stack.pop().tag].pop()

    def nearest(self, tags: frozenset[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags, or 0."""
        at = self.at
        return max((at[t][-1] for t in tags if at.get(t)), default=0)

    def close(self, tags: frozenset[str], bound: frozenset[str]) -> None:
        """End the open elements from the outermost of ``tags`` that is nearer than ``bound``."""
        some = [self.at[t] for t in tags if self.at.get(t)]
        if some:
            edge = self.nearest(bound)
            inner = [p[i] for p in some if (i := bisect_right(p, edge)) < len(p)]
            if inner:
                self.cut(min(inner))


PARTED = ("tr", "tbody", "thead", "tfoot")
CELLED = frozenset("td th caption template".split())


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root")
    up = Open(root)
    stack = up.stack

    def add(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(BLANKS):
            up.cut(len(stack) - 1)
        if stack[-1].tag in PARTS and text.strip(BLANKS):
            foster(text)
        else:
            stack[-1].kids.append(text)

    def foster(kid: Node | str) -> None:
        """Put ``kid`` before the open table (or the outermost part, where there is no table)."""
        i = len(stack) - 1
        while stack[i].tag != "table" and stack[i - 1].tag in PARTS:
            i -= 1
        stack[i - 1].kids.insert(len(stack[i - 1].kids) - 1, kid)

    def clear() -> None:
        """End what is open above the nearest part of a table, unless a cell or caption is nearer."""
        i = up.nearest(PARTS)
        if i > up.nearest(CELLED):
            up.cut(i if stack[i].tag == "colgroup" else i + 1)

    at, end, torn = 0, len(page), False
    while at < end:
        m = OPEN.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        begin = m.start()
        if page[begin + 1] in "!?/":
            m, start = ASIDE.match(page, begin), False
        else:
            # a tag whose quotes never close ends at its first >; where no > is left, it is text
            m, start = None if torn else START.match(page, begin), True
            if m is None:
                torn = True
                m = TORN.match(page, begin)
                if m is None:
                    add(html.unescape(page[at:]))
                    break
        if begin > at:
            add(html.unescape(page[at:begin]))
        at = m.end()
        tag = (m[1] or "").lower()
        if not start:
            i = up.nearest((tag,)) if tag else 0
            if i and (tag in PARTED or tag in ("table", "html", "body") or i > up.nearest(SCOPE - {tag})):
                up.cut(i)
            continue
        if tag in TABLED and tag not in ("col", "style", "script", "template"):
            clear()
        elif tag == "table" and stack[-1].tag in PARTS:
            up.close(frozenset(["table"]), CELLED)
        if tag in CLOSES_P:
            up.close(frozenset(["p"]), SCOPE)
        if tag in IMPLIED:
            up.close(*IMPLIED[tag])
        if stack[-1].tag == "head" and tag not in HEADED:
            up.cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in PARTS and stack[-1].tag != "tr":
            stack[-1].kids.append(Node("tr"))
            up.push(stack[-1].kids[-1])
        node = Node(tag, attributes(m[2]) if m[2].strip() else {})
        if stack[-1].tag in PARTS and tag not in TABLED and tag != "form":
            foster(node)
        else:
            stack[-1].kids.append(node)
            if tag == "form" and stack[-1].tag in PARTS:
                continue
        if tag in VOID or m[2].endswith("/") and tag not in BLOCK and up.nearest(("svg", "math")):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            node.kids.append(html.unescape(page[at : stop.start() if stop else end]) if tag in ("textarea", "title") else page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        up.push(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    style = node.attrs.get("style")
    return not style or not re.search(r"(?i)(^|;)\s*(display\s*:\s*none|visibility\s*:\s*(hidden|collapse))", style)


def shown(select: Node) -> list[Node | str]:
    """The texts of the options that a select shows: all of a list, the chosen one of a closed one."""
    options: list[Node] = []
    todo: list[Node] = [select]
    while todo:
        node = todo.pop()
        if node.tag == "option" and visible(node):
            options.append(node)
        elif node.tag != "option" and (node is select or visible(node)):
            todo.extend(x for x in reversed(node.kids) if isinstance(x, Node))
    if options and "multiple" not in select.attrs and number(select.attrs.get("size"), 0, 10**6, 1) <= 1:
        options = [x for x in options if "selected" in x.attrs][-1:] or options[:1]
    return [x for o in options for x in (" ", *([o.attrs["label"]] if o.attrs.get("label") else o.kids), " ")]


class Lines:
    """Lines of a block in the making: inline text, breaks and the space asked between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # blank lines before the next text
        self.space = False

    def text(self, s: str) -> None:
        words = SPACES.sub(" ", s)
        if not words:
            return
        if words[0] == " ":
            self.space = True
        body = words.strip(" ")
        if not body:
            return
        self._open()
        if self.space and self.now:
            self.now.append(" ")
        self.now.append(body)
        self.space = words[-1] == " "

    def _open(self) -> None:
        if self.gap and self.lines and not self.now:
            self.lines.extend([""] * self.gap)
        if not self.now:
            self.gap = 0

    def flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def brk(self) -> None:
        if self.now:
            self.flush()
        else:
            self._open()
            self.lines.append("")

    def whole(self, lines: list[str], gap: int) -> None:
        self.block(gap)
        if lines:
            self._open()
            self.lines.extend(lines)
            self.gap = gap

    def done(self) -> list[str]:
        self.flush()
        lo, hi = 0, len(self.lines)
        while hi and not self.lines[hi - 1].strip():
            hi -= 1
        while lo < hi and not self.lines[lo].strip():
            lo += 1
        return self.lines[lo:hi]


@dataclass(slots=True)
class Cell:
    lines: list[str]
    across: int = 1
    down: int = 1  # 0: to the end of its group of rows


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """(column, cell) of each row of one group: the first columns that cells above and before leave free."""
    out, taken = [], []  # taken: (first column, end, last row) of cells that reach down, by column
    for y, row in enumerate(rows):
        taken = [t for t in taken if t[2] >= y]
        made, new, x, k = [], [], 0, 0
        for cell in row:
            while k < len(taken) and taken[k][0] <= x:
                x, k = max(x, taken[k][1]), k + 1
            made.append((x, cell))
            last = len(rows) - 1 if not cell.down else min(y + cell.down, len(rows)) - 1
            if last > y:
                new.append((x, x + cell.across, last))
            x += cell.across
        out.append(made)
        if new:
            taken, joined = sorted([*taken, *new]), []
            for t in taken:  # neighbours that end in the same row are one
                if joined and joined[-1][2] == t[2] and joined[-1][1] >= t[0]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], t[1]), t[2])
                else:
                    joined.append(t)
            taken = joined
    return out


def table_lines(groups: list[list[list[Cell]]]) -> list[str]:
    """Cells aligned in columns, two spaces apart; columns and rows without text are left out."""
    rows = [[(x, c) for x, c in row if any(s.strip() for s in c.lines)] for g in groups for row in placed(g)]
    rows = [r for r in rows if r]
    width: dict[int, int] = {}
    for r in rows:
        for x, c in r:
            width[x] = max(width.get(x, 0), *map(len, c.lines))
    begin, at = {}, 0
    for x in sorted(width):
        begin[x], at = at, at + width[x] + 2
    text = sum(len(s) for r in rows for _, c in r for s in c.lines)
    if sum(begin[r[-1][0]] * max(len(c.lines) for _, c in r) for r in rows) > PADDED[0] + PADDED[1] * text:
        rows = [[(k, c) for k, (_, c) in enumerate(r)] for r in rows]
        begin = dict.fromkeys(range(max(map(len, rows))), 0)
    out = []
    for r in rows:
        for i in range(max(len(c.lines) for _, c in r)):
            line, done = [], 0
            for x, c in r:
                if i < len(c.lines) and c.lines[i]:
                    line.append(" " * (begin[x] - done if begin[x] else 2 * bool(line)) + c.lines[i])
                    done = begin[x] + len(c.lines[i])
            out.append("".join(line).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    # frames: [node, next kid, lines, kind, extra]; a frame with own lines hands them to its parent when it ends
    top = Lines()
    stack: list[list] = [[root, 0, top, "flow", None]]
    boxes = items = 0  # open frames with lines of their own; items among them
    while stack:
        frame = stack[-1]
        node, k, lines, kind, extra = frame
        if k < len(node.kids):
            frame[1] += 1
            kid = node.kids[k]
            if isinstance(kid, str):
                if kind in ("pre", "pretop"):
                    extra.append(kid)
                elif kind not in ("table", "section", "row", "svg"):
                    lines.text(kid)
                continue
            if not visible(kid):
                continue
            tag = kid.tag
            if tag == "select":
                kid = Node("select", {}, shown(kid))
            if kind == "svg" or tag == "svg" and kind not in ("pre", "pretop"):
                if tag in ("text", "foreignobject"):
                    lines.text(" ")
                    stack.append([Node(tag, {}, [*kid.kids, " "]), 0, lines, "inline", None])
                elif tag not in UNDRAWN:
                    stack.append([kid, 0, lines, "svg", None])
            elif kind in ("pre", "pretop"):
                if tag == "br":
                    extra.append("\n")
                stack.append([kid, 0, lines, "pre", extra])
            elif tag == "br":
                lines.brk()
            elif tag == "hr":
                lines.whole(["-" * 20], 1)
            elif tag == "img":
                lines.text(f" {kid.attrs['alt']} " if kid.attrs.get("alt", "").strip() else "")
            elif boxes < NEST and (tag == "table" or kind not in ("table", "section") and tag == "tr"):
                # lines of captions, and groups of rows of cells
                stack.append([kid if tag == "table" else Node("table", {}, [kid]), 0, lines, "table", ([], [[]])])
            elif kind in ("table", "section") and tag == "tr":
                extra[1][-1].append([])
                stack.append([kid, 0, lines, "row", extra[1][-1][-1]])
            elif kind == "table" and tag in ("thead", "tbody", "tfoot"):
                extra[1].append([])
                stack.append([kid, 0, lines, "section", extra])
            elif tag in ("td", "th") and kind == "row":
                boxes += 1
                stack.append([kid, 0, Lines(), "cell", extra])
            elif kind in ("table", "section") and tag == "caption":
                boxes += 1
                stack.append([kid, 0, Lines(), "caption", extra[0]])
            elif tag == "pre":
                stack.append([kid, 0, lines, "pretop", []])
            elif tag in ("ul", "ol", "menu"):
                gap = 0 if items else 1
                lines.block(gap)
                stack.append([kid, 0, lines, "list", [tag, number(kid.attrs.get("start"), -(10**9), 10**9, 1), gap]])
            elif boxes < NEST and tag in ("li", "dd"):
                mark = "- " if tag == "li" else "    "
                if tag == "li" and kind == "list" and extra[0] == "ol":
                    mark = f"{extra[1]}. "
                    extra[1] += 1
                boxes, items = boxes + 1, items + 1
                stack.append([kid, 0, Lines(), "item", mark])
            elif boxes < NEST and tag == "blockquote":
                boxes += 1
                stack.append([kid, 0, Lines(), "quote", None])
            elif tag in BLOCK or tag == "table":
                gap = 1 if tag in SPACED else 0
                lines.block(gap)
                stack.append([kid, 0, lines, "flow", gap])
            else:
                stack.append([kid, 0, lines, kind if kind in ("row", "table", "section") else "inline", extra])
            continue
        stack.pop()
        if not stack:
            break
        parent = stack[-1]
        if kind == "flow":
            lines.block(extra or 0)
        elif kind == "list":
            lines.block(extra[2])
        elif kind == "table" and node.tag == "table":
            lines.whole([*extra[0], *table_lines(extra[1])], 1)
        elif kind == "cell":
            boxes -= 1
            extra.append(Cell(lines.done() or [""], number(node.attrs.get("colspan"), 1, COLUMNS, 1), number(node.attrs.get("rowspan"), 0, ROWS, 1)))
        elif kind == "caption":
            boxes -= 1
            extra.extend(lines.done())
        elif kind == "item":
            boxes, items = boxes - 1, items - 1
            done = lines.done()
            parent[2].whole([(extra if i == 0 else " " * len(extra)) + x if x else "" for i, x in enumerate(done)], 0)
        elif kind == "quote":
            boxes -= 1
            parent[2].whole([f"> {x}".rstrip() for x in lines.done()], 1)
        elif kind == "pretop":
            text = "".join(extra)
            text = text[1:] if text.startswith("\n") else text
            lines.whole(text.rstrip("\n").split("\n") if text.strip() else [], 1)
    return "\n".join(top.done())


def page_text(page: str | None) -> str:
    return render(parse(page)) if page and page.strip() else ""


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_col``."""
    small_batches(pages.sparkSession)

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in it:
            yield pd.Series([page_text(x) for x in each], dtype=object)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pages.withColumn(out, F.pandas_udf(run, "string")(F.col(html_col).cast("string")))
